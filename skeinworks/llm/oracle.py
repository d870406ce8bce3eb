"""DuckDB counterparts of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .survivors import FIELDS, STAND_INS

_EDGE = r"[\s\p{P}<>|`^~$+=]+"
_GARBLED = r"\x{FFFD}|\?\?|\\u[0-9a-fA-F]{2}|\\x[0-9a-fA-F]{2}|&#\d+;?|&[a-z]+;|Ã.|â€|Â.|[\x00-\x08\x0b\x0c\x0e-\x1f]"


def _claims() -> str:
    """One select a field: the claims that could be genuine, each seen alone."""
    out = []
    for f in FIELDS:
        listed = ", ".join(f"'{x}'" for x in STAND_INS[f].split("|"))
        extra = {"original_name": " and not regexp_full_match(core, '(entity|person|organi[sz]ation|location|event|product|name) ?\\d+')", "description": " and regexp_matches(v, '[.!?。!?][\"''”’»)\\]]*\\s*$')"}.get(f, "")
        out.append(
            f"select e, '{f}' as field, v, mention_id, builder_model, tm from (select canonical_entity_id as e, mention_id, builder_model, extracted_at as tm, {f} as v, "
            f"regexp_replace(lower({f}), '^{_EDGE}|{_EDGE}$', '', 'g') as core from m where canonical_entity_id is not null) where v is not null and core <> '' and core not in ({listed}) "
            f"and not regexp_matches(v, '{_GARBLED}') and not regexp_matches(v, '(…|\\.\\.\\.|[-–—])\\s*$'){extra}"
        )
    return " union all ".join(out)


SQL: dict[str, str] = {
    "p2_found": """
with recursive d as (
  select left_mention_id l, right_mention_id r from (
    select *, row_number() over (partition by pair_id order by decided_at desc nulls last, (lower(trim(action)) = 'merge')::int, left_mention_id desc, right_mention_id desc) k
    from pair_decisions where pair_id is not null and action is not null and left_mention_id is not null and right_mention_id is not null)
  where k = 1 and lower(regexp_replace(action, '^\\s+|\\s+$', '', 'g')) = 'merge' and left_mention_id <> right_mention_id
    and pair_id not in (select trigger_pair_id from blocked_merges where trigger_pair_id is not null)),
v as (select l, r from d where l in (select mention_id from mentions) and r in (select mention_id from mentions)),
e as (select l a, r b from v union select r, l from v),
w(node, c) as (select distinct a, a from e union select e.b, w.c from w join e on e.a = w.node and w.c < e.b)
select node as mention_id, min(c) as group_id from w group by 1""",
    "p3_found": "select distinct chunk_id from chunks where len(regexp_extract_all(content, '[^ \\t\\n]+')) > 300",
    "p4_found": """
with r as (select base_run_id, builder_model b, graph_regime g, latency_ms from (
    select *, row_number() over (partition by retrieval_result_id order by retrieved_at desc) k from retrievals where latency_ms is not null and not isnan(latency_ms) and latency_ms >= 0) where k = 1),
o as (select *, row_number() over (partition by base_run_id, b, g order by latency_ms) i, count(*) over (partition by base_run_id, b, g) n from r),
t as (select base_run_id, b, g, latency_ms p95 from o where i = ceil(round(0.95 * n, 9)))
select distinct p.base_run_id, builder_key, regime from request_efficiency_by_builder_and_regime p join t on t.base_run_id = p.base_run_id and b = builder_key and g = regime
where abs(retrieval_latency_p95_s * 1000 - p95) > 0.2 * p95""",
    # support decides in the operator which of two names is cut off; a name that another one goes on from is the cut one here
    "p5_found": f"""
with m as (select * from (select *, row_number() over (partition by mention_id order by ingested_at desc) k from mentions where mention_id is not null) where k = 1),
n as (select canonical_entity_id e, count(*) n from m where canonical_entity_id is not null group by 1),
c as ({_claims()}),
g as (select * from c where not (field = 'original_name' and exists (select 1 from c d where d.e = c.e and d.field = 'original_name' and d.v <> c.v and starts_with(d.v, c.v)))),
t as (select builder_model, min(trust_rank) rank from builder_trust group by 1),
r as (select e, field, mention_id, coalesce(rank, 2147483647) rank, tm from g left join t using (builder_model)),
b as (select e, field, min(rank) rank, max(tm) tm from r group by 1, 2)
select e as canonical_entity_id, field as field_name, min(mention_id) as mention_id from r join b using (e, field, rank, tm) join n using (e) where n >= 2 group by 1, 2""",
    "p7_found": """
with m as (select mention_id, embedding::double[] v from (select *, row_number() over (partition by mention_id order by ingested_at desc) k from mentions
    where embedding is not null and len(embedding) = 32 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0) where k = 1),
u as (select mention_id, v::double[32] v from m),
s as (select a.mention_id x, b.mention_id y, array_cosine_similarity(a.v, b.v) c from u a join u b on a.mention_id <> b.mention_id where array_cosine_similarity(a.v, b.v) >= 0.975),
k as (select x, y from (select *, row_number() over (partition by x order by c desc, y) n from s) where n <= 5)
select k.x as mention_a, k.y as mention_b from k join k j on j.x = k.y and j.y = k.x where k.x < k.y""",
    "p8_found": """
with dw as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents), iw as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from eval_items),
dg as (select doc_id, array_to_string(w[i:i + 7], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from dw)), ig as (select item_id, array_to_string(w[i:i + 7], ' ') g from (select item_id, w, unnest(range(1, len(w) - 6)) i from iw))
select distinct doc_id, item_id from dg join ig using (g)""",
    "p8_kept": """
with dw as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from documents), iw as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') w from eval_items),
dg as (select doc_id, array_to_string(w[i:i + 7], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from dw)), ig as (select item_id, array_to_string(w[i:i + 7], ' ') g from (select item_id, w, unnest(range(1, len(w) - 6)) i from iw))
select distinct doc_id from documents where doc_id not in (select doc_id from dg join ig using (g))""",
}
