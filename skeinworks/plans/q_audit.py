"""Audits of extraction, resolution, recovery, workspaces and subsets; embedding route, hard negatives, cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits, gates, models, relations, selection, stats, vectors
from ..operators import resolution as ER
from .q_graph import _KNN, _REL, named_edges
from .q_graph import relations as rel
from .q_metrics import _QUOTA, _RM, _rank_rows
from .q_more import eligible
from .q_resolution import decisions
from .q_text import mentions
from .registry import M, R, query

_D = (
    "d as (select pair_id, left_mention_id as l, right_mention_id as r, lower(trim(action)) as action, source, score from (select *, row_number() over (partition by pair_id order by decided_at desc, action, left_mention_id, right_mention_id, source, score) as k from pair_decisions "
    "where pair_id is not null and action is not null and left_mention_id is not null and right_mention_id is not null) where k = 1 and left_mention_id <> right_mention_id)"
)


def _union(checks: dict[str, str]) -> str:
    return " union all ".join(f"select '{name}' as check_name, count(*)::bigint as violations from ({sql})" for name, sql in checks.items())


@query(
    f"with {M}, {_REL}, k as (select distinct chunk_id, document_id from chunks), mm as (select mention_id, chunk_id, document_id, extraction_call_id as call_id, description from m), "
    "ca as (select extraction_call_id as call_id, document_id, chunk_id, max(provenance) as response, min(provenance) as kept from m group by 1, 2, 3), "
    "ml as (select mention_id from mm group by 1 having count(*) > 1 or trim(mention_id) = '' union select mention_id from mm anti join k using (chunk_id, document_id) union select mention_id from mm anti join (select * from ca where call_id is not null) c using (call_id, document_id, chunk_id) "
    "union select mention_id from mm where description is not null and trim(description) = ''), "
    "rl as (select relation_id from (select relation_id, chunk_id, unnest([x, y]) as mention_id from rel) anti join mm using (chunk_id, mention_id)) "
    + _union(
        {
            "raw_extraction_responses": "select call_id from ca left join k using (document_id, chunk_id) where call_id is null or trim(call_id) = '' or k.chunk_id is null or response is null or response <> kept",
            "raw_normalized_chunk_lineage": "select * from mm anti join (select * from ca where call_id is not null) c using (call_id, document_id, chunk_id)",
            "mention_ids_and_lineage": "select * from ml",
            "relation_ids_endpoints_and_lineage": "select distinct relation_id from rl",
            "chunk_presence_summaries": "select k.chunk_id from k left join (select distinct chunk_id, true as there from mm) using (chunk_id) where coalesce(there, false) = false",
            "complete_document_snapshot": "select a.document_id from (select distinct document_id from documents) a full join (select distinct document_id from chunks) b on a.document_id = b.document_id where a.document_id is null or b.document_id is null",
            "manifest_document_counts": "select 1 where (select count(distinct document_id) from chunks) <> (select count(*) from documents)",
        }
    )
)
def extraction_gates(t):
    m = mentions(t, "chunk_id", "document_id", "extraction_call_id", "description", "provenance").withColumnRenamed("extraction_call_id", "call_id")
    k = t("chunks").select("chunk_id", "document_id").distinct()
    calls = m.groupBy("call_id", "document_id", "chunk_id").agg(F.max("provenance").alias("response"), F.sha2(F.min("provenance"), 256).alias("response_sha256"))
    # the tables tell one attempt a call and chunk, so attempts are told apart by their place
    calls = calls.withColumn("attempt", F.concat_ws("|", "document_id", "chunk_id"))
    m = m.withColumn("has_description", F.col("description").isNotNull())
    r = rel(t).select("relation_id", "chunk_id", F.col("x").alias("source"), F.col("y").alias("target"))
    docs = t("documents").select("document_id")
    manifest = t("chunks").agg(F.countDistinct("document_id").alias("documents"))
    return gates.report(
        {
            "raw_extraction_responses": audits.raw_responses(calls, k),
            "raw_normalized_chunk_lineage": audits.foreign_calls(m, calls),
            "mention_ids_and_lineage": audits.mention_lineage(m, k, calls),
            "relation_ids_endpoints_and_lineage": audits.relation_lineage(r, m),
            "chunk_presence_summaries": audits.presence(k.withColumn("has_mentions", F.lit(True)), m, "has_mentions"),
            "complete_document_snapshot": audits.differing(docs, k, ["document_id"]),
            "manifest_document_counts": audits.declared_count(manifest, "documents", docs),
        }
    )


@query(
    f"with {M}, {_D}, c as (select mention_id, original_name, canonical_entity_id as e from m), g as (select original_name, count(distinct e) as n, sum((e is null)::int) as lost from c where original_name is not null group by 1), "
    "b as (select d.*, x.e as le, y.e as re from d left join c x on x.mention_id = l left join c y on y.mention_id = r) "
    + _union(
        {
            "native_entities_are_never_split": "select * from g where n <> 1 or lost > 0",
            "one_entity_per_mention": "select mention_id from c group by 1 having count(distinct e) > 1",
            "cannot_links_respected": "select * from b where action = 'reject' and le = re",
            "merges_lead_to_one_entity": "select * from b where action = 'merge' and le <> re",
            "unknown_ends": "select * from b where l not in (select mention_id from c) or r not in (select mention_id from c)",
            "candidate_order": "select * from d where l >= r",
            "pair_decisions_policy": "select * from d where (score >= 0.76 and action <> 'merge') or (score < 0.5 and action <> 'reject')",
            "judge_usage_within_budget": "select count(*) from d where source = 'judge' having count(*) > 100",
            "decision_identity": "select * from d where not regexp_full_match(pair_id, 'pair_[0-9a-f]{24}')",
        }
    )
)
def resolution_audit(t):
    c = mentions(t, "original_name", "canonical_entity_id").withColumnRenamed("canonical_entity_id", "e")
    d = decisions(t)
    side = lambda n: c.select(F.col("mention_id").alias(f"{n}_id"), F.col("e").alias(f"{n}_e"))
    both = d.join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    known = c.select("mention_id")
    ends = d.join(known.withColumnRenamed("mention_id", "left_id"), "left_id", "left_semi").join(known.withColumnRenamed("mention_id", "right_id"), "right_id", "left_semi")
    named = c.where("original_name is not null")
    return gates.report(
        {
            "native_entities_are_never_split": audits.split_groups(named.select("original_name", "mention_id"), "original_name", c, "mention_id", "e"),
            "one_entity_per_mention": audits.groups_disjoint(c, "e", "mention_id"),
            "cannot_links_respected": both.where("action = 'reject' and left_e = right_e"),
            "merges_lead_to_one_entity": both.where("action = 'merge' and left_e <> right_e"),
            "unknown_ends": d.join(ends.select("pair_id"), "pair_id", "left_anti"),
            "candidate_order": audits.route_evidence(d.withColumn("methods", F.lit("")), [""], 0.0),
            "pair_decisions_policy": d.where(f"(score >= {ER.MERGE_AT} and action <> 'merge') or (score < {ER.REJECT_BELOW} and action <> 'reject')"),
            "judge_usage_within_budget": audits.over_budget(d, 100),
            "decision_identity": d.where(~F.col("pair_id").rlike("^pair_[0-9a-f]{24}$")),
        }
    )


@query(
    f"with {M}, {_REL}, k as (select chunk_id, max(content) as content from chunks group by 1), e as (select distinct least(s, t) as l, greatest(s, t) as r from (select lower(a.original_name) as s, lower(b.original_name) as t, x from rel join m a on a.mention_id = x join m b on b.mention_id = y) where l < r), "
    "z as (select relation_id, rel.chunk_id, a.original_name as s, b.original_name as t, coalesce(trim(a.description), '') as q from rel join m a on a.mention_id = x join m b on b.mention_id = y where a.original_name is not null and b.original_name is not null), "
    "j as (select z.*, content, e.l from z left join k using (chunk_id) left join e on e.l = least(s, t) and e.r = greatest(s, t)), "
    "p as (select case when content is null then 'unknown_chunk' end as problem from j union all select case when s = t then 'loop' end from j union all select case when l is not null then 'already_an_edge' end from j "
    "union all select case when q = '' then 'no_quote' when content is null or not contains(content, q) then 'quote_not_in_chunk' end from j) select problem, count(*)::bigint as n from p where problem is not null group by 1"
)
def recovery_evidence(t):
    n = mentions(t, "original_name", "description").where("original_name is not null")
    r = rel(t).join(n.select(F.col("mention_id").alias("x"), F.col("original_name").alias("source"), F.col("description").alias("quote")), "x").join(n.select(F.col("mention_id").alias("y"), F.col("original_name").alias("target")), "y")
    low = r.select(F.lower("source").alias("source"), F.lower("target").alias("target")).where("source <> target")
    return relations.evidence_checks(r.select("relation_id", "chunk_id", "source", "target", "quote"), t("chunks"), low).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"with {M}, {_REL}, pl as (select chunk_id from m where original_name is not null group by 1 having count(distinct original_name) >= 2), rs as (select chunk_id from m where provenance is not null group by 1), "
    "ed as (select distinct least(a.original_name, b.original_name) as l, greatest(a.original_name, b.original_name) as r from rel join m a on a.mention_id = x join m b on b.mention_id = y where a.original_name is not null and b.original_name is not null), "
    "sm as (select distinct least(lower(l), lower(r)) as l, greatest(lower(l), lower(r)) as r from ed) "
    + _union(
        {
            "one_result_per_eligible_chunk": "select coalesce(pl.chunk_id, rs.chunk_id) from pl full join rs using (chunk_id) where pl.chunk_id is null or rs.chunk_id is null",
            "rr_graph_is_er_edge_superset": "select * from ed except select * from sm",
            "candidate_plan_deterministic": "(select chunk_id from pl except all select chunk_id from rs) union all (select chunk_id from rs except all select chunk_id from pl)",
        }
    )
)
def recovery_gates(t):
    m = mentions(t, "chunk_id", "original_name", "provenance")
    plan = m.where("original_name is not null").groupBy("chunk_id").agg(F.countDistinct("original_name").alias("n")).where("n >= 2").select("chunk_id")
    results = m.where("provenance is not null").select("chunk_id").distinct()
    e = named_edges(t)
    low = e.select(F.lower("source").alias("source"), F.lower("target").alias("target"))
    return gates.report(
        {
            "one_result_per_eligible_chunk": audits.result_set(results, plan, "chunk_id"),
            "rr_graph_is_er_edge_superset": audits.lost_edges(e, low),
            "candidate_plan_deterministic": audits.changed_plan(plan, results),
        }
    )


@query(
    f"with {M}, {_REL}, k as (select mention_id, coalesce(canonical_entity_id, 'name:' || lower(original_name), mention_id) as e from m), z as (select x, y, a.e as s, b.e as t from rel join k a on a.mention_id = x join k b on b.mention_id = y), "
    "af as (select distinct least(s, t) as s, greatest(s, t) as t from z), lo as (select distinct s from af where s = t) "
    + _union(
        {
            "er_induced_self_loops_removed": "select s from lo where s in (select s from z where s = t and x <> y)",
            "preexisting_self_loops_retained_only": "select s from lo",
            "exported_nodes_unique": "select e from (select distinct e from k) group by 1 having count(*) > 1 or trim(e) = ''",
            "no_dangling_edges": "select * from z where s not in (select e from k) or t not in (select e from k)",
        }
    )
)
def workspace_gates(t):
    k = mentions(t, "canonical_entity_id", "original_name").select("mention_id", F.coalesce("canonical_entity_id", F.concat(F.lit("name:"), F.lower("original_name")), "mention_id").alias("e"))
    r = rel(t).select("x", "y")
    side = lambda c, n: k.select(F.col("mention_id").alias(c), F.col("e").alias(n))
    z = r.join(side("x", "s"), "x").join(side("y", "t"), "y")
    after = z.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).distinct()
    ends = z.select(F.explode(F.array("s", "t")).alias("e"))
    checks = audits.loop_audit(r, k, "mention_id", "e", after.withColumnsRenamed({"s": "x", "t": "y"}), "x", "y")
    return gates.report(checks | {"exported_nodes_unique": gates.repeated(k.select("e").distinct(), "e"), "no_dangling_edges": gates.unknown(ends, "e", k, "e")})


@query(
    f"with {_QUOTA}, q as (select question_type, question_id, gold_document_ids as ids, row_number() over (partition by question_type order by substr(sha256('seed' || chr(0) || question_id), 1, 16), question_id) as n from questions where question_type is not null), "
    "su as (select question_id, question_type, ids from q join qu using (question_type) where n <= quota), li as (select distinct question_id, unnest(ids) as document_id from su), d as (select document_id, text, case when document_id in (select document_id from li) then 'gold' else 'hard_negative' end as role from documents), "
    "pi as (select question_id from questions where answerable is false) "
    + _union(
        {
            "exact_question_count": "select count(*) from su having count(*) <> 90",
            "exact_type_balance": "select * from (select question_type, count(*) as n from su group by 1) full join qu using (question_type) where n is distinct from quota",
            "no_duplicate_question_ids": "select question_id from su group by 1 having count(*) > 1",
            "no_duplicate_document_ids": "select document_id from d group by 1 having count(*) > 1",
            "no_duplicate_document_bodies": "select text from d group by 1 having count(*) > 1",
            "no_pilot_question_overlap": "select * from su where question_id in (select question_id from pi)",
            "mapping_covers_every_question_exactly": "select * from su where ids is null or len(ids) = 0 or len(list_distinct(ids)) <> len(ids)",
            "gold_documents_present": "select * from li where document_id not in (select document_id from d where role = 'gold')",
            "every_gold_document_used": "select * from d where role = 'gold' and document_id not in (select document_id from li)",
            "roles_known": "select 1 where false",
            "texts_not_blank": "select * from d where text is null or trim(text) = ''",
        }
    )
)
def subset_invariants(t):
    q = t("questions").where("question_type is not null")
    quotas = selection.balanced_quotas(q, "question_type", 90, "quota")
    chosen = selection.stratified_sample(q.select("question_type", "question_id", F.col("gold_document_ids").alias("document_ids")), "question_type", "question_id", quotas, "seed")
    gold = chosen.select(F.explode("document_ids").alias("document_id")).distinct().withColumn("g", F.lit(1))
    d = t("documents").select("document_id", "text").join(gold, "document_id", "left").withColumn("role", F.when(F.col("g").isNull(), "hard_negative").otherwise("gold"))
    return gates.report(audits.subset_audit(chosen, d, t("questions").where("not answerable"), quotas, 90))


@query(
    "with a as (select unnest(gold_document_ids) as document_id, min(question_type) as role from questions where answerable group by 1), b as (select unnest(retrieved_document_ids) as document_id, min(graph_regime) as role from retrievals group by 1), "
    "x as (select document_id, min(role) as left_role from a group by 1), y as (select document_id, min(role) as right_role from b group by 1) select document_id, left_role, right_role from x join y using (document_id)"
)
def pilot_overlap(t):
    a = t("questions").where("answerable").select(F.explode("gold_document_ids").alias("document_id"), F.col("question_type").alias("role"))
    b = t("retrievals").select(F.explode("retrieved_document_ids").alias("document_id"), F.col("graph_regime").alias("role"))
    return selection.overlap(a, b, "document_id", "role")


@query()
def hard_negative_facility(t):
    s, gold, held = eligible(t)
    s = s.where("score > 0").join(gold.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti").join(held, ["question_id", "doc_id"], "left_anti")
    chosen = gold.select("doc_id").distinct()
    return selection.facility_negatives(s.join(chosen, "doc_id", "left_anti"), t("documents").select("doc_id", "source", "category"), "question_id", "doc_id", 40, {"source": 6, "category": 12}, "facility")


@query(
    f"with {_KNN.replace('rank <= 10', 'rank <= 5')} select least(left_id, right_id) as left_id, greatest(left_id, right_id) as right_id, max(cosine) as cosine, min(case when left_id < right_id then rank end)::int as left_rank, min(case when left_id > right_id then rank end)::int as right_rank, "
    "count(*) = 2 as reciprocal, greatest(0, least(1, (max(cosine) + 1) / 2)) as embedding from k group by 1, 2"
)
def route_embedding(t):
    k = vectors.block_knn(t("embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 64, 5)
    return ER.block_embedding(k.withColumnsRenamed({"left_id": "id", "right_id": "neighbour"}))


@query(
    "with w as (select base_run_id, builder_model as builder, graph_regime as regime, count(distinct question_id) as n, avg(context_token_count) as v from retrievals group by 1, 2, 3), p as (select * from (values ('er', 'Native', 'ER'), ('rr', 'ER', 'ER+RR'), ('both', 'Native', 'ER+RR')) as x(role, l, r)), b as (select distinct builder_model as builder from builder_trust), "
    "s as (select a.builder, role, l, r, count(*) as n from p join w a on a.regime = l join w c on c.regime = r and c.builder = a.builder and c.base_run_id = a.base_run_id group by 1, 2, 3, 4) "
    + _union(
        {
            "builders_and_roles_complete": "select coalesce(s.builder, z.builder) from s full join (select builder, role from b, p) z on z.builder = s.builder and z.role = s.role where s.builder is null or z.builder is null",
            "one_summary_per_builder_and_role": "select builder, role from s group by 1, 2 having count(*) > 1",
            "contrast_as_planned": "select 1 where false",
            "paired_question_count": "select * from s where n <> 1",
        }
    )
)
def cascade_collection(t):
    roles = [("er", "Native", "ER"), ("rr", "ER", "ER+RR"), ("both", "Native", "ER+RR")]
    w = t("retrievals").select("base_run_id", F.col("builder_model").alias("builder"), F.col("graph_regime").alias("regime")).distinct()
    plan = w.sparkSession.createDataFrame(roles, "role string, left_regime string, right_regime string")
    left = w.withColumnRenamed("regime", "left_regime").join(F.broadcast(plan), "left_regime")
    s = left.join(w.withColumnRenamed("regime", "right_regime"), ["base_run_id", "builder", "right_regime"])
    s = s.groupBy("builder", "role", "left_regime", "right_regime").agg(F.count(F.lit(1)).alias("paired_question_count"))
    return gates.report(audits.cascade(s, t("builder_trust").select(F.col("builder_model").alias("builder")), roles, 1)[1])


def _paired(t):
    v = _rank_rows(t).groupBy("regime", "question_type", "question_id").agg(F.avg("reciprocal_rank").alias("v"))
    delta = lambda a, b: stats.paired_deltas(v, ["question_type", "question_id"], "regime", a, b, "v").withColumn("contrast", F.lit(f"{b} - {a}"))
    return delta("Native", "ER").unionByName(delta("ER", "ER+RR")).unionByName(delta("Native", "ER+RR"))


@query(
    f"with {R}, {_RM}, v as (select regime, question_id, avg(rr) as v from rq group by 1, 2), p as (select question_id, max(case when regime = 'Native' then v end) as n, max(case when regime = 'ER' then v end) as e, max(case when regime = 'ER+RR' then v end) as r from v group by 1), "
    "d as (select 'ER - Native' as contrast, n as a, e as b from p union all select 'ER+RR - ER', e, r from p union all select 'ER+RR - Native', n, r from p), o as (select contrast, count(*) as k, sum((a is null or b is null)::int) as missing from d group by 1) "
    "select contrast, (k - missing)::bigint as paired, missing::bigint as missing, round(x, 6) as left_mean, round(y, 6) as right_mean, round(z, 6) as delta_mean from o left join (select contrast, avg(a) as x, avg(b) as y, avg(b - a) as z from d where a is not null and b is not null group by 1) using (contrast)"
)
def paired_means(t):
    s = stats.paired_summary(_paired(t), ["contrast"], "question_type", "question_id", samples=100)
    return s.select("contrast", "paired", "missing", *[F.round(c, 6).alias(c) for c in ("left_mean", "right_mean", "delta_mean")])


@query()
def paired_summary(t):
    return stats.paired_summary(_paired(t), ["contrast"], "question_type", "question_id")


@query()
def bootstrap_spearman(t):
    return stats.bootstrap_spearman(_paired(t), ["contrast"], "question_type", "question_id", "left_value", "right_value", samples=200)


@query(
    f"with {M}, {_REL}, eg as (select least(a.original_name, b.original_name) as s, greatest(a.original_name, b.original_name) as t, count(*) as n from rel join m a on a.mention_id = x join m b on b.mention_id = y where a.original_name is not null and b.original_name is not null group by 1, 2) "
    "select round(avg(n), 6) as mean, quantile_cont(n, 0.5) as median, round(quantile_cont(n, 0.9), 6) as p90, round(quantile_cont(n, 0.95), 6) as p95, round(quantile_cont(n, 0.99), 6) as p99, max(n)::bigint as most, round(avg((n > 1)::int), 6) as share_repeated from eg"
)
def relation_stats(t):
    # counts of each value are far fewer than edges, so percentiles are taken of value and frequency
    per = named_edges(t).groupBy("n_relations").agg(F.count(F.lit(1)).alias("k"))
    p = lambda q: F.expr(f"percentile(n_relations, {q}D, k)")
    total = F.sum("k")
    return per.agg(
        F.round(F.sum(F.col("n_relations") * F.col("k")) / total, 6).alias("mean"), p(0.5).alias("median"), *[F.round(p(q), 6).alias(n) for q, n in ((0.9, "p90"), (0.95, "p95"), (0.99, "p99"))],
        F.max("n_relations").alias("most"), F.round(F.sum(F.when(F.col("n_relations") > 1, F.col("k")).otherwise(0)) / total, 6).alias("share_repeated"),
    )


@query(
    f"with {M}, {_REL}, k as (select mention_id, canonical_entity_id as c, coalesce(canonical_entity_id, 'name:' || lower(original_name), mention_id) as e from m), z as (select x, y, a.e as s, b.e as t from rel join k a on a.mention_id = x join k b on b.mention_id = y) "
    "select (select count(*) from k)::bigint as mentions, (select count(distinct e) from k)::bigint as entities, (select count(*) from (select distinct least(x, y), greatest(x, y) from z))::bigint as edges_before, (select count(*) from (select distinct least(s, t), greatest(s, t) from z where s <> t))::bigint as edges_after, "
    "(select count(*) from z where s = t and x <> y)::bigint as induced_loops, (select round(avg((c is not null)::int), 6) from k) as mapped_share"
)
def resolution_summary(t):
    k = mentions(t, "canonical_entity_id", "original_name").withColumn("e", F.coalesce("canonical_entity_id", F.concat(F.lit("name:"), F.lower("original_name")), "mention_id"))
    side = lambda c, n: k.select(F.col("mention_id").alias(c), F.col("e").alias(n))
    z = rel(t).select("x", "y").join(side("x", "s"), "x").join(side("y", "t"), "y")
    edges = lambda a, b: z.where(f"{a} <> {b}").select(F.least(a, b), F.greatest(a, b)).distinct().agg(F.count(F.lit(1)))
    one = k.agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("e").alias("entities"), F.round(F.avg(F.col("canonical_entity_id").isNotNull().cast("int")), 6).alias("mapped_share"))
    loops = z.agg(F.coalesce(F.sum(F.expr("cast(s = t and x <> y as int)")), F.lit(0)).alias("induced_loops"))
    out = one.crossJoin(edges("x", "y").toDF("edges_before")).crossJoin(edges("s", "t").toDF("edges_after")).crossJoin(loops)
    return out.select("mentions", "entities", "edges_before", "edges_after", "induced_loops", "mapped_share")


@query(
    "with r as (select pair_id, case when rationale is null then null else '{\"relationship\":\"' || case lower(trim(action)) when 'merge' then 'same_entity' when 'reject' then 'different_entity' when 'abstain' then 'uncertain' else 'other' end || '\",\"rationale\":\"' || rationale || '\"}' end as x, lower(trim(action)) as a, rationale from pair_decisions) "
    "select case when x is null then 'empty' when a is null or a not in ('merge', 'reject', 'abstain') then 'unknown_relationship' when trim(rationale) = '' then 'no_rationale' else 'none' end as problem, count(*)::bigint as n from r group by 1"
)
def judge_verdicts(t):
    a = F.lower(F.trim("action"))
    said = F.when(a == "merge", "same_entity").when(a == "reject", "different_entity").when(a == "abstain", "uncertain").otherwise("other")
    d = t("pair_decisions").select(F.when(F.col("rationale").isNotNull(), F.to_json(F.struct(said.alias("relationship"), "rationale"))).alias("x"))
    return d.select(F.coalesce(models.judge_verdict(F.col("x"))["problem"], F.lit("none")).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"with {M}, p as (select distinct original_name as n, coalesce(T, '') as t from (select original_name, lower(entity_type) as T from m where original_name is not null)) select count(*)::bigint as profiles, count(distinct n || chr(31) || t)::bigint as texts from p"
)
def embedding_requests(t):
    p = mentions(t, "original_name", "entity_type").where("original_name is not null").select("original_name", F.coalesce(F.lower("entity_type"), F.lit("")).alias("type")).distinct()
    keyed = p.withColumn("cache_key", models.cache_key(F.col("original_name"), F.col("type")))
    work = models.pending(keyed, None)
    return p.agg(F.count(F.lit(1)).alias("profiles")).crossJoin(work.agg(F.count(F.lit(1)).alias("texts")))

