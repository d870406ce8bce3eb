"""Scalar text functions, identities and text retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as N
from ..functions import json_repair
from ..functions import text as T
from ..operators import latest, retrieval
from .registry import A, M, collapsed, query


def mentions(t, *cols):
    return latest.latest(t("mentions").select("mention_id", "ingested_at", *cols), ["mention_id"], [F.desc("ingested_at")]).drop("ingested_at")


def _in(names):
    return ", ".join(f"'{x}'" for x in names)


@query(f"with {M} select lower(trim(regexp_replace(entity_type, '\\s+', ' ', 'g'))) as label, count(*)::bigint as n from m where entity_type is not null group by 1")
def normalize_label(t):
    return mentions(t, "entity_type").where("entity_type is not null").groupBy(T.normalize_label(F.col("entity_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "with n as (select distinct original_name from mentions where original_name is not null) select original_name, trim(regexp_replace(lower(original_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')) as lexical from n"
)
def lexical_view(t):
    n = t("mentions").select("original_name").where("original_name is not null").distinct()
    return n.select("original_name", T.lexical_view(F.lower("original_name")).alias("lexical"))


_CASES = " ".join(f"when '{k}' then '{v}'" for k, v in T.TYPE_ALIASES.items())


@query(
    f"with {M}, l as (select nullif(trim(regexp_replace(lower(entity_type), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), '') as x from m), "
    f"f as (select x, case x {_CASES} end as whole, list_filter(list_transform(string_split(x, ' '), lambda t: case t {_CASES} end), lambda y: y is not null)[1] as part from l) "
    "select coalesce(whole, part, x) as family, count(*)::bigint as n from f group by 1"
)
def entity_type_family(t):
    return mentions(t, "entity_type").groupBy(T.type_family(F.col("entity_type")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "with n as (select distinct trim(regexp_replace(lower(original_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')) as x from mentions where original_name is not null), "
    "s as (select x, list_filter(string_split(x, ' '), lambda w: w <> '') as w from n) select array_to_string(list_transform(w, lambda y: substr(y, 1, 1)), '') as acronym, count(*)::bigint as names from s where len(w) >= 2 group by 1"
)
def name_acronyms(t):
    n = t("mentions").where("original_name is not null").select(T.lexical_view(F.lower("original_name")).alias("x")).distinct()
    return n.select(T.acronym(F.col("x")).alias("acronym")).where("acronym is not null").groupBy("acronym").agg(F.count(F.lit(1)).alias("names"))


@query(
    f"with {M}, k as (select mention_id, list_filter(list_transform(regexp_split_to_array(description, '[,;|]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') as l from m where description is not null) "
    "select mention_id, len(list_distinct(list_transform(l, lambda x: lower(x))))::int as n_keywords, l[1] as first_keyword from k"
)
def keywords_split(t):
    k = mentions(t, "description").where("description is not null").select("mention_id", T.keywords_split(F.col("description")).alias("l"))
    return k.select("mention_id", F.size("l").alias("n_keywords"), F.get("l", F.lit(0)).alias("first_keyword"))


@query(
    f"with {M}, p as (select coalesce(parse_status, '(none)') as declared, case when provenance is null or trim(provenance) = '' then 'no_response' when json_valid(provenance) and json_type(provenance) = 'OBJECT' then 'strict' else 'other' end as status from m) "
    "select declared, status, count(*)::bigint as n from p group by 1, 2"
)
def recover_json(t):
    m = mentions(t, "parse_status", "provenance").select(F.coalesce("parse_status", F.lit("(none)")).alias("declared"), "provenance")
    got = json_repair.recover_json(m, "provenance", "st", "parsed")
    return got.groupBy("declared", F.when(F.col("st").isin("strict", "no_response"), F.col("st")).otherwise("other").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "select distinct chunk_id, 'cut_' || substr(sha256('\"' || document_id || '\"' || chr(31) || '\"' || chunk_id || '\"'), 1, 24) as joined, "
    "'arr_' || substr(sha256('[\"' || document_id || '\",\"' || chunk_id || '\"]'), 1, 24) as listed, "
    "'idx_' || substr(sha256('[{\"index\":0,\"value\":\"' || document_id || '\"},{\"index\":1,\"value\":\"' || chunk_id || '\"}]'), 1, 24) as indexed, "
    "'txt_' || substr(sha256(content), 1, 16) as plain from chunks"
)
def stable_ids(t):
    d, c = F.col("document_id"), F.col("chunk_id")
    return t("chunks").select("chunk_id", T.joined_id("cut_", d, c).alias("joined"), T.array_id("arr_", d, c).alias("listed"), T.indexed_id("idx_", d, c).alias("indexed"), T.text_id("txt_", F.col("content")).alias("plain")).distinct()


@query(
    f"with {M} select mention_id, case when length(d) > 60 then rtrim(substr(d, 1, 59)) || '…' else d end as bounded, filled from (select mention_id, coalesce(nullif(trim(regexp_replace(description, '^\\s+|\\s+$', '', 'g')), ''), 'No description of ' || coalesce(original_name, '?')) as d, nullif(trim(regexp_replace(description, '^\\s+|\\s+$', '', 'g')), '') is null as filled from m)"
)
def placeholder_fill(t):
    m = mentions(t, "description", "original_name")
    d = T.placeholder_fill(F.col("description"), F.concat(F.lit("No description of "), F.coalesce("original_name", F.lit("?"))))
    return m.select("mention_id", T.bounded_text(d, 60).alias("bounded"), T.blank_to_null(F.col("description")).isNull().alias("filled"))


@query("select strftime(published_at, '%Y-%m') as month, coalesce(category, 'unknown') as category, count(*)::bigint as documents, sum(n_chars)::bigint as chars from documents group by 1, 2")
def publication_distribution(t):
    d = t("documents").select(F.date_format("published_at", "yyyy-MM").alias("month"), F.coalesce("category", F.lit("unknown")).alias("category"), "n_chars")
    return d.groupBy("month", "category").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@query(
    "with o as (select n_chars, row_number() over (order by n_chars, doc_id) - 1 as i, count(*) over () as n from documents), c as (select max(case when i = n // 3 then n_chars end) as a, max(case when i = 2 * n // 3 then n_chars end) as b from o) "
    "select case when n_chars < a then 'short' when n_chars < b then 'medium' else 'long' end as bin, count(*)::bigint as documents from documents, c group by 1"
)
def length_tertiles(t):
    d = t("documents").select("n_chars")
    # counts of each length are far fewer than documents; their running sums find the values at both places
    per = d.groupBy("n_chars").agg(F.count(F.lit(1)).alias("k"))
    run = per.selectExpr("n_chars", "sum(k) over (order by n_chars) as upto", "sum(k) over () as n")
    at = run.agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 3), F.col("n_chars"))).alias("a"), F.min(F.when(F.col("upto") > F.floor(2 * F.col("n") / 3), F.col("n_chars"))).alias("b"))
    bin_ = F.when(F.col("n_chars") < F.col("a"), "short").when(F.col("n_chars") < F.col("b"), "medium").otherwise("long")
    return per.crossJoin(F.broadcast(at)).groupBy(bin_.alias("bin")).agg(F.sum("k").alias("documents"))


@query(
    "with u as (select d, count(*) as n from (select unnest(retrieved_document_ids) as d from (select distinct on (retrieval_result_id) * from retrievals order by retrieval_result_id, retrieved_at desc)) group by 1) "
    "select case when n <= 2 then '1-2' when n <= 9 then '3-9' when n <= 49 then '10-49' else '50+' end as bin, count(*)::bigint as documents from u group by 1"
)
def reuse_bins(t):
    r = latest.latest(t("retrievals").select("retrieval_result_id", "retrieved_at", "retrieved_document_ids"), ["retrieval_result_id"], [F.desc("retrieved_at")])
    u = r.select(F.explode("retrieved_document_ids").alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return u.groupBy(T.reuse_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("documents"))


_STOP = _in(T.STOPWORDS)


@query(f"select term, count(*)::bigint as n from (select unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) where length(term) > 1 and term not in ({_STOP}) group by 1")
def lexical_tokens(t):
    return t("documents").select(F.explode(T.lexical_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "with p as (select question_id, gold_answer, unnest(gold_document_ids) as document_id from questions) select question_id, document_id, coalesce(lower(trim(gold_answer)) not in ('yes', 'no', 'insufficient information', 'insufficient information.') and "
    "trim(regexp_replace(lower(gold_answer), '[^a-z0-9]+', ' ', 'g')) <> '' and contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(gold_answer), '[^a-z0-9]+', ' ', 'g')) || ' '), false) as present from p join documents using (document_id)"
)
def direct_answer_present(t):
    p = t("questions").select("question_id", "gold_answer", F.explode("gold_document_ids").alias("document_id"))
    return p.join(t("documents").select("document_id", "text"), "document_id").select("question_id", "document_id", T.direct_answer_present(F.col("text"), F.col("gold_answer")).alias("present"))


_BM25 = (
    f"tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) where length(term) > 1 and term not in ({_STOP}) group by 1, 2), "
    "dl as (select doc_id, sum(tf) as dl from tf group by 1), st as (select (select count(*) from documents) as n, (select sum(dl) from dl) / (select count(*) from documents) as avgdl), "
    "df as (select term, count(*) as df from tf group by 1), "
    f"qt as (select item_id, term, count(*) as qtf from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from eval_items) where length(term) > 1 and term not in ({_STOP}) group by 1, 2), "
    "sc as (select item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) as score from qt join tf using (term) join df using (term) join dl using (doc_id), st group by 1, 2)"
)


def _scores(t):
    items = t("eval_items").select("item_id", "text")
    index = retrieval.bm25_index(t("documents").select("doc_id", "text"), "doc_id", "text", retrieval.term_counts(items, "item_id", "text"))
    return retrieval.bm25(index, "doc_id", items, "item_id", "text")


@query(f"with {_BM25} select item_id, doc_id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by item_id order by round(score, 6) desc, doc_id) as rank from sc) where rank <= 5")
def bm25_score(t):
    return retrieval.top_k(_scores(t).withColumn("score", F.round("score", 6)), "item_id", "doc_id", 5)


@query(
    f"with {_BM25} select item_id, doc_id from (select *, row_number() over (partition by item_id order by round(score, 6) desc, substr(sha256('seed' || chr(0) || item_id || chr(0) || doc_id), 1, 16), doc_id) as k from sc) where k = 1"
)
def bm25_top1_stable(t):
    s = _scores(t).withColumn("score", F.round("score", 6))
    tie = retrieval.stable_tie("seed", F.col("item_id").cast("string"), F.col("doc_id").cast("string"))
    return retrieval.top_k(s, "item_id", "doc_id", 1, tie=tie).select("item_id", "doc_id")


@query(f"with {_BM25} select item_id, term, df::bigint as df, position::int as position from (select item_id, term, count(*) over (partition by term) as df, qtf from qt) q join (select item_id as i2, term as t2, row_number() over (partition by item_id order by dq, term) as position from (select item_id, term, count(*) over (partition by term) as dq from qt)) p on q.item_id = p.i2 and q.term = p.t2 where position <= 8")
def topic_terms(t):
    return retrieval.topic_terms(retrieval.term_counts(t("eval_items").select("item_id", "text"), "item_id", "text"), "item_id")


@query(
    "with k as (select chunk_id, max(content) as content from chunks group by 1), n as (select distinct chunk_id, original_name from mentions where original_name is not null) "
    "select contains(content, original_name) as found, count(*)::bigint as n from n join k using (chunk_id) group by 1"
)
def join_substring_evidence(t):
    k = t("chunks").groupBy("chunk_id").agg(F.max("content").alias("content"))
    n = t("mentions").where("original_name is not null").select("chunk_id", "original_name").distinct()
    return n.join(k, "chunk_id").groupBy(F.contains("content", "original_name").alias("found")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "with w as (select distinct builder_model, regexp_extract(display_name || ' ' || case when trust_rank % 2 = 0 then trust_rank / 2 || 'B' else trust_rank * 90 || 'M' end, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*([BM])\\b', ['n', 'u']) as x from builder_trust), s as (select builder_model, case upper(x.u) when 'B' then x.n::double when 'M' then x.n::double / 1000 end as size from w) "
    "select builder_model, size, case when size is null then 'none' when size < 2 then 'small' else 'large' end as band from s"
)
def model_size_bands(t):
    # the labels of the table name no size, so one is added from the rank
    label = F.concat_ws(" ", "display_name", F.expr("case when trust_rank % 2 = 0 then concat(trust_rank / 2, 'B') else concat(trust_rank * 90, 'M') end"))
    w = t("builder_trust").select("builder_model", T.model_size(label).alias("size")).distinct()
    return w.withColumn("band", F.when(F.col("size").isNull(), "none").when(F.col("size") < 2, "small").otherwise("large"))


_SAID = "trim(regexp_replace(replace(replace(lower({}), '’', chr(39)), chr(39), ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(
    f"with {A}, c as (select regexp_replace({_SAID.format('raw_answer')}, '^(the )?answer (to the question )?(is|was) ', '') as p from a where raw_answer is not null) "
    f"select case when p in ({_in(sorted(N.ABSTENTIONS))}) then 'abstention' when split_part(p, ' ', 1) in ({_in(N.YES)}) then 'yes' when split_part(p, ' ', 1) in ({_in(N.NO)}) then 'no' else 'other' end as kind, count(*)::bigint as n from c group by 1"
)
def yes_no_prefixes(t):
    a = latest.latest(t("answers").select("answer_result_id", "ingested_at", "raw_answer"), ["answer_result_id"], [F.desc("ingested_at")]).where("raw_answer is not null")
    kind = F.coalesce(F.when(N.canonicalize_unanswerable("raw_answer").isNotNull(), "abstention"), N.normalize_yes_no("raw_answer"), F.lit("other"))
    return a.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select original_name, lower(replace({collapsed('original_name')}, 'ß', 'ss')) as surface from (select distinct original_name from mentions where original_name is not null)")
def surface_keys(t):
    n = t("mentions").select("original_name").where("original_name is not null").distinct()
    return n.select("original_name", T.surface_key(F.col("original_name")).alias("surface"))


@query()
def recover_json_status(t):
    """Every status of the recovery apart, with how many objects came out."""
    got = json_repair.recover_json(mentions(t, "provenance").select("provenance"), "provenance", "st", "parsed")
    return got.groupBy(F.col("st").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count("parsed").alias("objects"))
