"""Relations, hard negatives, model-call plans, set operations and the resolution pipeline."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import models, relations, retrieval, selection, stats
from . import pipeline
from .q_graph import _EDGE, _REL, named_edges
from .q_graph import relations as rel
from .q_metrics import _answers, _rank_rows, _retrievals
from .q_text import _BM25, mentions
from .registry import A, M, R, query


@query(
    f"with {M}, {_REL}, z as (select rel.chunk_id, lower(a.original_name) as s, lower(b.original_name) as t, relation_id, coalesce(b.entity_type, '') as k from rel join m a on a.mention_id = x join m b on b.mention_id = y where a.original_name is not null and b.original_name is not null and lower(a.original_name) <> lower(b.original_name)), "
    "f as (select chunk_id, least(s, t) as l, greatest(s, t) as r, count(*)::bigint as n_relations, arg_min(s, relation_id) as source, arg_min(t, relation_id) as target from z group by 1, 2, 3), "
    "w as (select chunk_id, least(s, t) as l, greatest(s, t) as r, lower(k) as lk, min(relation_id) as p, arg_min(k, relation_id) as k from z group by 1, 2, 3, 4), g as (select chunk_id, l, r, string_agg(k, '|' order by p) as keywords from w group by 1, 2, 3) "
    "select chunk_id, source, target, n_relations, keywords from f join g using (chunk_id, l, r)"
)
def coalesce_relations(t):
    n = mentions(t, "original_name", "entity_type").where("original_name is not null")
    r = rel(t).join(n.select(F.col("mention_id").alias("x"), F.lower("original_name").alias("s")), "x").join(n.select(F.col("mention_id").alias("y"), F.lower("original_name").alias("t"), F.coalesce("entity_type", F.lit("")).alias("k")), "y")
    return relations.coalesce_relations(r, ["chunk_id"], "s", "t", "k", "relation_id")


@query(
    f"with {M}, {_REL}, {_EDGE}, b as (select source as node, target as neighbour from eg where source <> target union select target, source from eg where source <> target) select node, count(*)::bigint as neighbours, min(neighbour) as first_neighbour from b group by 1"
)
def profile_neighbours(t):
    return relations.neighbours(named_edges(t), "source", "target").groupBy("node").agg(F.count(F.lit(1)).alias("neighbours"), F.min("neighbour").alias("first_neighbour"))


@query(
    f"with {M}, {_REL}, {_EDGE}, z as (select source as n from eg union all select target from eg), h as (select n from (select n, count(*) as k from z group by 1) order by k desc, n limit 10), b as (select source, target, weight from eg union all select target, source, weight from eg) "
    "select source as seed, target as node, weight from (select *, row_number() over (partition by source order by weight desc, target) as k from b where source in (select n from h) and source <> target) where k <= 5"
)
def neighbourhood_expand(t):
    e = named_edges(t)
    ends = e.select(F.col("source").alias("n")).unionByName(e.select(F.col("target").alias("n")))
    hubs = ends.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "n").limit(10)
    return relations.expand(e, hubs, "n", 5)


_ASKED = _BM25.replace("(select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from eval_items)", "(select question_id as item_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from questions)")
_WORDS = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"with {_ASKED}, go as (select distinct question_id, doc_id from (select question_id, unnest(gold_document_ids) as document_id from questions) join documents using (document_id)), "
    f"an as (select question_id, {_WORDS.format('gold_answer')} as p from questions where lower(trim(gold_answer)) not in ('yes', 'no', 'insufficient information', 'insufficient information.')), "
    f"dw as (select doc_id, ' ' || {_WORDS.format('text')} || ' ' as w from documents), "
    "el as (select item_id as question_id, sc.doc_id, round(score, 6) as score from sc left join go on go.question_id = item_id and go.doc_id = sc.doc_id left join an on an.question_id = item_id join dw on dw.doc_id = sc.doc_id "
    "where score > 0 and go.doc_id is null and not coalesce(p <> '' and contains(w, ' ' || p || ' '), false)) "
    "select question_id, doc_id, score from (select *, row_number() over (partition by question_id order by score desc, doc_id) as k from el) where k <= 3"
)
def hard_negative_eligibility(t):
    return selection.hard_negatives(*eligible(t), "question_id", "doc_id", 3).select("question_id", "doc_id", "score")


def eligible(t):
    """Scores of questions and documents, gold documents, and documents of whole texts that hold the answer."""
    q = t("questions").select("question_id", "question", "gold_answer", "gold_document_ids")
    d = t("documents").select("doc_id", "document_id", "text")
    asked = retrieval.term_counts(q, "question_id", "question")
    s = retrieval.bm25(retrieval.bm25_index(d, "doc_id", "text", asked), "doc_id", q, "question_id", "question").withColumn("score", F.round("score", 6))
    gold = q.select("question_id", F.explode("gold_document_ids").alias("document_id")).join(d.select("document_id", "doc_id"), "document_id")
    return s, gold, selection.answer_holders(d, "doc_id", "text", q, "question_id", "gold_answer")


@query(f"with {R} select retrieval_outcome, case when retrieval_outcome = 'failure' then 'skipped_upstream_failure' else 'call' end as answer_action, count(*)::bigint as n from r group by 1, 2")
def answer_control(t):
    return models.answer_control(_retrievals(t)).groupBy("retrieval_outcome", "answer_action").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {R}, {A}, q as (select distinct question_id, builder_model, graph_regime from r), d as (select distinct question_id, builder_model, graph_regime from a where lower(trim(answer_outcome)) = 'success') select builder_model as builder, count(*)::bigint as pending from (select * from q except select * from d) group by 1")
def judge_cache_work(t):
    r = _retrievals(t).withColumn("cache_key", models.cache_key(F.col("question_id"), F.col("builder"), F.col("regime")))
    done = _answers(t).where("outcome = 'success'").withColumn("cache_key", models.cache_key(F.col("question_id"), F.col("builder"), F.col("regime")))
    return models.pending(r, done).groupBy("builder").agg(F.count(F.lit(1)).alias("pending"))


@query(
    f"with {M} select chunk_id, mention_id, printf('%s:mention:%05d', chunk_id, row_number() over (partition by chunk_id order by mention_id) - 1) as dense_id from m where chunk_id is not null"
)
def dense_index_ids(t):
    n = F.row_number().over(Window.partitionBy("chunk_id").orderBy("mention_id")) - 1
    return mentions(t, "chunk_id").where("chunk_id is not null").select("chunk_id", "mention_id", F.format_string("%s:mention:%05d", "chunk_id", n).alias("dense_id"))


@query(
    "with a as (select distinct document_id from chunks), b as (select distinct unnest(gold_document_ids) as document_id from questions) select 'both' as kind, count(*)::bigint as n from (select * from a intersect select * from b) union all select 'only chunked', count(*) from (select * from a except select * from b) union all select 'only gold', count(*) from (select * from b except select * from a)"
)
def set_operations(t):
    a = t("chunks").select("document_id").distinct()
    b = t("questions").select(F.explode("gold_document_ids").alias("document_id")).distinct()
    n = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("both", a.intersect(b)).unionByName(n("only chunked", a.subtract(b))).unionByName(n("only gold", b.subtract(a)))


@query(f"with {M} select json_valid(provenance) as json_valid, coalesce(json_valid(provenance) and json_type(provenance) = 'OBJECT' and json_extract_string(provenance, '$.builder') is not null, false) as schema_valid, count(*)::bigint as n from m where provenance is not null group by 1, 2")
def inspect_response(t):
    c = models.inspect_response(F.col("provenance"), ("builder",))
    return mentions(t, "provenance").where("provenance is not null").groupBy(*[v.alias(k) for k, v in c.items()]).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {M} select mention_id, sha256(to_json({{'description': description, 'name': original_name}})) as profile_hash from m")
def embedding_profile_text(t):
    m = mentions(t, "original_name", "description")
    text = F.to_json(F.struct("description", F.col("original_name").alias("name")), {"ignoreNullFields": "false"})
    return m.select("mention_id", F.sha2(text, 256).alias("profile_hash"))


@query()
def bootstrap_by_regime(t):
    v = _rank_rows(t).groupBy("regime", "question_type", "question_id").agg(F.avg("reciprocal_rank").alias("v"))
    return stats.bootstrap_mean(v, ["regime"], "question_type", "question_id", "v")


@query()
def resolution_pipeline_gates(t):
    m = mentions(t, "original_name", "document_id", "chunk_id", "entity_type", "description")
    e = named_edges(t).withColumn("relation", F.col("n_relations").cast("string"))
    return pipeline.resolution_gates(pipeline.resolve_entities(m, vectors=name_vectors(t), edges=e))


def name_vectors(t):
    """The usable vector of the first mention of each name."""
    usable = "size(embedding) = 32 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    m = mentions(t, "original_name", "embedding").where("original_name is not null").where(usable)
    return m.groupBy("original_name").agg(F.min_by("embedding", "mention_id").alias("embedding"))


@query(f"with {A} select case when raw_answer is null then 'none' when length(raw_answer) > 40 then 'long' else 'short' end as kind, count(*)::bigint as n, count(distinct substr(sha256(coalesce(raw_answer, '')), 1, 16))::bigint as texts from a group by 1")
def answer_texts(t):
    kind = F.when(F.col("raw_answer").isNull(), "none").when(F.length("raw_answer") > 40, "long").otherwise("short")
    return _answers(t).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(T.text_id("", F.coalesce("raw_answer", F.lit("")))).alias("texts"))
