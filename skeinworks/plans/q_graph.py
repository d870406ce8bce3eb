"""Graph construction, topology, recovery of missing relations and integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import gates, graph, joins
from ..operators import resolution as ER
from .q_resolution import decisions
from .q_text import mentions
from .registry import M, query

# relations: mentions that follow each other in a chunk, by id
_REL = (
    "rel as (select 'rel_' || x as relation_id, chunk_id, x, y, w from (select chunk_id, mention_id as x, lead(mention_id) over (partition by chunk_id order by mention_id) as y, length(coalesce(description, '')) % 3 as w from m) where y is not null)"
)
_EDGE = (
    "eg as (select least(a.original_name, b.original_name) as source, greatest(a.original_name, b.original_name) as target, sum(case when w = 0 then 1 else w end)::bigint as weight, count(*)::bigint as n_relations "
    "from rel join m a on a.mention_id = x join m b on b.mention_id = y where a.original_name is not null and b.original_name is not null group by 1, 2)"
)


def relations(t):
    m = mentions(t, "chunk_id", "description")
    w = Window.partitionBy("chunk_id").orderBy("mention_id")
    r = m.select("chunk_id", F.col("mention_id").alias("x"), F.lead("mention_id").over(w).alias("y"), (F.length(F.coalesce("description", F.lit(""))) % 3).cast("long").alias("w"))
    return r.where("y is not null").withColumn("relation_id", F.concat(F.lit("rel_"), "x"))


def named_edges(t):
    n = mentions(t, "original_name").where("original_name is not null")
    r = relations(t).join(n.select(F.col("mention_id").alias("x"), F.col("original_name").alias("a")), "x").join(n.select(F.col("mention_id").alias("y"), F.col("original_name").alias("b")), "y")
    return graph.edge_dedup(r, "a", "b", "w", "relation_id").select("source", "target", "weight", "n_relations")


@query(f"with {M}, {_REL}, {_EDGE} select * from eg")
def edge_dedup(t):
    return named_edges(t)


@query(
    f"with {M}, {_REL}, k as (select mention_id, coalesce(canonical_entity_id, 'name:' || lower(original_name), mention_id) as e from m), z as (select least(a.e, b.e) as source, greatest(a.e, b.e) as target, w from rel join k a on a.mention_id = x join k b on b.mention_id = y where a.e <> b.e) "
    "select source, target, sum(case when w = 0 then 1 else w end)::bigint as weight, count(*)::bigint as n_relations from z group by 1, 2"
)
def rewrite_graph(t):
    k = mentions(t, "canonical_entity_id", "original_name").select("mention_id", F.coalesce("canonical_entity_id", F.concat(F.lit("name:"), F.lower("original_name")), "mention_id").alias("e"))
    r = graph.rewrite_edges(relations(t), "x", "y", k, "mention_id", "e")
    return graph.edge_dedup(r, "source_entity", "target_entity", "w", "relation_id").select("source", "target", "weight", "n_relations")


@query(
    f"with {M}, k as (select coalesce(canonical_entity_id, 'name:' || lower(original_name), mention_id) as e, mention_id, document_id, original_name, description from m) "
    "select e as entity, count(*)::bigint as mentions, count(distinct document_id)::bigint as documents, count(distinct original_name)::bigint as names, max(length(description))::int as longest from k group by 1"
)
def node_aggregate(t):
    k = mentions(t, "canonical_entity_id", "original_name", "document_id", "description").withColumn("entity", F.coalesce("canonical_entity_id", F.concat(F.lit("name:"), F.lower("original_name")), "mention_id"))
    return k.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("document_id").alias("documents"), F.countDistinct("original_name").alias("names"), F.max(F.length("description")).alias("longest"))


@query(
    f"with recursive {M}, {_REL}, {_EDGE}, d as (select source, target from eg where source <> target), e as (select source as a, target as b from d union select target, source from d), "
    "w(node, c) as (select distinct a, a from e union select e.b, w.c from w join e on e.a = w.node and w.c < e.b) select node, min(c) as component from w group by 1"
)
def connected_components(t):
    return graph.components(named_edges(t))


@query(
    f"with recursive {M}, {_REL}, {_EDGE}, d as (select source, target from eg where source <> target), e as (select source as a, target as b from d union select target, source from d), "
    "w(node, c) as (select distinct a, a from e union select e.b, w.c from w join e on e.a = w.node and w.c < e.b), k as (select node, min(c) as c from w group by 1), n as (select distinct original_name as x from m where original_name is not null), "
    "s as (select coalesce(c, x) as c, count(*) as s, max((c is null)::int) as lone from n left join k on node = x group by 1), t as (select count(*) as edges, sum((source = target)::int) as loops, sum((source <> target)::int) as simple from eg) "
    "select sum(s)::bigint as nodes, edges::bigint as edges, count(*)::bigint as components, sum(lone)::bigint as isolates, max(s)::bigint as largest_component, loops::bigint as loops, round(2 * edges / sum(s), 6) as average_degree, round(2 * simple / (sum(s) * (sum(s) - 1)), 6) as density from s, t group by edges, loops, simple"
)
def graph_topology(t):
    e = named_edges(t)
    n = mentions(t, "original_name").where("original_name is not null")
    return graph.topology(n, "original_name", e, "source", "target")


@query(
    f"with {M}, {_REL}, {_EDGE}, z as (select source as n from eg union all select target from eg), d as (select n, count(*) as k from z group by 1) select original_name, coalesce(k, 0)::bigint as degree from (select distinct original_name from m where original_name is not null) left join d on n = original_name"
)
def node_degrees(t):
    return graph.degrees(mentions(t, "original_name").where("original_name is not null"), "original_name", named_edges(t), "source", "target")


@query(
    f"with {M}, {_REL}, {_EDGE}, z as (select source as n from eg union all select target from eg), d as (select n, count(*)::bigint as degree from z group by 1) select n as name, degree from d order by degree desc, n limit 20"
)
def graph_hubs(t):
    d = graph.degrees(mentions(t, "original_name").where("original_name is not null"), "original_name", named_edges(t), "source", "target")
    return d.orderBy(F.desc("degree"), "original_name").limit(20).select(F.col("original_name").alias("name"), "degree")


@query(
    f"with {M}, {_REL}, {_EDGE}, z as (select source as n from eg union all select target from eg), d as (select n, count(*)::bigint as v from z group by 1), g as (select v, count(*)::bigint as n from d group by 1) select v as value, n, round(sum(n) over (order by v desc) / sum(n) over (), 6) as share from g"
)
def degree_ccdf(t):
    d = graph.degrees(mentions(t, "original_name").where("original_name is not null"), "original_name", named_edges(t), "source", "target")
    return graph.ccdf(d, "degree")


@query(
    f"with {M}, {_REL}, {_EDGE}, z as (select source as n from eg union all select target from eg), d as (select n, count(*) as k from z group by 1) "
    "select round(avg(k), 6) as mean, median(k)::double as median, round(quantile_cont(k, 0.9), 6) as p90, round(quantile_cont(k, 0.99), 6) as p99, max(k)::bigint as maximum, round(avg((k > 1)::int), 6) as share_over_one from d"
)
def degree_stats(t):
    d = graph.degrees(mentions(t, "original_name").where("original_name is not null"), "original_name", named_edges(t), "source", "target").where("degree > 0")
    q = lambda p: F.round(F.percentile("degree", F.lit(p)), 6)
    return d.agg(F.round(F.avg("degree"), 6).alias("mean"), F.median("degree").alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("degree").alias("maximum"), F.round(F.avg((F.col("degree") > 1).cast("int")), 6).alias("share_over_one"))


_PART = (
    "pe as (select distinct least(a.l_partkey, b.l_partkey) as source, greatest(a.l_partkey, b.l_partkey) as target from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)"
)


def part_edges(t):
    li = t("lineitem").select("l_orderkey", "l_partkey").distinct()
    pairs = li.withColumnRenamed("l_partkey", "source").join(li.withColumnRenamed("l_partkey", "target"), "l_orderkey").where("source < target")
    return pairs.select("source", "target").distinct()


@query(
    f"with {_PART}, z as (select source as n from pe union all select target from pe), d as (select n, count(*) as k from z group by 1), tr as (select count(*) as triangles from pe x join pe y on x.target = y.source join pe w on w.source = x.source and w.target = y.target) "
    "select triangles::bigint as triangles, (select sum(k * (k - 1) / 2)::bigint from d) as triads, round(3.0 * triangles / (select sum(k * (k - 1) / 2) from d), 6) as transitivity from tr"
)
def transitivity(t):
    return graph.transitivity(part_edges(t), "source", "target")


@query(
    f"with {M}, x as (select distinct builder_model as g, original_name as i from m where original_name is not null), s as (select g, count(*) as n from x group by 1), b as (select a.g as l, b.g as r, count(*) as k from x a join x b using (i) where a.g <= b.g group by 1, 2) "
    "select p.g as left_group, q.g as right_group, coalesce(k, 0)::bigint as shared, round(coalesce(k, 0) / (p.n + q.n - coalesce(k, 0)), 6) as jaccard from s p join s q on p.g <= q.g left join b on b.l = p.g and b.r = q.g"
)
def jaccard_matrix(t):
    return graph.jaccard_matrix(mentions(t, "builder_model", "original_name"), "builder_model", "original_name")


@query(
    f"with {M}, x as (select distinct builder_model as g, original_name as i from m where original_name is not null), s as (select g, count(*) as n from x group by 1), b as (select a.g as l, b.g as r, count(*) as k from x a join x b using (i) where a.g < b.g group by 1, 2), "
    "j as (select p.g as l, q.g as r, coalesce(k, 0) / (p.n + q.n - coalesce(k, 0)) as v from s p join s q on p.g < q.g left join b on b.l = p.g and b.r = q.g) "
    "select split_part(l, '_', 1) = split_part(r, '_', 1) as same_family, count(*)::bigint as pairs, round(avg(round(v, 6)), 5) as mean_jaccard from j group by 1"
)
def pairwise_similarity(t):
    j = graph.jaccard_matrix(mentions(t, "builder_model", "original_name"), "builder_model", "original_name").where("left_group < right_group")
    fam = lambda c: F.substring_index(c, "_", 1)
    return j.groupBy((fam("left_group") == fam("right_group")).alias("same_family")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("jaccard"), 5).alias("mean_jaccard"))


@query(
    "with n as (select left_mention_id as n from pair_decisions union all select right_mention_id from pair_decisions), e as (select left_mention_id as x, right_mention_id as y from pair_decisions), k as (select distinct mention_id from mentions) "
    "select 'blank_nodes' as check_name, (select count(*) from n where n is null or trim(n) = '')::bigint as violations union all select 'dangling_ends', (select count(*) from n where n is null or n not in (select mention_id from k))::bigint "
    "union all select 'duplicate_edges', (select count(*) from (select least(x, y), greatest(x, y) from e group by 1, 2 having count(*) > 1))::bigint union all select 'duplicate_nodes', (select count(*) from (select mention_id from mentions group by 1 having count(*) > 1))::bigint "
    "union all select 'loops', (select count(*) from e where x = y)::bigint"
)
def integrity_checks(t):
    p = t("pair_decisions")
    e = p.select(F.col("left_mention_id").alias("x"), F.col("right_mention_id").alias("y"))
    out = graph.integrity(t("mentions").select("mention_id"), "mention_id", e, "x", "y").where("check_name <> 'blank_nodes'")
    ends = e.select(F.col("x").alias("n")).unionByName(e.select(F.col("y").alias("n")))
    return out.unionByName(ends.where("n is null or trim(n) = ''").agg(F.count(F.lit(1)).alias("violations")).select(F.lit("blank_nodes").alias("check_name"), "violations"))


@query(
    f"with {M}, g as (select distinct chunk_id, lower(original_name) as i from m where original_name is not null), {_REL}, ke as (select distinct least(lower(a.original_name), lower(b.original_name)) as l, greatest(lower(a.original_name), lower(b.original_name)) as r from rel join m a on a.mention_id = x join m b on b.mention_id = y) "
    "select a.chunk_id, count(*)::bigint as missing from g a join g b on a.chunk_id = b.chunk_id and a.i < b.i left join ke on ke.l = a.i and ke.r = b.i where ke.l is null group by 1"
)
def antijoin_missing_pairs(t):
    m = mentions(t, "chunk_id", "original_name").where("original_name is not null").withColumn("i", F.lower("original_name"))
    e = named_edges(t).select(F.lower("source").alias("a"), F.lower("target").alias("b"))
    return joins.missing_pairs(m, "chunk_id", "i", e, "a", "b").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("missing"))


@query(
    f"with {M}, {_REL}, {_EDGE}, g as (select distinct chunk_id, original_name as i from m where original_name is not null) select a.chunk_id, count(*)::bigint as local_edges, sum(weight)::bigint as weight from eg join g a on a.i = source join g b on b.i = target and b.chunk_id = a.chunk_id where source <> target group by 1"
)
def semijoin_local_edges(t):
    m = mentions(t, "chunk_id", "original_name").where("original_name is not null")
    e = named_edges(t).where("source <> target")
    return joins.local_edges(e, "source", "target", m, "chunk_id", "original_name").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("local_edges"), F.sum("weight").alias("weight"))


@query(
    f"with {M}, g as (select distinct chunk_id, original_name as i from m where original_name is not null), s as (select chunk_id, count(*) as n from g group by 1) select chunk_id, n::bigint as entities, (n * (n - 1) / 2)::bigint as possible_pairs, n >= 2 as eligible, "
    "sha256(array_to_string(list_sort(list(i)), chr(10))) as candidate_set from s join g using (chunk_id) group by chunk_id, n"
)
def recovery_plan(t):
    g = mentions(t, "chunk_id", "original_name").where("original_name is not null").groupBy("chunk_id").agg(F.array_sort(F.collect_set("original_name")).alias("i"))
    n = F.size("i").cast("long")
    return g.select("chunk_id", n.alias("entities"), F.expr("cast(size(i) as bigint) * (size(i) - 1) div 2").alias("possible_pairs"), (n >= 2).alias("eligible"), F.sha2(F.array_join("i", "\n"), 256).alias("candidate_set"))


@query(
    f"with {M}, {_REL}, z as (select least(a.original_name, b.original_name) as source, greatest(a.original_name, b.original_name) as target, a.chunk_id from rel join m a on a.mention_id = x join m b on b.mention_id = y where a.original_name < b.original_name or b.original_name < a.original_name) "
    "select source, target, count(*)::bigint as weight, count(distinct chunk_id)::bigint as chunks, min(chunk_id) as first_chunk from z group by 1, 2"
)
def recovered_edges(t):
    n = mentions(t, "original_name", "chunk_id")
    r = relations(t).select("x", "y").join(n.select(F.col("mention_id").alias("x"), F.col("original_name").alias("a"), "chunk_id"), "x").join(n.select(F.col("mention_id").alias("y"), F.col("original_name").alias("b")), "y")
    z = r.where("a <> b").select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "chunk_id")
    return z.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), F.countDistinct("chunk_id").alias("chunks"), F.min("chunk_id").alias("first_chunk"))


@query(
    f"with {M} select canonical_entity_id, count(distinct m.chunk_id)::bigint as chunks, count(distinct k.document_id)::bigint as documents, count(distinct case when k.chunk_id is null then m.chunk_id end)::bigint as unresolved from m left join (select distinct chunk_id, document_id from chunks) k using (chunk_id) where canonical_entity_id is not null group by 1"
)
def provenance_documents(t):
    k = t("chunks").select("chunk_id", F.col("document_id").alias("d")).distinct()
    m = mentions(t, "canonical_entity_id", "chunk_id").where("canonical_entity_id is not null").select("canonical_entity_id", "chunk_id").distinct()
    j = m.join(k, "chunk_id", "left")
    return j.groupBy("canonical_entity_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("d").alias("documents"), F.countDistinct(F.when(F.col("d").isNull(), F.col("chunk_id"))).alias("unresolved"))


@query(
    "with v as (select builder_key, regime, max(retrieval_latency_mean_s) as v from request_efficiency_by_builder_and_regime group by 1, 2), p as (select builder_key, max(case when regime = 'Native' then v end) as a, max(case when regime = 'ER+RR' then v end) as b from v group by 1) "
    "select builder_key, round(a, 6) as left_value, round(b, 6) as right_value, round(b - a, 6) as change, round(100 * (b - a) / nullif(a, 0), 6) as percent from p"
)
def paired_graph_change(t):
    v = t("request_efficiency_by_builder_and_regime").groupBy("builder_key", "regime").agg(F.max("retrieval_latency_mean_s").alias("v"))
    c = graph.paired_change(v, ["builder_key"], "regime", "Native", "ER+RR", "v")
    return c.select("builder_key", *[F.round(x, 6).alias(x) for x in ("left_value", "right_value", "change", "percent")])


@query(
    "with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings), q as (select * from e where vec_id % 20 = 0), s as (select q.vec_id as left_id, e.vec_id as right_id, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(e.v, e.v)), 6) as cosine from q join e on q.vec_id <> e.vec_id) "
    "select left_id, right_id, cosine, rank::int as rank from (select *, row_number() over (partition by left_id order by cosine desc, right_id) as rank from s) where rank <= 10"
)
def exact_cosine_knn(t):
    from ..operators import vectors

    e = t("embeddings").select("vec_id", "embedding")
    return vectors.exact_knn(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)


_KNN = (
    "e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select q.vec_id as left_id, e.vec_id as right_id, "
    "round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(e.v, e.v)), 6) as cosine from e q join e on q.vec_id <> e.vec_id), "
    "k as (select left_id, right_id, cosine, rank::int as rank from (select *, row_number() over (partition by left_id order by cosine desc, right_id) as rank from s) where rank <= 10)"
)


@query(f"with {_KNN} select * from k")
def lsh_knn(t):
    from ..operators import vectors

    return vectors.block_knn(t("embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 64, 10)


@query(f"with {_KNN} select a.left_id, a.right_id, a.cosine, (a.cosine + 1) / 2 as signal from k a join k b on a.left_id = b.right_id and a.right_id = b.left_id where a.left_id < a.right_id")
def reciprocal_neighbours(t):
    from ..operators import vectors

    k = vectors.block_knn(t("embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 64, 10)
    return vectors.reciprocal(k)


_GATE = (
    "select 'expected_document_set' as check_name, (case when (select count(*) from documents) = 0 then 1 else 0 end)::bigint as violations union all "
    "select 'stable_chunk_ids_unique', (select count(*) from (select chunk_id from chunks group by 1 having count(*) > 1 or chunk_id is null or trim(chunk_id) = ''))::bigint union all "
    "select 'complete_document_snapshot', (select count(*) from (select distinct document_id from documents) d full join (select distinct document_id from chunks) c using (document_id) where d.document_id is null or c.document_id is null)::bigint union all "
    "select 'mention_ids_unique', (select count(*) from (select mention_id from mentions group by 1 having count(*) > 1))::bigint union all "
    "select 'mention_chunks_known', (select count(*) from (select distinct mention_id, chunk_id from mentions) m where chunk_id is null or chunk_id not in (select chunk_id from chunks where chunk_id is not null))::bigint union all "
    "select 'pair_sides_known', (select count(*) from (select pair_id, unnest([left_mention_id, right_mention_id]) as m from pair_decisions) where m is null or m not in (select mention_id from mentions))::bigint union all "
    "select 'pair_actions_valid', (select count(*) from pair_decisions where action is null or lower(trim(action)) not in ('merge', 'reject', 'abstain'))::bigint union all "
    "select 'pair_scores_in_range', (select count(*) from pair_decisions where score is null or score < 0 or score > 1)::bigint union all "
    "select 'blocked_triggers_known', (select count(*) from blocked_merges where trigger_pair_id is null or trigger_pair_id not in (select pair_id from pair_decisions where pair_id is not null))::bigint union all "
    "select 'answers_have_retrievals', (select count(*) from (select distinct answer_result_id, retrieval_result_id from answers) a where retrieval_result_id is null or retrieval_result_id not in (select retrieval_result_id from retrievals))::bigint union all "
    "select 'gold_documents_known', (select count(*) from (select unnest(gold_document_ids) as d from questions) where d not in (select document_id from documents))::bigint union all "
    "select 'token_counts_match', (select count(*) from chunks where token_count is null or token_count <> len(regexp_extract_all(content, '[^ \\t\\n]+')))::bigint"
)


@query(_GATE)
def quality_gates(t):
    return gates.snapshot_gates(t)
