"""Mentions, choices, candidate routes, decisions, clusters and canonical entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, latest
from ..operators import resolution as ER
from ..runtime import Stage
from .q_text import mentions
from .registry import M, collapsed, query

_D = (
    "d as (select pair_id, left_mention_id as l, right_mention_id as r, lower(trim(action)) as action, source, score from (select *, row_number() over (partition by pair_id order by decided_at desc, action, left_mention_id, right_mention_id, source, score) as k from pair_decisions "
    "where pair_id is not null and action is not null and left_mention_id is not null and right_mention_id is not null) where k = 1 and left_mention_id <> right_mention_id)"
)


def decisions(t):
    d = t("pair_decisions").dropna(subset=["pair_id", "action", "left_mention_id", "right_mention_id"])
    d = latest.latest(d, ["pair_id"], [F.desc("decided_at"), *[F.col(c).asc_nulls_last() for c in ("action", "left_mention_id", "right_mention_id", "source", "score")]]).where("left_mention_id <> right_mention_id")
    return d.select("pair_id", F.col("left_mention_id").alias("left_id"), F.col("right_mention_id").alias("right_id"), F.lower(F.trim("action")).alias("action"), "source", "score")


@query(
    f"with {M}, n as (select *, row_number() over (partition by chunk_id order by mention_id) as pos from m where original_name is not null), "
    "l as (select chunk_id, original_name, entity_type, count(*) as k, min(pos) as f from n where entity_type is not null group by 1, 2, 3), b as (select chunk_id, original_name, entity_type as label from (select *, row_number() over (partition by chunk_id, original_name order by k desc, f) as rn from l) where rn = 1), "
    "d as (select chunk_id, original_name, description from (select *, row_number() over (partition by chunk_id, original_name order by length(description) desc nulls last, pos) as k from n) where k = 1) "
    "select g.*, label, description from (select chunk_id, original_name, min(pos)::int as first_pos, count(*)::bigint as n_mentions from n group by 1, 2) g left join b using (chunk_id, original_name) left join d using (chunk_id, original_name)"
)
def coalesce_mentions(t):
    m = mentions(t, "chunk_id", "original_name", "entity_type", "description").where("original_name is not null")
    m = m.selectExpr("*", "row_number() over (partition by chunk_id order by mention_id) as pos")
    return latest.coalesce_mentions(m, ["chunk_id"], "original_name", "entity_type", "description", "pos")


@query(
    f"with {M}, c as (select original_name, entity_type, count(*) as k from m where original_name is not null and entity_type <> '' group by 1, 2) select original_name, entity_type from (select *, row_number() over (partition by original_name order by k desc, entity_type) as rn from c) where rn = 1"
)
def majority_lex(t):
    return latest.majority(mentions(t, "original_name", "entity_type").where("original_name is not null"), ["original_name"], "entity_type", "entity_type")


@query(
    f"with {M}, c as (select original_name, lower(entity_type) as f, count(*) as k, min(entity_type) as v from m where original_name is not null and entity_type <> '' group by 1, 2) select original_name, v as entity_type from (select *, row_number() over (partition by original_name order by k desc, f) as rn from c) where rn = 1"
)
def majority_casefold(t):
    return latest.majority(mentions(t, "original_name", "entity_type").where("original_name is not null"), ["original_name"], "entity_type", "entity_type", F.lower("entity_type"))


@query(
    f"with {M} select canonical_entity_id, description from (select canonical_entity_id, description, row_number() over (partition by canonical_entity_id order by length(description) desc, lower(description), description) as k from m where canonical_entity_id is not null and description <> '') where k = 1"
)
def representative_description(t):
    return latest.representative(mentions(t, "canonical_entity_id", "description").where("canonical_entity_id is not null"), ["canonical_entity_id"], "description", "description")


@query(
    f"with {M}, c as (select canonical_entity_id, original_name as v, count(*) as k from m where canonical_entity_id is not null and original_name is not null group by 1, 2) "
    "select canonical_entity_id, v as display_name from (select *, row_number() over (partition by canonical_entity_id order by k desc, len(string_split(v, ' ')) desc, length(v) desc, lower(v), v) as rn from c) where rn = 1"
)
def display_name_choice(t):
    return latest.display_name(mentions(t, "canonical_entity_id", "original_name").where("canonical_entity_id is not null"), ["canonical_entity_id"], "original_name", "display_name")


_P = (
    "p as (select original_name, count(*)::bigint as frequency, count(distinct document_id)::bigint as diversity, min(document_id) as document_id, min(chunk_id) as chunk_id, "
    "trim(regexp_replace(lower(original_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')) as lexical, 'native_entity_' || substr(sha256('\"' || replace(replace(original_name, '\\', '\\\\'), '\"', '\\\"') || '\"'), 1, 24) as profile_id "
    "from m where trim(original_name) <> '' group by 1)"
)


@query(f"with {M}, {_P} select original_name, frequency, diversity, document_id, chunk_id, lexical, profile_id from p")
def native_profiles(t):
    m = mentions(t, "original_name", "document_id", "chunk_id", "entity_type", "description")
    return ER.profiles(m).select("original_name", "frequency", "diversity", "document_id", "chunk_id", T.lexical_view(F.lower("original_name")).alias("lexical"), "profile_id")


@query()
def mention_profiles(t):
    return ER.mention_profiles(mentions(t, "original_name", "document_id")).select("mention_id", "frequency", "diversity")


def _profiles(t):
    m = mentions(t, "original_name", "document_id", "chunk_id", "entity_type", "description")
    return ER.profiles(m).withColumn("lexical", T.lexical_view(F.lower("original_name"))).withColumn("normalized", T.normalize_label(F.col("original_name")))


def _blocked(key: str, radius: int = 20, limit: int = 200) -> str:
    """Pairs of one block, or of the next few where a block is large."""
    return (
        f"bk as (select distinct b, i from ({key}) where b is not null), bn as (select *, count(*) over (partition by b) as n, row_number() over (partition by b order by i) as rn from bk), "
        f"bp as (select distinct x.i as left_id, y.i as right_id from bn x join bn y on x.b = y.b and x.rn < y.rn and (x.n <= {limit} or y.rn - x.rn <= {radius}))"
    )


@query(f"with {M}, {_P}, {_blocked(f'select lower({collapsed("original_name")}) as b, profile_id as i from p')} select left_id, right_id from bp")
def block_exact(t):
    return ER.block_exact(_profiles(t))


@query(
    f"with {M}, {_P}, w as (select profile_id, lexical, list_filter(string_split(lexical, ' '), lambda x: x <> '') as w from p), "
    + _blocked(
        "select case when len(w) >= 2 then array_to_string(list_transform(w, lambda y: substr(y, 1, 1)), '') end as b, profile_id as i from w union all select case when length(replace(lexical, ' ', '')) between 2 and 10 then replace(lexical, ' ', '') end, profile_id from w"
    )
    + " select left_id, right_id from bp"
)
def block_acronym(t):
    return ER.block_acronym(_profiles(t))


@query(
    f"with {M}, {_P}, "
    + _blocked("select unnest(list_filter(string_split(lexical, ' '), lambda x: x <> '')) as b, profile_id as i from p")
    + " select left_id, right_id from bp join p x on x.profile_id = left_id join p y on y.profile_id = right_id where least(length(x.lexical), length(y.lexical)) >= 4 and (contains(x.lexical, y.lexical) or contains(y.lexical, x.lexical))"
)
def block_token_containment(t):
    return ER.block_containment(_profiles(t))


@query()
def block_fuzzy(t):
    return ER.block_fuzzy(_profiles(t)).withColumn("lexical", F.round("lexical", 6))


def _near(t, p, stage):
    from ..operators import vectors
    from .q_more import name_vectors

    v = stage.write(name_vectors(t).join(p.select("original_name", "profile_id"), "original_name").select("profile_id", "embedding"), "vectors")
    return stage.write(ER.block_embedding(vectors.block_knn(v, "profile_id", "embedding", 32, 5).withColumnsRenamed({"left_id": "id", "right_id": "neighbour"})), "near"), v


def _routes(p, near, fuzzy):
    return {
        "acronym": ER.block_acronym(p), "containment": ER.block_containment(p), "exact_name": ER.block_exact(p), "fuzzy_name": fuzzy,
        "embedding_neighbour": near, "reciprocal_embedding_neighbour": near.where("reciprocal"),
    }


def _numbered(p, stage):
    """Profiles with a number in the order of their ids, which travels in place of the id, and the ids of the numbers."""
    p = stage.write(p.repartitionByRange("profile_id").sortWithinPartitions("profile_id").withColumn("n", F.monotonically_increasing_id()), "profiles")
    return p.withColumn("profile_id", F.col("n")).drop("n"), p.select("n", "profile_id")


def _named(pairs, ids):
    """Pairs with ids in place of numbers."""
    for side in ("left_id", "right_id"):
        pairs = pairs.withColumnRenamed(side, "n").join(ids.withColumnRenamed("profile_id", side), "n").drop("n")
    return pairs


@query()
def generate_candidates(t):
    p = _profiles(t)
    stage = Stage(p.sparkSession, "candidates")
    p, ids = _numbered(p, stage)
    return _named(ER.candidates(_routes(p, _near(t, p, stage)[0], ER.block_fuzzy(p))), ids).select("left_id", "right_id", "methods")


@query()
def score_pairs(t):
    from .q_graph import named_edges

    p = _profiles(t)
    stage = Stage(p.sparkSession, "scores")
    p, ids = _numbered(p, stage)
    near, v = _near(t, p, stage)
    fuzzy = stage.write(ER.block_fuzzy(p), "fuzzy")
    pairs = ER.candidates(_routes(p, near, fuzzy)).join(fuzzy, ["left_id", "right_id"], "left")
    e = named_edges(t).where("source <> target").select("source", "target")
    ends = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).select(F.col("source").alias("original_name"), F.col("target").alias("x"))
    pairs = ER.context_overlap(stage.write(pairs, "pairs"), ends.join(p.select("original_name", "profile_id"), "original_name"), "neighbourhood")
    s = ER.score(ER.pair_signals(ER.with_profiles(pairs, p.join(v, "profile_id", "left")))).select("left_id", "right_id", "score")
    s = _named(s, ids).withColumn("pair_id", T.joined_id("pair_", F.col("left_id"), F.col("right_id")))
    return ER.decide(s, F.lit(False), F.lit(None).cast("string")).select("pair_id", "left_id", "right_id", F.round("score", 6).alias("score"), "action", "source")


@query(f"with {_D}, e as (select pair_id, score, l as e from d where score is not null union all select pair_id, score, r from d where score is not null), b as (select pair_id, row_number() over (partition by e order by score desc, pair_id) as rn from e) select d.pair_id, score from d join (select pair_id from b where rn <= 3 group by 1 having count(*) = 2) using (pair_id)")
def mutual_top_k(t):
    return ER.mutual_top_k(decisions(t).where("score is not null"), 3).select("pair_id", "score")


@query(
    f"with {_D} select case when score >= 0.76 then 'merge' when score < 0.5 then 'reject' when source = 'judge' then action else 'abstain' end as action, "
    "case when score >= 0.76 then 'score_policy_merge' when score < 0.5 then 'score_policy_reject' when source = 'judge' then 'judge' else 'outside_judge_admission' end as source, count(*)::bigint as n from d group by 1, 2"
)
def decide_pairs(t):
    d = decisions(t)
    return ER.decide(d.withColumnRenamed("action", "said").withColumnRenamed("source", "by"), F.coalesce(F.col("by") == "judge", F.lit(False)), F.col("said")).groupBy("action", "source").agg(F.count(F.lit(1)).alias("n"))


@query("select x as relationship, case x when 'same_entity' then 'merge' when 'uncertain' then 'abstain' else 'reject' end as action from (select unnest(['same_entity', 'uncertain', 'related', 'part_of', 'different', 'namesake']) as x)")
def judge_relationship_map(t):
    names = ["same_entity", "uncertain", "related", "part_of", "different", "namesake"]
    return t("region").select(F.explode(F.array(*map(F.lit, names))).alias("relationship")).distinct().select("relationship", ER.judge_action(F.col("relationship")).alias("action"))


@query()
def constrained_clusters(t):
    return ER.constrained_clusters(decisions(t).where("score is not null"))[0]


@query()
def blocked_cluster_merges(t):
    return ER.constrained_clusters(decisions(t).where("score is not null"))[1]


@query(
    f"with {M}, c as (select canonical_entity_id as k, original_name as v, count(*) as n from m where canonical_entity_id is not null and original_name is not null group by 1, 2), "
    "dn as (select k, v as display_name from (select *, row_number() over (partition by k order by n desc, len(string_split(v, ' ')) desc, length(v) desc, lower(v), v) as rn from c) where rn = 1) "
    "select canonical_entity_id, display_name, count(distinct mention_id)::bigint as n_members, min(mention_id) as first_member, array_to_string(list_sort(list(distinct original_name) filter (original_name is not null)), '|') as aliases from m left join dn on k = canonical_entity_id where canonical_entity_id is not null group by 1, 2"
)
def canonicalize_clusters(t):
    m = mentions(t, "canonical_entity_id", "original_name", "description").where("canonical_entity_id is not null")
    return ER.canonicalize(m, "canonical_entity_id", "original_name", "description", "mention_id").select("canonical_entity_id", "display_name", "n_members", "first_member", "aliases")


@query(
    f"with {_D} select coalesce(source, '(none)') as source, count(*)::bigint as pairs, sum((action = 'merge')::int)::bigint as merges, sum((action = 'reject')::int)::bigint as rejects, sum((action = 'abstain')::int)::bigint as abstains, round(avg(score), 6) as mean_score from d group by 1"
)
def er_decision_metrics(t):
    n = lambda a: F.sum((F.col("action") == a).cast("long"))
    return decisions(t).groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(
        F.count(F.lit(1)).alias("pairs"), n("merge").alias("merges"), n("reject").alias("rejects"), n("abstain").alias("abstains"), F.round(F.avg("score"), 6).alias("mean_score")
    )


@query(f"with {M}, s as (select canonical_entity_id, count(*) as n from m where canonical_entity_id is not null group by 1) select n::bigint as cluster_size, count(*)::bigint as clusters from s group by 1")
def cluster_size_distribution(t):
    s = mentions(t, "canonical_entity_id").where("canonical_entity_id is not null").groupBy("canonical_entity_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    return s.groupBy("cluster_size").agg(F.count(F.lit(1)).alias("clusters"))


@query(
    f"with {M}, x as (select lower({collapsed('original_name')}) as label, builder_model, original_name from m where original_name is not null) select label, count(distinct builder_model)::int as builders, min(original_name) as example from x group by 1 having count(distinct builder_model) >= 3"
)
def consensus_entities(t):
    m = mentions(t, "original_name", "builder_model").where("original_name is not null")
    g = m.groupBy(T.normalize_label(F.col("original_name")).alias("label")).agg(F.countDistinct("builder_model").cast("int").alias("builders"), F.min("original_name").alias("example"))
    return g.where("builders >= 3")


@query(
    f"with {M} select lower(original_name) as label, count(distinct builder_model)::int as builders, count(distinct lower(entity_type))::int as types from m where original_name is not null and entity_type <> '' group by 1 having count(distinct builder_model) >= 2 and count(distinct lower(entity_type)) > 1"
)
def type_disagreements(t):
    m = mentions(t, "original_name", "builder_model", "entity_type").where("original_name is not null and entity_type <> ''")
    g = m.groupBy(F.lower("original_name").alias("label")).agg(F.countDistinct("builder_model").cast("int").alias("builders"), F.countDistinct(F.lower("entity_type")).cast("int").alias("types"))
    return g.where("builders >= 2 and types > 1")


@query(
    f"with {M}, c as (select original_name, count(distinct builder_model)::int as k from m where original_name is not null group by 1) select s.k, count(c.k)::bigint as names from (select unnest(range(1, 13))::int as k) s left join c on c.k = s.k group by 1"
)
def coverage_histogram(t):
    c = mentions(t, "original_name", "builder_model").where("original_name is not null").groupBy("original_name").agg(F.countDistinct("builder_model").cast("int").alias("k"))
    grid = c.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("k"))
    return grid.join(c.groupBy("k").agg(F.count(F.lit(1)).alias("names")), "k", "left").select("k", F.coalesce("names", F.lit(0)).alias("names"))


@query(
    f"with {M}, c as (select coalesce(lower(entity_type), '(null)') as e, builder_model, count(*) as n from m group by 1, 2), t as (select e from (select e, sum(n) as s from c group by 1) order by s desc, e limit 5), g as (select builder_model, case when e in (select e from t) then e else 'other' end as label, sum(n) as n from c group by 1, 2) "
    "select builder_model, label, n::bigint as n, round(n / sum(n) over (partition by builder_model), 6) as share from g"
)
def topk_plus_other(t):
    c = mentions(t, "entity_type", "builder_model").groupBy(F.coalesce(F.lower("entity_type"), F.lit("(null)")).alias("e"), "builder_model").agg(F.count(F.lit(1)).alias("n"))
    top = c.groupBy("e").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "e").limit(5).select("e", F.lit(True).alias("is_top"))
    g = c.join(F.broadcast(top), "e", "left").groupBy("builder_model", F.when(F.col("is_top"), F.col("e")).otherwise("other").alias("label")).agg(F.sum("n").alias("n"))
    return g.selectExpr("builder_model", "label", "n", "round(n / sum(n) over (partition by builder_model), 6) as share")


@query(
    f"with {M}, c as (select builder_model, document_id, count(distinct original_name) as k from m group by 1, 2) select builder_model, count(*)::bigint as documents, round(avg(k), 6) as mean_entities, median(k)::double as median_entities, min(k)::bigint as min_entities, max(k)::bigint as max_entities from c group by 1"
)
def document_coverage(t):
    c = mentions(t, "builder_model", "document_id", "original_name").groupBy("builder_model", "document_id").agg(F.countDistinct("original_name").alias("k"))
    return c.groupBy("builder_model").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("k"), 6).alias("mean_entities"), F.median("k").cast("double").alias("median_entities"), F.min("k").alias("min_entities"), F.max("k").alias("max_entities")
    )


@query(
    f"with {M}, x as (select distinct mention_id from m), y as (select distinct left_mention_id as mention_id from pair_decisions where left_mention_id is not null) select case when x.mention_id is null then 'right' when y.mention_id is null then 'left' else 'both' end as side, count(*)::bigint as n from x full join y using (mention_id) group by 1"
)
def diff_sets(t):
    y = t("pair_decisions").where("left_mention_id is not null").select(F.col("left_mention_id").alias("mention_id"))
    return joins.diff_sets(t("mentions").select("mention_id"), y, ["mention_id"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))
