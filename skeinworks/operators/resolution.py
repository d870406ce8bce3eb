"""Entity resolution: profiles, candidate routes, pair scores, decisions, clusters, canonical entities."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from . import graph, joins, latest

# Weights of the pair signals.
WEIGHTS = {
    "name_exact": 0.24, "lexical": 0.15, "acronym": 0.09, "containment": 0.08, "description": 0.12, "embedding": 0.12, "type": 0.08,
    "neighbourhood": 0.05, "relation_context": 0.04, "provenance": 0.01, "frequency": 0.01, "source_diversity": 0.01,
}
MERGE_AT, REJECT_BELOW = 0.76, 0.5
FUZZY_AT = 0.70


def profiles(mentions: DataFrame) -> DataFrame:
    """One row an exact name: frequency, distinct documents, first document and chunk (each on its own), majority type and family, longest description."""
    m = mentions.where(T.blank_to_null(F.col("original_name")).isNotNull())
    base = m.groupBy("original_name").agg(
        F.count(F.lit(1)).alias("frequency"), F.countDistinct("document_id").alias("diversity"), F.min("document_id").alias("document_id"), F.min("chunk_id").alias("chunk_id")
    )
    typed = m.withColumn("t", F.nullif(T.lexical_view(F.lower("entity_type")), F.lit(""))).withColumn("f", T.type_family(F.col("entity_type")))
    out = base.join(latest.majority(typed, ["original_name"], "t", "entity_type"), "original_name", "left")
    out = out.join(latest.majority(typed, ["original_name"], "f", "type_family"), "original_name", "left")
    out = out.join(latest.representative(m, ["original_name"], "description", "description"), "original_name", "left")
    norm = T.normalize_text(F.col("original_name"))
    return out.withColumn("normalized", norm).withColumn("lexical", T.lexical_view(F.col("normalized"))).withColumn("profile_id", T.joined_id("native_entity_", F.col("original_name")))


def mention_profiles(mentions: DataFrame) -> DataFrame:
    """Each mention with the frequency and document diversity of its normalised name."""
    m = mentions.withColumn("normalized", T.normalize_text(F.col("original_name")))
    per = m.groupBy("normalized").agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct("document_id").alias("diversity"))
    return m.join(per, "normalized")


def block_exact(p: DataFrame, max_block: int | None = 200) -> DataFrame:
    return joins.blocked_pairs(p, "normalized", "profile_id", max_block)


def block_acronym(p: DataFrame, max_block: int | None = 200) -> DataFrame:
    """Pairs that share initials or a compact name of 2 to 10 characters."""
    compact = F.replace("lexical", F.lit(" "), F.lit(""))
    keys = p.select("profile_id", F.explode(F.array_compact(F.array(T.acronym(F.col("lexical")), F.when(F.length(compact).between(2, 10), compact)))).alias("k"))
    return joins.blocked_pairs(keys, "k", "profile_id", max_block)


def block_containment(p: DataFrame, max_block: int | None = 200) -> DataFrame:
    """Pairs that share a word, where one name of four or more characters is part of the other."""
    keys = p.select("profile_id", F.explode(F.array_distinct(T.name_tokens(F.col("lexical")))).alias("k"))
    pairs = joins.blocked_pairs(keys, "k", "profile_id", max_block)
    both = with_profiles(pairs, p.select("profile_id", "lexical"))
    a, b = F.col("l.lexical"), F.col("r.lexical")
    return both.where((F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a))).select("left_id", "right_id")


def block_ratio(a: str, b: str) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``, by substring searches where ``b`` is too short for its heuristics.

    The longest common block is the one that starts first in ``a`` and then in ``b``; what lies
    before and behind it is matched in turn.
    """
    if len(b) >= 200:
        return difflib.SequenceMatcher(None, a, b).ratio()
    if a == b:
        return 1.0
    same, todo = 0, [(a, b)]
    while todo:
        x, y = todo.pop()
        n, best, at, i = len(x), 0, 0, 0
        while i + best < n:
            if x[i : i + best + 1] in y:
                best, at = best + 1, i
                while i + best < n and x[i : i + best + 1] in y:
                    best += 1
            i += 1
        if best:
            same += best
            j = y.find(x[at : at + best])
            if at and j:
                todo.append((x[:at], y[:j]))
            if at + best < n and j + best < len(y):
                todo.append((x[at + best :], y[j + best :]))
    return 2.0 * same / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity of two strings; not symmetric, so the smaller id goes first."""
    return pd.Series([block_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def letter_bound(a: pd.Series, b: pd.Series, buckets: int = 64) -> np.ndarray:
    """Upper bound of the similarity of each pair: twice the letters both have over all letters."""
    texts, place = np.unique(np.concatenate([a.to_numpy(object), b.to_numpy(object)]).astype(str), return_inverse=True)
    sizes = np.array([len(t) for t in texts])
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) % buckets
    counts = np.zeros((len(texts), buckets), np.int32)
    np.add.at(counts, (np.repeat(np.arange(len(texts)), sizes), letters), 1)
    left, right = place[: len(a)], place[len(a) :]
    return 2 * np.minimum(counts[left], counts[right]).sum(1) / np.maximum(sizes[left] + sizes[right], 1)


def ratio_at_least(threshold: float):
    """The similarity of two strings where it may reach ``threshold``, null where their letters rule it out."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, left, right = np.full(len(a), np.nan), a.to_numpy(object), b.to_numpy(object)
        for i in np.flatnonzero(letter_bound(a, b) >= threshold - 1e-9):
            out[i] = block_ratio(left[i], right[i])
        return pd.Series(out).where(~np.isnan(out), None).astype("Float64")

    return run


def block_fuzzy(p: DataFrame, threshold: float = FUZZY_AT, max_block: int | None = 200) -> DataFrame:
    """Pairs of names that begin alike, are of nearby length and similar by matching blocks; with ``lexical``."""
    bucket = F.floor(F.length("lexical") / 4)
    keys = p.where("lexical <> ''").select("profile_id", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("s"), F.substring("lexical", 1, 1).alias("c"))
    pairs = joins.blocked_pairs(keys.withColumn("k", F.concat_ws("|", "c", "s")), "k", "profile_id", max_block)
    both = with_profiles(pairs, p.select("profile_id", "lexical"))
    a, b = F.col("l.lexical"), F.col("r.lexical")
    # the ratio cannot exceed twice the shorter length over both lengths
    near = both.where(2 * F.least(F.length(a), F.length(b)) >= threshold * (F.length(a) + F.length(b)))
    return near.select("left_id", "right_id", ratio_at_least(threshold)(a, b).alias("lexical")).where(F.col("lexical") >= threshold)


def block_embedding(neighbours: DataFrame) -> DataFrame:
    """Pairs that one of two profiles has among its nearest, from ``(id, neighbour, cosine, rank)``.

    Adds the cosine (the greater of the two directions where rounding tells them apart), the
    rank in each direction, whether both directions hold, and the signal ``(cosine + 1) / 2``.
    """
    n = neighbours.where("id <> neighbour").withColumn("forth", F.col("id") < F.col("neighbour"))
    g = n.groupBy(F.least("id", "neighbour").alias("left_id"), F.greatest("id", "neighbour").alias("right_id")).agg(
        F.max("cosine").alias("cosine"), F.min(F.when(F.col("forth"), F.col("rank"))).alias("left_rank"), F.min(F.when(~F.col("forth"), F.col("rank"))).alias("right_rank")
    )
    signal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cosine") + 1) / 2))
    return g.withColumn("reciprocal", F.col("left_rank").isNotNull() & F.col("right_rank").isNotNull()).withColumn("embedding", signal)


def with_profiles(pairs: DataFrame, p: DataFrame) -> DataFrame:
    """Pairs with the profiles of both sides as ``l`` and ``r``."""
    cols = [c for c in p.columns if c != "profile_id"]
    side = lambda n, k: p.select(F.col("profile_id").alias(k), F.struct(*cols).alias(n))
    return pairs.join(side("l", "left_id"), "left_id").join(side("r", "right_id"), "right_id")


def context_overlap(pairs: DataFrame, context: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: the Jaccard similarity of what two profiles have around them, null where one has nothing.

    ``context`` has ``(profile_id, x)``, say neighbours in the graph. Shared items are counted
    by joins, so no profile's surroundings are ever gathered.
    """
    c = context.select("profile_id", "x").where("x is not null").distinct()
    size = c.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    left = pairs.select("left_id", "right_id").join(c.withColumnRenamed("profile_id", "left_id"), "left_id")
    shared = left.join(c.withColumnRenamed("profile_id", "right_id"), ["right_id", "x"]).groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("_k"))
    out = pairs.join(shared, ["left_id", "right_id"], "left")
    for side in ("left", "right"):
        out = out.join(size.select(F.col("profile_id").alias(f"{side}_id"), F.col("n").alias(f"_{side}")), f"{side}_id", "left")
    both = F.coalesce("_k", F.lit(0))
    return out.withColumn(name, both / (F.col("_left") + F.col("_right") - both)).drop("_k", "_left", "_right")


def candidates(routes: dict[str, DataFrame]) -> DataFrame:
    """Union of candidate routes: each pair once with the sorted list of its methods."""
    out = None
    for name, df in sorted(routes.items()):
        part = df.select("left_id", "right_id", F.lit(name).alias("m"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("left_id", "right_id").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("methods"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 1 if both are empty, null if one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), None).when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if their lengths differ or one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def pair_signals(both: DataFrame) -> DataFrame:
    """Signals of each pair of profiles; null means unavailable. Context signals come from columns of the same name where present."""
    a, b = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    has = set(both.schema["l"].dataType.fieldNames())
    compact = lambda c: F.replace(c("lexical"), F.lit(" "), F.lit(""))
    ac, bc = T.acronym(a("lexical")), T.acronym(b("lexical"))
    acr = F.coalesce(ac == compact(b), F.lit(False)) | F.coalesce(bc == compact(a), F.lit(False)) | F.coalesce(ac == bc, F.lit(False))
    words = lambda c: F.when(c("description").isNotNull(), F.array_distinct(T.name_tokens(T.lexical_view(F.lower(c("description"))))))
    ratio = lambda c: F.least(a(c), b(c)) / F.greatest(a(c), b(c))
    context = lambda c: F.col(c) if c in both.columns else F.lit(None).cast("double")
    signals = {
        "name_exact": (a("normalized") == b("normalized")).cast("double"),
        "lexical": F.coalesce(F.col("lexical"), sequence_ratio(a("lexical"), b("lexical"))) if "lexical" in both.columns else sequence_ratio(a("lexical"), b("lexical")),
        "acronym": acr.cast("double"),
        "containment": (F.contains(a("lexical"), b("lexical")) | F.contains(b("lexical"), a("lexical"))).cast("double"),
        "description": jaccard(words(a), words(b)),
        "embedding": F.col("embedding") if "embedding" in both.columns else (cosine(a("embedding"), b("embedding")) + 1) / 2 if "embedding" in has else F.lit(None).cast("double"),
        "type": F.when(a("type_family").isNull() | b("type_family").isNull(), None).otherwise((a("type_family") == b("type_family")).cast("double")),
        "neighbourhood": context("neighbourhood"),
        "relation_context": context("relation_context"),
        "provenance": F.when(a("document_id") != b("document_id"), 0.0).when(a("chunk_id") != b("chunk_id"), 0.5).otherwise(1.0),
        "frequency": ratio("frequency"),
        "source_diversity": ratio("diversity"),
    }
    return both.select("left_id", "right_id", *[s.alias(k) for k, s in signals.items()])


def score(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds ``score``: the weighted mean of the available signals, null if there is none."""
    w = {k: v for k, v in sorted((weights or WEIGHTS).items()) if v > 0}
    top = sum((F.coalesce(F.col(k) * v, F.lit(0.0)) for k, v in w.items()), F.lit(0.0))
    total = sum((F.when(F.col(k).isNotNull(), F.lit(v)).otherwise(0.0) for k, v in w.items()), F.lit(0.0))
    return signals.withColumn("score", F.try_divide(top, F.nullif(total, F.lit(0.0))))


def mutual_top_k(pairs: DataFrame, k: int, left: str = "left_id", right: str = "right_id", by: str = "score", tie: str = "pair_id") -> DataFrame:
    """Pairs among the ``k`` best of both their ends."""
    ends = pairs.select(tie, by, F.col(left).alias("e")).unionByName(pairs.select(tie, by, F.col(right).alias("e")))
    best = ends.withColumn("rn", F.row_number().over(Window.partitionBy("e").orderBy(F.desc(by), tie))).where(F.col("rn") <= k)
    both = best.groupBy(tie).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(tie)
    return pairs.join(both, tie, "left_semi")


def decide(scored: DataFrame, admitted: Column, judged: Column, merge_at: float = MERGE_AT, reject_below: float = REJECT_BELOW) -> DataFrame:
    """Adds ``action`` and ``source``: score policy first, then the judge for admitted pairs, else abstention."""
    s = F.col("score")
    return scored.withColumn("action", F.when(s >= merge_at, "merge").when(s < reject_below, "reject").when(admitted & judged.isNotNull(), judged).otherwise("abstain")).withColumn(
        "source", F.when(s >= merge_at, "score_policy_merge").when(s < reject_below, "score_policy_reject").when(admitted & judged.isNotNull(), "judge").otherwise("outside_judge_admission")
    )


def judge_action(relationship: Column) -> Column:
    return F.when(relationship == "same_entity", "merge").when(relationship == "uncertain", "abstain").when(relationship.isNotNull(), "reject")


def _cluster(pairs: list[tuple[float, str, str, str]], vetoes: set[tuple[str, str]]) -> tuple[dict[str, str], list[str]]:
    """Greedy merging in the order given; returns member -> root and the pair ids that a veto blocked.

    Each cluster keeps the set of nodes that veto it, so a test costs the smaller of two sets.
    """
    home: dict[str, list[set[str]]] = {}
    enemies: dict[str, set[str]] = {}
    for a, b in vetoes:
        enemies.setdefault(a, set()).add(b)
        enemies.setdefault(b, set()).add(a)
    blocked = []
    for _, pair, a, b in pairs:
        x, y = (home.setdefault(n, [{n}, set(enemies.get(n, ()))]) for n in (a, b))
        if x is y:
            continue
        if not x[0].isdisjoint(y[1]) if len(x[0]) < len(y[1]) else not y[1].isdisjoint(x[0]):
            blocked.append(pair)
            continue
        small, big = sorted((x, y), key=lambda c: len(c[0]))
        big[0] |= small[0]
        big[1] |= small[1]
        for n in small[0]:
            home[n] = big
    return {n: min(c[0]) for n, c in home.items()}, blocked


def constrained_clusters(decisions: DataFrame, pair: str = "pair_id", left: str = "left_id", right: str = "right_id") -> tuple[DataFrame, DataFrame]:
    """Clusters ``(member, cluster)`` and ``(pair_id)`` of merges blocked by a rejected pair across the two clusters.

    Merges are taken from the highest score down and never retried. Merges and the
    vetoes that matter never leave a connected component of merges, so components are
    solved on their own.
    """
    d = decisions.select(F.col(pair).alias("pair"), F.col(left).alias("a"), F.col(right).alias("b"), "action", "score")
    merges = d.where("action = 'merge' and a <> b")
    comp = graph.components(merges, "a", "b").withColumnRenamed("node", "a")
    vetoes = d.where("action = 'reject'").join(comp, "a").join(comp.withColumnsRenamed({"a": "b", "component": "cb"}), "b").where("component = cb").drop("cb")
    rows = merges.join(comp, "a").select("component", "pair", "a", "b", "score", F.lit(False).alias("veto")).unionByName(vetoes.select("component", "pair", "a", "b", "score", F.lit(True).alias("veto")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        bad = {(min(a, b), max(a, b)) for a, b in pdf.loc[pdf.veto, ["a", "b"]].itertuples(index=False)}
        order = pdf[~pdf.veto].sort_values(["score", "pair"], ascending=[False, True])
        root, blocked = _cluster([(s, p, a, b) for s, p, a, b in order[["score", "pair", "a", "b"]].itertuples(index=False)], bad)
        return pd.DataFrame([("member", m, r) for m, r in root.items()] + [("blocked", p, None) for p in blocked], columns=["kind", "item", "cluster"])

    out = rows.groupBy("component").applyInPandas(solve, "kind string, item string, cluster string")
    return out.where("kind = 'member'").select(F.col("item").alias("member"), "cluster"), out.where("kind = 'blocked'").select(F.col("item").alias(pair))


def canonicalize(members: DataFrame, cluster: str, name: str, description: str, item: str) -> DataFrame:
    """One row a cluster: display name, aliases, merged description and members, each in order."""
    display = latest.display_name(members, [cluster], name, "display_name")
    agg = members.groupBy(cluster).agg(
        F.array_join(F.array_sort(F.collect_set(name)), "|").alias("aliases"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.trim(description) != "", F.col(description)))), " | ").alias("description"),
        F.countDistinct(item).alias("n_members"),
        F.min(item).alias("first_member"),
    )
    return agg.join(display, cluster, "left")


def unique_display_names(entities: DataFrame, entity: str, name: str, label: str) -> DataFrame:
    """Adds ``unique_name``: the display name, qualified by type and then by id where several entities share it."""
    w = Window.partitionBy(F.lower(name))
    typed = F.concat(F.col(name), F.lit(" ("), F.coalesce(label, F.lit("unknown")), F.lit(")"))
    e = entities.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_typed", typed)
    e = e.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(F.lower("_typed"))))
    pick = F.when(F.col("_n") == 1, F.col(name)).when(F.col("_t") == 1, F.col("_typed")).otherwise(F.concat(F.col(name), F.lit(" ["), F.substring(entity, -6, 6), F.lit("]")))
    return e.withColumn("unique_name", pick).drop("_n", "_t", "_typed")
