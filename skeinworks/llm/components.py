"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every vertex draws an exponential head start; clusters grow one hop a round from
the vertices with the largest head starts, so a vertex joins the cluster that
reaches it first. Clusters then contract to super-vertices, the edges between
clusters form a smaller graph, and the same is done there until no edge is left.
Composing the assignments of all levels gives one label per connected component.

All state is rows of two longs; a round is one equi-join and one min-aggregate
that combines on the map side, so a vertex with a third of all edges costs its
partition only the pre-aggregated messages (and AQE splits the join side).
Every level is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stage, pick

_ID_BITS = 42
_IN_BUCKET_BITS = 22
_TICK = 1024


def dense_ids(keys: DataFrame, key: str = "key") -> DataFrame:
    """Distinct non-null ``key`` values with a unique long ``vid`` below 2^42.

    Keys hash to 2^20 buckets and are numbered inside their bucket, so no task
    sees more than its share of buckets and no value can collide.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(1 << (_ID_BITS - _IN_BUCKET_BITS)))
    rows = (
        keys.where(F.col(key).isNotNull())
        .select(key, bucket.alias("_b"))
        .repartition("_b")
        .dropDuplicates(["_b", key])
        .selectExpr(
            key,
            f"_b * {1 << _IN_BUCKET_BITS}L + row_number() over (partition by _b order by {key}) as vid",
        )
    )
    return rows


def _arrival(vertex: str, level: int, beta: float):
    """Start time of a cluster centred on ``vertex``, in ticks, packed above the vertex id."""
    horizon = int(40 / beta)
    u = (F.xxhash64(F.lit(level), F.col(vertex)).bitwiseAND(F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
    ticks = F.floor((F.lit(float(horizon)) + F.log(u) / F.lit(beta)) * _TICK).cast("long")
    return F.shiftleft(F.greatest(ticks, F.lit(0).cast("long")), _ID_BITS).bitwiseOR(F.col(vertex))


def components(edges: DataFrame, src: str = "u", dst: str = "v", beta: float = 0.15, rounds: int = 6, stage: Stage | None = None) -> DataFrame:
    """Labels the connected components of an undirected graph over long ids below 2^42.

    Returns ``(vid, label)`` for every vertex that has an edge to another vertex;
    labels are ids of one vertex of the component. Null ends, loops and repeated or
    swapped edges are ignored. ``beta`` is the rate of the head starts (an edge is
    cut with a probability of about ``beta``), ``rounds`` the hops a cluster may
    grow in one level. Any values give exact components; they only set the number
    of levels, which is logarithmic in the longest chain.
    """
    stage = stage or Stage(edges.sparkSession, "components")
    a, b = F.col(f"`{src}`"), F.col(f"`{dst}`")
    cur = stage.write(
        edges.where((a != b) & a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(),
        "edges",
    )
    hop = _TICK << _ID_BITS
    assigns: list[DataFrame] = []
    level = 0
    while not cur.isEmpty():
        both = cur.selectExpr("inline(array(struct(u as s, v as d), struct(v as s, u as d)))")
        # first round: a neighbour's arrival needs no join, since it is a function of its id
        state = both.select(F.col("d").alias("vid"), (_arrival("s", level, beta) + F.lit(hop)).alias("k")).groupBy("vid").agg(F.min("k").alias("k"))
        state = state.select("vid", F.least("k", _arrival("vid", level, beta)).alias("k"))
        for _ in range(rounds - 1):
            told = both.join(state.withColumnRenamed("vid", "s"), "s").select(F.col("d").alias("vid"), (F.col("k") + F.lit(hop)).alias("k"))
            # a vertex hears itself through the head start in its own message, so the join stays linear in the rounds
            state = told.groupBy("vid").agg(F.min("k").alias("k"))
            state = state.select("vid", F.least("k", _arrival("vid", level, beta)).alias("k"))
        state = stage.write(state, "grow")
        assign = state.select("vid", F.col("k").bitwiseAND(F.lit((1 << _ID_BITS) - 1)).alias("center"))
        ca = assign.selectExpr("vid as u", "center as cu")
        cb = assign.selectExpr("vid as v", "center as cv")
        nxt = stage.write(
            cur.join(ca, "u").join(cb, "v").where("cu <> cv").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct(),
            "edges",
        )
        assigns.append(assign)
        stage.drop(cur)
        cur = nxt
        level += 1
    if not assigns:
        return cur.select(F.col("u").alias("vid"), F.col("v").alias("label"))
    labels = assigns[-1].select("vid", F.col("center").alias("label"))
    for assign in reversed(assigns[:-1]):
        up = labels.select(F.col("vid").alias("center"), F.col("label"))
        labels = stage.write(assign.join(up, "center", "left").select("vid", F.coalesce("label", "center").alias("label")), "labels")
    return labels


def valid_merges(decisions: DataFrame, blocked: DataFrame) -> DataFrame:
    """Pairs that hold: ``(left, right)`` mention ids.

    A row with a null action, mention or pair id is no decision. Of a pair id the
    latest decision holds (a null ``decided_at`` is oldest; of decisions made at
    the same time one that is no merge wins), if it is a merge ignoring case and
    white space and no row of ``blocked`` is triggered by it.
    """
    d = pick(decisions, pair="pair_id", left="left_mention_id", right="right_mention_id", action="action", at="decided_at")
    trimmed = F.lower(F.regexp_replace("action", r"(?U)^\s+|\s+$", ""))
    d = d.dropna(subset=["pair", "left", "right", "action"]).select("pair", "left", "right", "at", (trimmed == "merge").cast("int").alias("m"))
    # the newest row of a pair by one hash aggregate: (at, not merge, sides)
    last = d.groupBy("pair").agg(F.max(F.struct(F.col("at"), (-F.col("m")).alias("n"), F.col("left"), F.col("right"))).alias("x"))
    last = last.where("x.n = -1").select("pair", F.col("x.left").alias("left"), F.col("x.right").alias("right"))
    b = pick(blocked, pair="trigger_pair_id").dropna().distinct()
    return last.join(b, "pair", "left_anti").where("left <> right").select("left", "right")


def group_mentions(decisions: DataFrame, blocked: DataFrame, mentions: DataFrame, beta: float = 0.15, rounds: int = 6) -> DataFrame:
    """``(mention_id, group_id)`` for every mention in a group of two or more.

    ``group_id`` is the smallest mention id of the group. Links to mentions that
    are null or do not exist in ``mentions`` are void. Empty inputs give no rows.
    """
    spark = decisions.sparkSession
    stage = Stage(spark, "groups")
    ids = stage.write(dense_ids(pick(mentions, key="mention_id")), "ids")
    links = valid_merges(decisions, blocked)
    edges = links.join(ids.selectExpr("key as left", "vid as u"), "left").join(ids.selectExpr("key as right", "vid as v"), "right").select("u", "v")
    labels = components(edges, beta=beta, rounds=rounds, stage=stage)
    named = stage.write(labels.join(ids, "vid").select(F.col("key").alias("mention_id"), "label"), "named")
    smallest = named.groupBy("label").agg(F.min("mention_id").alias("group_id"))
    return named.join(smallest, "label").select("mention_id", "group_id")
