"""Validated joins, blocked self-joins and set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Stage


class GateError(ValueError):
    """A precondition of an operator does not hold."""


def require_unique(df: DataFrame, key: Sequence[str], what: str) -> None:
    """Raises if a key repeats; stops at the first repeated key."""
    if df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise GateError(f"{what}: {', '.join(key)} is not unique")


def many_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], check: bool = True) -> DataFrame:
    """Left join that never multiplies rows."""
    if check:
        require_unique(right, key, "many to one join")
    return left.join(right, list(key), "left")


def one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join of two tables with the same set of keys, each unique; raises otherwise."""
    require_unique(left, key, "left side")
    require_unique(right, key, "right side")
    odd = diff_sets(left, right, key).where("side <> 'both'").limit(1).count()
    if odd:
        raise GateError("the sides have different keys")
    return left.join(right, list(key))


def diff_sets(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of both tables with ``side``: both, left or right."""
    a = left.select(*key).distinct().withColumn("_l", F.lit(1))
    b = right.select(*key).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, list(key), "full").select(*key, side.alias("side"))


CELL = 1024


def _numbered(rows: DataFrame, block: str, item: str, stage: Stage) -> DataFrame:
    """``(b, i, rn, n)``: distinct items of each block, numbered in order, with the size of the block.

    Numbered in two steps over ranges, so that a large block is not one task's.
    """
    r = rows.where(F.col(block).isNotNull()).select(F.col(block).alias("b"), F.col(item).alias("i")).distinct()
    r = stage.write(r.repartitionByRange("b", "i").withColumn("part", F.spark_partition_id()), "ranges")
    per = r.groupBy("b", "part").agg(F.count(F.lit(1)).alias("k"))
    per = per.selectExpr("b", "part", "sum(k) over (partition by b order by part) - k as before", "sum(k) over (partition by b) as n").where("n > 1")
    return r.join(per, ["b", "part"]).select("b", "i", (F.col("before") + F.row_number().over(Window.partitionBy("b", "part").orderBy("i"))).alias("rn"), "n")


def blocked_pairs(rows: DataFrame, block: str, item: str, max_block: int | None) -> DataFrame:
    """Pairs ``(left_id, right_id)``, left < right, of items of one block.

    In a block of more than ``max_block`` items each is paired only with the next
    ``max(2, min(20, max_block // 10))`` in order, as published. Without ``max_block`` every
    pair of a block is given. Either way the join is on block and cells of the order, so a
    large block spreads over many keys.
    """
    r = _numbered(rows, block, item, Stage(rows.sparkSession, "blocks"))
    if max_block is None:
        r = r.withColumn("cell", F.floor((F.col("rn") - 1) / CELL))
        last = F.floor((F.col("n") - 1) / CELL)
        left = r.select("b", F.col("i").alias("left_id"), F.col("rn").alias("lr"), F.explode(F.sequence("cell", last)).alias("cell"), F.col("cell").alias("own"))
        right = r.select("b", F.col("i").alias("right_id"), F.col("rn").alias("rr"), F.explode(F.sequence(F.lit(0).cast("long"), "cell")).alias("own"), "cell")
        return left.join(right, ["b", "own", "cell"]).where("lr < rr").select("left_id", "right_id").distinct()
    radius = max(2, min(20, max_block // 10))
    r = r.withColumn("reach", F.when(F.col("n") <= max_block, F.lit(max_block)).otherwise(F.lit(radius))).select("b", "i", "rn", "reach")
    # a cell holds as many items as one may reach; partners are in the same cell or the next
    r = r.withColumn("cell", F.floor(F.col("rn") / F.col("reach")))
    left = r.select("b", F.col("i").alias("left_id"), F.col("rn").alias("lr"), "reach", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell"))
    right = r.select("b", "cell", F.col("i").alias("right_id"), F.col("rn").alias("rr"))
    return left.join(right, ["b", "cell"]).where("lr < rr and rr - lr <= reach").select("left_id", "right_id").distinct()


def missing_pairs(members: DataFrame, group: str, item: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs ``(group, left_id, right_id)`` of items of one group that no edge joins, whatever its direction.

    The items of a group are numbered and met cell against cell, so that a large group
    spreads over many keys; the pairs of all items of a group are the result asked for.
    """
    r = _numbered(members, group, item, Stage(members.sparkSession, "missing")).withColumn("cell", F.floor((F.col("rn") - 1) / CELL))
    left = r.select("b", F.col("i").alias("left_id"), F.col("cell").alias("own"), F.explode(F.sequence("cell", F.floor((F.col("n") - 1) / CELL))).alias("cell"))
    right = r.select("b", F.col("i").alias("right_id"), F.explode(F.sequence(F.lit(0).cast("long"), "cell")).alias("own"), "cell")
    pairs = left.join(right, ["b", "own", "cell"]).where("left_id < right_id")
    known = edges.select(F.least(a, b).alias("left_id"), F.greatest(a, b).alias("right_id")).distinct()
    return pairs.join(known, ["left_id", "right_id"], "left_anti").select(F.col("b").alias(group), "left_id", "right_id")


def local_edges(edges: DataFrame, a: str, b: str, members: DataFrame, group: str, item: str) -> DataFrame:
    """Edges with both ends in a group, with the group.

    An edge is sent to the groups of the end that is in fewer of them and looked up there by
    its other end, so an item of very many groups never multiplies its edges.
    """
    m = Stage(members.sparkSession, "local").write(members.select(group, item).distinct(), "members")
    n = m.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    e = edges.join(n.withColumnsRenamed({item: a, "_n": "_a"}), a).join(n.withColumnsRenamed({item: b, "_n": "_b"}), b)
    e = e.withColumn("_few", F.when(F.col("_a") <= F.col("_b"), F.col(a)).otherwise(F.col(b))).withColumn("_many", F.when(F.col("_a") <= F.col("_b"), F.col(b)).otherwise(F.col(a)))
    sent = e.join(m.withColumnRenamed(item, "_few"), "_few")
    return sent.join(m.withColumnRenamed(item, "_many"), [group, "_many"], "left_semi").select(*edges.columns, group)


def resolve_endpoints(relations: DataFrame, side: str, mentions: DataFrame, scope: Sequence[str], mention: str) -> DataFrame:
    """Adds ``{side}_found``: the mention an endpoint means, looked up in its scope and else anywhere if unique."""
    local = mentions.select(*scope, F.col(mention).alias(side)).distinct().withColumn("_local", F.col(side))
    anywhere = mentions.groupBy(F.col(mention).alias(side)).agg(F.countDistinct(*scope).alias("_n")).where("_n = 1").select(side, F.col(side).alias("_any"))
    out = relations.join(local, [*scope, side], "left").join(anywhere, side, "left")
    return out.withColumn(f"{side}_found", F.coalesce("_local", "_any")).drop("_local", "_any")
