"""Relations between mentions: coalescing, neighbours and context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesce_relations(relations: DataFrame, group: Sequence[str], a: str, b: str, keyword: str, pos: str) -> DataFrame:
    """One row a group and unordered pair: direction of the first relation, distinct keywords in order of first use."""
    r = relations.where(F.col(a) != F.col(b)).withColumn("_l", F.least(a, b)).withColumn("_r", F.greatest(a, b))
    words = r.where(F.col(keyword).isNotNull()).groupBy(*group, "_l", "_r", F.lower(keyword).alias("_k")).agg(F.min(F.struct(F.col(pos), F.col(keyword))).alias("w"))
    lists = words.groupBy(*group, "_l", "_r").agg(F.transform(F.array_sort(F.collect_list("w")), lambda x: x[keyword]).alias("keywords"))
    first = r.groupBy(*group, "_l", "_r").agg(F.min_by(F.struct(a, b), pos).alias("d"), F.count(F.lit(1)).alias("n_relations"))
    out = first.join(lists, [*group, "_l", "_r"], "left")
    return out.select(*group, F.col(f"d.{a}").alias("source"), F.col(f"d.{b}").alias("target"), "n_relations", F.array_join(F.coalesce("keywords", F.array()), "|").alias("keywords"))


def neighbours(edges: DataFrame, a: str, b: str, limit: int | None = None) -> DataFrame:
    """``(node, neighbour)`` in both directions, without loops, each once."""
    e = edges.where(F.col(a) != F.col(b))
    return e.select(F.col(a).alias("node"), F.col(b).alias("neighbour")).unionByName(e.select(F.col(b).alias("node"), F.col(a).alias("neighbour"))).distinct()


def expand(edges: DataFrame, seeds: DataFrame, node: str, per_node: int) -> DataFrame:
    """Seeds with their ``per_node`` heaviest neighbours: ``(seed, node, weight)``; ``edges`` has source, target, weight."""
    from pyspark.sql import Window

    both = edges.select("source", "target", "weight").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    near = both.join(seeds.select(F.col(node).alias("source")).distinct(), "source", "left_semi").where("source <> target")
    w = Window.partitionBy("source").orderBy(F.desc("weight"), "target")
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_node).select(F.col("source").alias("seed"), F.col("target").alias("node"), "weight")


def evidence_checks(accepted: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``(relation_id, problem)`` of recovered relations that evidence does not bear out.

    ``accepted`` has relation_id, chunk_id, source, target, quote; ``edges`` source and target
    of the graph before recovery. Quotes count without outer white space.
    """
    k = chunks.groupBy("chunk_id").agg(F.max("content").alias("content"))
    e = edges.select(F.least("source", "target").alias("_l"), F.greatest("source", "target").alias("_r")).distinct().withColumn("_known", F.lit(1))
    j = accepted.withColumn("_l", F.least("source", "target")).withColumn("_r", F.greatest("source", "target")).join(k, "chunk_id", "left").join(e, ["_l", "_r"], "left")
    quote = F.trim(F.coalesce("quote", F.lit("")))
    problems = F.array_compact(
        F.array(
            F.when(F.col("content").isNull(), "unknown_chunk"),
            F.when(F.col("source") == F.col("target"), "loop"),
            F.when(F.col("_known").isNotNull(), "already_an_edge"),
            F.when(quote == "", "no_quote").when(~F.coalesce(F.contains("content", quote), F.lit(False)), "quote_not_in_chunk"),
        )
    )
    return j.select("relation_id", F.explode(problems).alias("problem"))
