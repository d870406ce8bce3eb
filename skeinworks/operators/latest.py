"""Deduplication, first-of-group and tie-breaking choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order; Spark keeps one row a key per partition before it shuffles."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_success(calls: DataFrame, key: Sequence[str], ok: Column, created: str, attempt: str, call: str) -> DataFrame:
    """Newest successful call of each key, or the newest of all where none succeeded."""
    return latest(calls, key, [ok.cast("int").desc(), F.col(created).desc_nulls_last(), F.col(attempt).desc(), F.col(call).desc()])


def majority(df: DataFrame, key: Sequence[str], value: str, out: str, fold: Column | None = None) -> DataFrame:
    """Most frequent non-blank value of each key; ties go to the smallest (folded value, then value)."""
    v = df.where(F.col(value).isNotNull() & (F.col(value) != "")).withColumn("_k", fold if fold is not None else F.col(value))
    per = v.groupBy(*key, "_k").agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_v"))
    return per.groupBy(*key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_k"), F.col("_v"))).alias("_b")).select(*key, F.col("_b._v").alias(out))


def representative(df: DataFrame, key: Sequence[str], value: str, out: str) -> DataFrame:
    """Longest non-blank value of each key; ties go to the smallest, case last."""
    v = df.where(F.col(value).isNotNull() & (F.col(value) != ""))
    best = F.min(F.struct((-F.length(value)).alias("n"), F.lower(value).alias("k"), F.col(value).alias("v")))
    return v.groupBy(*key).agg(best.alias("_b")).select(*key, F.col("_b.v").alias(out))


def display_name(names: DataFrame, key: Sequence[str], name: str, out: str) -> DataFrame:
    """Most frequent name of each key; ties go to more words, more characters, then the smallest."""
    per = names.where(F.col(name).isNotNull()).groupBy(*key, name).agg(F.count(F.lit(1)).alias("_n"))
    order = [F.desc("_n"), F.desc(F.size(F.split(name, " "))), F.desc(F.length(name)), F.lower(name), F.col(name)]
    return latest(per, key, order).select(*key, F.col(name).alias(out))


def coalesce_mentions(mentions: DataFrame, group: Sequence[str], name: str, label: str, description: str, pos: str) -> DataFrame:
    """One row a group and name in first-seen order: longest description and majority label, first seen on a tie."""
    key = [*group, name]
    base = mentions.where(F.col(name).isNotNull())
    labels = base.where(F.col(label).isNotNull()).groupBy(*key, label).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    best = labels.groupBy(*key).agg(F.max_by(F.col(label), F.struct("n", (-F.col("first")).alias("f"))).alias("label"))
    agg = base.groupBy(*key).agg(
        F.max_by(F.col(description), F.when(F.col(description).isNotNull(), F.struct(F.length(description), -F.col(pos)))).alias("description"),
        F.min(pos).alias("first_pos"),
        F.count(F.lit(1)).alias("n_mentions"),
    )
    return agg.join(best, key, "left")
