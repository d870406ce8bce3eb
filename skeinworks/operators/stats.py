"""Statistics: paired comparisons, bootstraps, rank correlation, fits and fronts."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired_deltas(values: DataFrame, key: Sequence[str], regime: str, left: str, right: str, value: str) -> DataFrame:
    """``left_value, right_value, delta`` of each key; null where a side is."""
    p = values.groupBy(*key).pivot(regime, [left, right]).agg(F.first(value, ignorenulls=True))
    a, b = F.col(f"`{left}`"), F.col(f"`{right}`")
    return p.select(*key, a.alias("left_value"), b.alias("right_value"), (b - a).alias("delta"))


def resample_plan(strata: Sequence[str | None], samples: int, seed: int | str) -> np.ndarray:
    """Row indices of each resample, one row a sample: as many draws with replacement from each stratum as it has rows.

    The draws are those of the standard generator's ``randrange``, seeded with the first
    eight bytes (big-endian) of a digest that the published plan fixes, one stratum after
    another in the order of their names; a missing stratum is called unknown. Words of the
    generator are drawn in bulk: a draw below ``n`` is the first word whose leading bits
    are below ``n``, so a stratum takes a run of the stream and leaves the rest.
    """
    names = np.array([s or "unknown" for s in strata], dtype=object)
    members = [np.flatnonzero(names == name) for name in sorted(set(names))]
    words = _words(int.from_bytes(hashlib.sha256(f"{seed}\0paired-question-plan".encode()).digest()[:8], "big"))
    out = np.empty((samples, len(names)), np.int64)
    held = np.empty(0, np.uint64)
    for r in range(samples):
        at = 0
        for rows in members:
            n = len(rows)
            shift = np.uint64(32 - n.bit_length())
            while True:
                hits = np.flatnonzero((held >> shift) < n)
                if len(hits) >= n:
                    break
                held = np.concatenate([held, words(max(4096, 4 * n))])
            out[r, at : at + n] = rows[(held[hits[:n]] >> shift).astype(np.int64)]
            held = held[hits[n - 1] + 1 :]
            at += n
    return out


def _words(seed: int):
    """Source of 32-bit words: the standard generator's stream from an integer seed."""
    state = random.Random(seed).getstate()[1]
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    return lambda n: bits.random_raw(n).astype(np.uint64)


def _means(values: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """Mean of each resample over the rows that have a value; resamples without any are left out."""
    drawn = values[plan]
    there = ~np.isnan(drawn)
    n = there.sum(1)
    return (np.where(there, drawn, 0.0).sum(1) / np.maximum(n, 1))[n > 0]


def _interval(values: np.ndarray, level: float) -> tuple[float, float]:
    tail = 50 * (1 - level)
    return tuple(np.percentile(values, [tail, 100 - tail])) if len(values) else (np.nan, np.nan)


def _resampled(rows: DataFrame, by: Sequence[str], stratum: str, item: str, values: dict[str, str], solve, outputs: str) -> DataFrame:
    """Runs ``solve(strata, values)`` for each group, whose rows are ordered by stratum and item; one group a task.

    A group holds one row an item (a question), so a task never holds more than the questions.
    """
    cols = rows.select(*by, F.coalesce(F.col(stratum), F.lit("unknown")).alias("_s"), F.col(item).alias("_i"), *[F.col(v).cast("double").alias(k) for k, v in values.items()])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_s", "_i"])
        return pd.DataFrame([[*key, *solve(pdf["_s"].tolist(), [pdf[k].to_numpy(float) for k in values])]], columns=[*by, *[o.split()[0] for o in outputs.split(", ")]])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), outputs])
    return cols.groupBy(*by).applyInPandas(run, schema)


def bootstrap_mean(rows: DataFrame, by: Sequence[str], stratum: str, item: str, value: str, samples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean of a value and its percentile interval over resamples of the items, drawn within strata."""

    def solve(strata: list[str], values: list[np.ndarray]) -> tuple:
        v = values[0]
        ok = v[~np.isnan(v)]
        low, high = _interval(_means(v, resample_plan(strata, samples, seed)), level)
        return len(ok), ok.mean() if len(ok) else np.nan, low, high

    return _resampled(rows, by, stratum, item, {"_v": value}, solve, "n long, mean double, ci_low double, ci_high double")


def paired_summary(pairs: DataFrame, by: Sequence[str], stratum: str, item: str, left: str = "left_value", right: str = "right_value", samples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Means of both sides and of their difference, each with its interval over one shared plan of resampled items.

    ``pairs`` has one row an item and group of ``by`` (say, a metric); a pair counts if both
    sides have a value, and the plan covers all items, so the groups share it.
    """

    def solve(strata: list[str], values: list[np.ndarray]) -> list:
        a, b = values
        both = ~np.isnan(a) & ~np.isnan(b)
        plan = resample_plan(strata, samples, seed)
        out = [int(both.sum()), int((~both).sum())]
        for v in (a, b, b - a):
            v = np.where(both, v, np.nan)
            out += [np.nanmean(v) if both.any() else np.nan, *_interval(_means(v, plan), level)]
        return out

    cols = ", ".join(f"{side}_{what} double" for side in ("left", "right", "delta") for what in ("mean", "ci_low", "ci_high"))
    return _resampled(pairs, by, stratum, item, {"_a": left, "_b": right}, solve, f"paired long, missing long, {cols}")


def bootstrap_spearman(rows: DataFrame, by: Sequence[str], stratum: str, item: str, x: str, y: str, samples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Rank correlation of two columns and its interval over resamples of the items; null where a side is constant."""

    def solve(strata: list[str], values: list[np.ndarray]) -> tuple:
        both = ~np.isnan(values[0]) & ~np.isnan(values[1])
        a, b = (v[both] for v in values)
        plan = resample_plan([s for s, k in zip(strata, both) if k], samples, seed)
        rho = np.array([_spearman(a[p], b[p]) for p in plan]) if len(a) else np.empty(0)
        return len(a), _spearman(a, b), *_interval(rho[~np.isnan(rho)], level)

    return _resampled(rows, by, stratum, item, {"_x": x, "_y": y}, solve, "n long, spearman double, ci_low double, ci_high double")


def _spearman(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 2:
        return np.nan
    ranks = []
    for v in (a, b):
        _, place, count = np.unique(v, return_inverse=True, return_counts=True)
        ranks.append((np.cumsum(count) - (count - 1) / 2)[place])
    da, db = (r - r.mean() for r in ranks)
    scale = np.sqrt((da @ da) * (db @ db))
    return float(da @ db / scale) if scale > 0 else np.nan


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ranks from 1 in which equal values share the mean of their places."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ties = Window.partitionBy(*by, value)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation of two columns over the rows where both are finite, with ``n``."""
    ok = df.where(f"{x} is not null and {y} is not null and not isnan({x}) and not isnan({y})")
    r = average_rank(average_rank(ok, by, x, "_rx"), by, y, "_ry")
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("spearman"))


def loglog_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and R² of log y over log x, for positive values."""
    ok = df.where(f"{x} > 0 and {y} > 0").withColumn("_x", F.log(x)).withColumn("_y", F.log(y))
    return ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_r2("_y", "_x").alias("r2")
    )


def pareto_front(df: DataFrame, by: Sequence[str], cost: str, quality: str, tie: str) -> DataFrame:
    """Rows of higher quality than every row that costs less."""
    w = Window.partitionBy(*by).orderBy(cost, F.desc(quality), tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_best", F.max(quality).over(w)).where(f"_best is null or {quality} > _best + 1e-12").drop("_best")


def z_scores(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Adds ``z``: distance from the median in population standard deviations, null where there is none."""
    w = Window.partitionBy(*by)
    return df.withColumn("z", F.try_divide(F.col(value) - F.median(value).over(w), F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))))


def transitions(df: DataFrame, by: Sequence[str], before: str, after: str) -> DataFrame:
    """2 x 2 counts of a binary outcome before and after."""
    c = lambda p: F.sum(F.expr(f"cast({p} as int)")).alias
    return df.where(f"{before} is not null and {after} is not null").groupBy(*by).agg(
        c(f"{before} = 1 and {after} = 1")("both"), c(f"{before} = 1 and {after} = 0")("lost"), c(f"{before} = 0 and {after} = 1")("gained"), c(f"{before} = 0 and {after} = 0")("neither")
    )


def mcnemar(counts: DataFrame, lost: str = "lost", gained: str = "gained") -> DataFrame:
    """Adds ``p_value``: exact two-sided binomial test of the discordant counts."""
    n = F.col(lost) + F.col(gained)

    def log_fact(m):
        return F.aggregate(F.sequence(F.lit(0).cast("long"), m.cast("long")), F.lit(0.0), lambda s, i: s + F.when(i > 0, F.log(i.cast("double"))).otherwise(0.0))

    places = F.sequence(F.lit(0).cast("long"), F.least(lost, gained).cast("long"))
    tail = F.aggregate(places, F.lit(0.0), lambda s, i: s + F.exp(log_fact(n) - log_fact(i) - log_fact(n - i) - n * F.log(F.lit(2.0))))
    return counts.withColumn("p_value", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def holm(df: DataFrame, by: Sequence[str], p: str, tie: str) -> DataFrame:
    """Adds ``p_holm``: step-down adjusted p-values, never above 1."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    o = w.orderBy(p, tie)
    m = F.count(F.lit(1)).over(w)
    step = F.least(F.lit(1.0), (m - F.row_number().over(o) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("p_holm", F.max("_s").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
