"""Mergeable percentiles of large numeric columns: dyadic count-sketches.

A non-negative value is encoded as the leading bits of its 32-bit float, which
keeps order and at most a relative error of 2^-12. For every binary resolution of
the codes there is one signed count-sketch (coarse resolutions with few nodes have
plain counters). All cells are sums, so sketches of partitions, runs or days merge
by addition and a reading is taken out again by adding it with weight -1. A rank is
inverted by descending from the coarsest level to the finest.

Partial sketches travel as (code, weight) lists where that is smaller than the
cells; both forms add up to the same sketch. A group's state is bounded however
many readings it has, its partial sums are made before the shuffle, and the partial
sketches of one group meet in two steps over salted parts, so that no task holds
more of them than a fraction of the map tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Stage, pick

BITS = 20
_SHIFT = 11
RELATIVE_ERROR = 2.0**-12


class Layout:
    """Where each level's counters stand in the flat array of a sketch."""

    def __init__(self, width: int = 1024, depth: int = 5):
        if width & (width - 1) or depth % 2 == 0:
            raise ValueError("width is a power of 2, depth is odd")
        self.width, self.depth = width, depth
        self.offsets, at = [], 0
        for level in range(BITS):
            nodes = 1 << (BITS - level)
            self.offsets.append(at)
            at += nodes if self.plain(level) else width * depth
        self.cells = at

    def plain(self, level: int) -> bool:
        return (1 << (BITS - level)) <= 2 * self.width

    def place(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells and signs of some nodes of a level, one row for each hash."""
        if self.plain(level):
            return (self.offsets[level] + nodes)[None, :], np.ones((1, len(nodes)), np.int64)
        rows = np.arange(1, self.depth + 1, dtype=np.uint64)[:, None]
        with np.errstate(over="ignore"):
            h = (nodes.astype(np.uint64)[None, :] + np.uint64(1 + level)) * np.uint64(0x9E3779B97F4A7C15) * (rows * np.uint64(2) + np.uint64(1))
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        col = (h >> np.uint64(40)) & np.uint64(self.width - 1)
        sign = 1 - 2 * ((h >> np.uint64(13)) & np.uint64(1)).astype(np.int64)
        return (self.offsets[level] + (rows.astype(np.int64) - 1) * self.width + col.astype(np.int64)), sign

    def add(self, cells: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> None:
        for level in range(BITS):
            at, sign = self.place(level, codes >> level)
            np.add.at(cells, at, sign * weights[None, :])

    def estimate(self, cells: np.ndarray, level: int, node: int) -> float:
        at, sign = self.place(level, np.array([node]))
        return float(np.median(cells[at[:, 0]] * sign[:, 0]))

    def rank_error(self, cells: np.ndarray, z: float = 3.0) -> float:
        """``z`` standard errors of a rank, from the sketch's own second moments.

        An estimate is the median of ``depth`` rows; its standard error is about
        1.2533 / sqrt(depth) of a single row's.
        """
        var = 0.0
        for level in range(BITS):
            if not self.plain(level):
                block = cells[self.offsets[level] : self.offsets[level] + self.width * self.depth].reshape(self.depth, self.width).astype(float)
                var += float(np.median((block**2).sum(1))) / self.width
        return z * (1.0 if self.depth == 1 else 1.2533 / self.depth**0.5) * var**0.5

    def code_at(self, cells: np.ndarray, rank: float) -> int:
        """Code of the reading of that rank (from 1)."""
        node, left = 0, rank
        for level in range(BITS - 1, -1, -1):
            node *= 2
            low = self.estimate(cells, level, node)
            if left > low:
                left -= low
                node += 1
        return node


def encode(values: np.ndarray) -> np.ndarray:
    return (values.astype(np.float32).view(np.uint32) >> _SHIFT).astype(np.int64)


def decode(code: int) -> tuple[float, float]:
    """Least value of a code, and of the next."""
    a, b = np.array([code << _SHIFT, (code + 1) << _SHIFT], np.uint32).view(np.float32)
    return float(a), float(b)


def sketch(readings: DataFrame, by: Sequence[str], value: str, weight: str | None = None, width: int = 1024, depth: int = 5, fan: int = 64) -> DataFrame:
    """One row a group: the ``by`` columns, ``n`` (sum of weights) and ``cells``
    (the counters, compressed).

    Null, NaN, infinite and negative values are left out. ``weight`` is a column of
    signed counts, 1 if not given. Groups without a reading have no row. Null group
    values form a group. Partial sketches of a group are added up in ``fan`` salted parts
    first and then in one.
    """
    cols = {c: c for c in by} | {"_v": value} | ({"_w": weight} if weight else {})
    r = pick(readings, **cols).where("_v is not null and not isnan(_v) and _v >= 0 and _v < double('Infinity')")
    r = r.select(*by, F.col("_v").cast("double"), (F.col("_w").cast("long") if weight else F.lit(1).cast("long")).alias("_w"))
    lay = Layout(width, depth)
    keys = [r.schema[c] for c in by]
    partial = T.StructType([*keys, T.StructField("codes", T.BinaryType()), T.StructField("cells", T.BinaryType())])
    flush_at = 4_000_000

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        dense: dict[tuple, np.ndarray] = {}
        size = 0
        types = None

        def shrink(key: tuple) -> tuple[np.ndarray, np.ndarray]:
            both = np.concatenate(held[key], axis=1)
            code, inverse = np.unique(both[0], return_inverse=True)
            w = np.bincount(inverse, both[1]).astype(np.int64)
            held[key] = [np.stack([code, w])]
            return code, w

        def out() -> Iterator[pa.RecordBatch]:
            for key in held:
                shrink(key)
            rows = [(k, held[k][0].astype(np.int64).tobytes() if k in held else None, dense[k].tobytes() if k in dense else None) for k in {**held, **dense}]
            for a in range(0, len(rows), 512):
                some = rows[a : a + 512]
                arrays = [pa.array([k[i] for k, _, _ in some], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([c for _, c, _ in some], pa.binary()), pa.array([d for _, _, d in some], pa.binary())], names=partial.names)
            held.clear()
            dense.clear()

        for b in batches:
            types = [b.schema.field(i).type for i in range(len(by))]
            code, w = encode(b.column(len(by)).to_numpy()), b.column(len(by) + 1).to_numpy()
            group, names = _groups(b, len(by))
            order = np.argsort(group, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                if not len(at):
                    continue
                key = names[group[at[0]]]
                held.setdefault(key, []).append(np.stack([code[at], w[at]]))
                size += len(at)
                if sum(x.shape[1] for x in held[key]) > 2 * lay.cells:
                    c, ws = shrink(key)
                    if len(c) * 4 > lay.cells:
                        lay.add(dense.setdefault(key, np.zeros(lay.cells, np.int64)), c, ws)
                        del held[key]
            if size > flush_at:
                yield from out()
                size = 0
        if held or dense:
            yield from out()

    def total(t: pa.Table) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Sum of some partial sketches: as codes while those are few, and as cells."""
        lists = [np.frombuffer(c, np.int64).reshape(2, -1) for c in t.column("codes").to_pylist() if c]
        both, cells = None, None
        if lists:
            every = np.concatenate(lists, axis=1)
            code, inverse = np.unique(every[0], return_inverse=True)
            both = np.stack([code, np.bincount(inverse, every[1]).astype(np.int64)])
        for dense in t.column("cells").to_pylist():
            if dense:
                cells = np.frombuffer(dense, np.int64) + (0 if cells is None else cells)
        return both, cells

    def fold(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        both, cells = total(t)
        if both is not None and both.shape[1] * 4 > lay.cells:
            cells = np.zeros(lay.cells, np.int64) if cells is None else cells.copy()
            lay.add(cells, both[0], both[1])
            both = None
        sums = [pa.array([None if x is None else x.tobytes()], pa.binary()) for x in (both, cells)]
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key[: len(by)]], *sums], names=partial.names)

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        both, cells = total(t)
        cells = np.zeros(lay.cells, np.int64) if cells is None else cells.copy()
        if both is not None:
            lay.add(cells, both[0], both[1])
        top = lay.offsets[BITS - 1]
        n = int(cells[top] + cells[top + 1])
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], pa.array([n], pa.int64()), pa.array([zlib.compress(cells.astype("<i8").tobytes(), 1)], pa.binary())], names=[*by, "n", "cells"])

    schema = T.StructType([*keys, T.StructField("n", T.LongType()), T.StructField("cells", T.BinaryType())])
    # merging takes far more time than its few bytes suggest, so partitions are not to be coalesced by size
    n = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = r.mapInArrow(parts, partial).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(max(1, fan))))
    some = sent.groupBy(*by, "_salt").applyInArrow(fold, partial)
    return (some.repartition(n, *by) if by else some).groupBy(*by).applyInArrow(merge, schema)


def _groups(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, list[tuple]]:
    """Group number of each row, and the groups' values."""
    number = np.zeros(batch.num_rows, np.int64)
    for i in range(n):
        coded = pc.dictionary_encode(batch.column(i), null_encoding="encode")
        number = number * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
    _, first, group = np.unique(number, return_index=True, return_inverse=True)
    where = pa.array(first)
    return group, list(zip(*(batch.column(i).take(where).to_pylist() for i in range(n)))) if n else [()] * len(first)


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the sketches (of one width and depth) that share the ``by`` columns."""
    keys = [sketches.schema[c] for c in by]

    def add(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        cells = np.sum([np.frombuffer(zlib.decompress(c), "<i8") for c in t.column("cells").to_pylist()], axis=0)
        n = sum(t.column("n").to_pylist())
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], pa.array([n], pa.int64()), pa.array([zlib.compress(cells.astype("<i8").tobytes(), 1)], pa.binary())], names=[*by, "n", "cells"])

    return sketches.select(*by, "n", "cells").groupBy(*by).applyInArrow(add, T.StructType([*keys, T.StructField("n", T.LongType()), T.StructField("cells", T.BinaryType())]))


def percentiles(sketches: DataFrame, by: Sequence[str], fractions: Sequence[float], width: int = 1024, depth: int = 5) -> DataFrame:
    """``by``, ``n``, ``fraction``, ``value``, ``low``, ``high``, ``rank_error`` from sketches.

    The percentile is the smallest reading that at least the fraction of readings do not
    exceed. ``low`` and ``high`` enclose it with three standard errors of the rank,
    ``rank_error``, and the relative error of the codes. Groups whose weights sum to
    less than 1 have no row.
    """
    lay = Layout(width, depth)
    keys = [sketches.schema[c] for c in by]
    extra = [("n", "bigint"), ("fraction", "double"), ("value", "double"), ("low", "double"), ("high", "double"), ("rank_error", "double")]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (n, raw) in enumerate(zip(b.column(len(by)).to_pylist(), b.column(len(by) + 1).to_pylist())):
                if n < 1:
                    continue
                cells = np.frombuffer(zlib.decompress(raw), "<i8")
                error = lay.rank_error(cells)
                for f in fractions:
                    rank = min(n, max(1, int(np.ceil(round(f * n, 9)))))
                    a, b2 = decode(lay.code_at(cells, rank))
                    low = decode(lay.code_at(cells, max(1.0, rank - error)))[0]
                    high = decode(lay.code_at(cells, min(float(n), rank + error)))[1]
                    rows.append((i, n, f, (a + b2) / 2, low, high, error))
            cols = list(zip(*rows)) or [[]] * 7
            take = pa.array(cols[0], pa.int64())
            values = [pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), *[pa.float64()] * 5))]
            yield pa.RecordBatch.from_arrays([*[b.column(j).take(take) for j in range(len(by))], *values], names=[*by, *[k for k, _ in extra]])

    schema = T.StructType([*keys, *[T.StructField(k, T._parse_datatype_string(t)) for k, t in extra]])
    return sketches.select(*by, "n", "cells").mapInArrow(solve, schema)


KEYS = ("base_run_id", "builder_key", "regime")


def latency_readings(rows: DataFrame, id_col: str, at: str, value: str = "latency_ms") -> DataFrame:
    """One valid reading an id: ``KEYS`` and ``latency_ms``. Of repeated ids the newest valid row counts."""
    r = pick(rows, id=id_col, base_run_id="base_run_id", builder_key="builder_model", regime="graph_regime", latency_ms=value, at=at)
    r = r.where("id is not null and latency_ms is not null and not isnan(latency_ms) and latency_ms >= 0")
    newest = r.groupBy("id").agg(F.max(F.struct("at", "latency_ms", *KEYS)).alias("x"))
    return newest.select(*[F.col(f"x.{k}") for k in KEYS], F.col("x.latency_ms"))


def judge_p95(retrievals: DataFrame, published: DataFrame, tolerance: float = 0.2, **size: int) -> DataFrame:
    """``KEYS, wrong, counted`` of published rows with a figure whose group has a reading.

    ``wrong`` tells whether ``retrieval_latency_p95_s`` is off by more than ``tolerance`` of
    the true one. The sketch of each group encloses the percentile; where the enclosure lies
    wholly within or wholly beyond the tolerance it settles the row. For the others
    (``counted``) an exact check follows: the readings on each side of the two limits are
    counted.
    """
    stage = Stage(retrievals.sparkSession, "quantiles")
    readings = stage.write(latency_readings(retrievals, "retrieval_result_id", "retrieved_at"), "readings")
    p95 = percentiles(sketch(readings, KEYS, "latency_ms", **size), KEYS, [0.95], **size)
    pub = pick(published, **{k: k for k in KEYS}, pub="retrieval_latency_p95_s").dropna(subset=["pub"]).distinct().withColumn("pub", F.col("pub") * 1000)
    # a percentile x is off if pub > (1 + t) x or pub < (1 - t) x
    over, under = f"pub > {1 + tolerance}D * {{}}", f"pub < {1 - tolerance}D * {{}}"
    judged = stage.write(
        pub.join(p95, list(KEYS)).selectExpr(
            *KEYS,
            "pub",
            f"({over.format('high')}) or ({under.format('low')}) as wrong",
            f"not ({over.format('low')}) and not ({under.format('high')}) as right",
        ),
        "judged",
    )
    open_rows = judged.where("not wrong and not right").select(*KEYS, "pub")
    sides = [F.sum(F.expr(f"cast({side.format('latency_ms')} as int)")).alias(name) for side, name in ((over, "over"), (under, "under"))]
    counted = readings.join(open_rows, list(KEYS)).groupBy(*KEYS, "pub").agg(F.count(F.lit(1)).alias("n"), *sides)
    # the true percentile has rank ceil(0.95 n); readings beyond a limit are a prefix or a suffix of the order
    rank = "cast(ceil(round(0.95D * n, 9)) as bigint)"
    checked = counted.selectExpr(*KEYS, f"over >= {rank} or under >= n - {rank} + 1 as wrong", "true as counted")
    return judged.where("wrong or right").selectExpr(*KEYS, "wrong", "false as counted").unionByName(checked)


def wrong_p95(retrievals: DataFrame, published: DataFrame, tolerance: float = 0.2, **size: int) -> DataFrame:
    """``KEYS`` of the published rows that :func:`judge_p95` finds wrong.

    Rows with a null figure or whose group has no reading are not reported.
    """
    return judge_p95(retrievals, published, tolerance, **size).where("wrong").select(*KEYS).distinct()
