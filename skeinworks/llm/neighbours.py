"""Most similar vectors for every vector, by stable projections in a kd-tree.

Unit vectors are projected to a few dimensions by Gaussian (2-stable) rows: for
two points at distance d the squared projected distance is d^2 times a chi-square
variable with as many degrees of freedom. Projected neighbours are visited box by
box of a kd-tree and verified by their true cosine; a query stops at the boxes for
which the chi-square test says that a better neighbour would, with probability
``p``, have been projected nearer. Its k-th best distance shrinks as it verifies.

The upper levels of the tree are fitted on a bounded sample and route vectors to
cells. With few cells a vector visits those that its test radius reaches; of two cells
one is visited from the other, and there both sides ask. The visitors of a cell are
dealt out to several tasks, each of which indexes the cell's own vectors, so that no
task grows with the crowd. The cells in reach become more as cells do, by far the
most of them without a neighbour; where that ships more, nobody visits, and several
trees of independent projections bring neighbours together in one of them. Exact copies
are collapsed to one vector first, so a vector that a third of all rows share is one point.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stage, pick

SEED = 20090
VERIFY = 4096
#: The share of neighbours that meet is measured with so many partners of each sampled vector, in each of so many regions.
PARTNERS, REGIONS = 4, 32
#: Visits miss far fewer neighbours than they may, since a box is nearer than what it holds; trees may miss this share of it only.
STRICT = 0.1


def chi2_quantile(p: float, m: int) -> float:
    """Quantile of the chi-square distribution, by bisection on its series."""

    def cdf(x: float) -> float:
        a, x = m / 2, x / 2
        if x <= 0:
            return 0.0
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    lo, hi = 0.0, 10.0 * m + 200
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(dim: int, m: int, number: int = 0) -> np.ndarray:
    return np.random.default_rng(SEED + number).standard_normal((dim, m)).astype(np.float32)


class Tree:
    """Binary tree of median splits over projected points; leaves know their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int, open_boxes: bool = False):
        self.leaves: list[np.ndarray] = []
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaf: list[int] = []
        self.cut: list[tuple[int, float]] = []
        self.directions = m = points.shape[1]
        inf = np.full(m, np.inf, np.float32)
        self._add(points, np.arange(len(points)), leaf, (-inf, inf) if open_boxes else None)

    def _add(self, p: np.ndarray, idx: np.ndarray, leaf: int, box) -> int:
        me = len(self.leaf)
        own = p[idx]
        low, high = (own.min(0), own.max(0)) if len(idx) else (np.zeros(p.shape[1], np.float32),) * 2
        self.lo.append(box[0] if box else low)
        self.hi.append(box[1] if box else high)
        for x in (self.left, self.right, self.leaf):
            x.append(-1)
        self.cut.append((0, 0.0))
        d = int(np.argmax(high - low)) if len(idx) else 0
        if len(idx) <= leaf or high[d] <= low[d]:
            self.leaf[me] = len(self.leaves)
            self.leaves.append(idx)
            return me
        value = float(np.median(own[:, d]))
        below = own[:, d] < value
        if not below.any():  # ties at the median
            value = float(own[own[:, d] > value, d].min())
            below = own[:, d] < value
        boxes = (None, None)
        if box:
            mid_hi, mid_lo = box[1].copy(), box[0].copy()
            mid_hi[d] = mid_lo[d] = value
            boxes = ((box[0], mid_hi), (mid_lo, box[1]))
        self.cut[me] = (d, value)
        a = self._add(p, idx[below], leaf, boxes[0])
        b = self._add(p, idx[~below], leaf, boxes[1])
        self.left[me], self.right[me] = a, b
        return me

    def home(self, q: np.ndarray) -> np.ndarray:
        """Leaf whose half-spaces hold each point."""
        out = np.zeros(len(q), np.int32)
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, idx = todo.pop()
            if self.leaf[node] >= 0:
                out[idx] = self.leaf[node]
                continue
            d, v = self.cut[node]
            below = q[idx, d] < v
            todo += [(self.left[node], idx[below]), (self.right[node], idx[~below])]
        return out

    def visits(self, q: np.ndarray, radius2) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries) for the leaves whose box lies within each query's radius.

        ``radius2`` is called with query indices when a box is reached, so radii may shrink
        meanwhile. Of two boxes the one nearer to most of the queries comes first.
        """
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, idx = todo.pop()
            x = q[idx]
            gap = np.maximum(np.maximum(self.lo[node] - x, x - self.hi[node]), 0)
            idx = idx[np.einsum("ij,ij->i", gap, gap) <= radius2(idx)]
            if not len(idx):
                continue
            if self.leaf[node] >= 0:
                yield self.leaf[node], idx
            else:
                d, value = self.cut[node]
                below = 2 * np.count_nonzero(q[idx, d] < value) >= len(idx)
                near, far = (self.left[node], self.right[node]) if below else (self.right[node], self.left[node])
                todo += [(far, idx), (near, idx)]


def search(base: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, m: int, chi: float, max_d2: float, leaf: int = 64, number: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k best base rows of each query by cosine: (row or -1, cosine).

    ``own`` is the base row that a query is itself (or -1); it is never its own neighbour.
    ``number`` is that of the projection.
    """
    a = projection(base.shape[1], m, number)
    pb, pq = base @ a, queries @ a
    tree = Tree(pb, leaf)
    n = len(queries)
    best_s = np.full((n, k), np.float32(1 - max_d2 / 2) - np.float32(1e-6), np.float32)
    best_i = np.full((n, k), -1, np.int64)

    def verify(members: np.ndarray, idx: np.ndarray, at_home: bool = False) -> None:
        """Offers all members to the queries, in blocks of bounded memory."""
        for b in range(0, len(members), VERIFY):
            for c in range(0, len(idx), VERIFY):
                offer(members[b : b + VERIFY], idx[c : c + VERIFY], at_home)

    def offer(members: np.ndarray, idx: np.ndarray, at_home: bool) -> None:
        s = queries[idx] @ base[members].T
        if at_home:  # only there is a query among the members
            s[own[idx][:, None] == members[None, :]] = -2
        hit = np.flatnonzero(s.max(1, initial=-2) > best_s[idx, k - 1])
        if not len(hit):
            return
        # offer the members to the queries hit, several at a time in rank order
        full = s[hit]
        take = min(k, full.shape[1])
        top = np.argpartition(-full, take - 1, axis=1)[:, :take]
        cs = np.concatenate([best_s[idx[hit]], np.take_along_axis(full, top, 1)], 1)
        ci = np.concatenate([best_i[idx[hit]], members[top]], 1)
        order = np.argsort(-cs, axis=1, kind="stable")[:, :k]
        best_s[idx[hit]] = np.take_along_axis(cs, order, 1)
        best_i[idx[hit]] = np.take_along_axis(ci, order, 1)

    inside = own >= 0
    at_home = np.full(n, -1, np.int32)
    where = np.empty(len(base), np.int32)
    for i, members in enumerate(tree.leaves):
        where[members] = i
    at_home[inside] = where[own[inside]]
    order = np.argsort(at_home, kind="stable")
    bounds = np.searchsorted(at_home[order], np.arange(len(tree.leaves) + 1))
    for i, members in enumerate(tree.leaves):
        mine = order[bounds[i] : bounds[i + 1]]
        if len(mine):
            verify(members, mine, True)

    def radius2(idx: np.ndarray) -> np.ndarray:
        return 2 * (1 - best_s[idx, k - 1]) * np.float32(chi)

    for i, idx in tree.visits(pq, radius2):
        verify(tree.leaves[i], idx[at_home[idx] != i])
    return best_i, best_s


def visits_from(home: np.ndarray, cell: int) -> np.ndarray:
    """Whether vectors of these homes visit the cell; of any two cells one is visited from the other."""
    return (home != cell) & ((home < cell) ^ ((home + cell) % 2 == 1))


def meeting_trees(top: np.ndarray, leaf: int, max_d2: float, p: float, most: float) -> list[Tree] | None:
    """Trees of independent projections, fewer than ``most``, in which neighbours share a cell often enough.

    Each vector of the sample ``top`` gets partners at the edge of the radius. Trees are added
    until, in every region of the sample, a search that finds with probability ``p`` what shares
    its cell misses at most ``STRICT * (1 - p)`` of the partners. Crowds, which the trees cut through, keep
    apart however many there are; then there is no such list. A tree has a direction for each
    of its levels, since a second cut of the same one parts more neighbours than the first.
    """
    dim, levels = top.shape[1], math.ceil(math.log2(len(top) / leaf)) + 1
    rng = np.random.default_rng(SEED)
    x = np.tile(top, (PARTNERS, 1))
    aside = rng.standard_normal(x.shape).astype(np.float32)
    aside -= x * np.einsum("ij,ij->i", x, aside)[:, None]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cos = 1 - max_d2 / 2
    partner = np.float32(cos) * x + np.float32(math.sqrt(max(0.0, 1 - cos * cos))) * aside
    a = projection(dim, levels, -1)
    regions = Tree(top @ a, max(1, len(top) // REGIONS), open_boxes=True)
    region = regions.home(x @ a)
    size = np.maximum(1, np.bincount(region, minlength=len(regions.leaves)))
    missed, trees = np.ones(len(x)), []
    while len(trees) + 1 < most:
        a = projection(dim, levels, len(trees))
        trees.append(Tree(top @ a, leaf, open_boxes=True))
        missed[trees[-1].home(x @ a) == trees[-1].home(partner @ a)] *= 1 - p
        worst, goal = (np.bincount(region, missed, len(regions.leaves)) / size).max(), STRICT * (1 - p)
        if worst <= goal:
            return trees
        if len(trees) > 1 and worst >= goal ** (len(trees) / most):  # the first trees gain most, so it would take more
            return None
    return None


def routes(top: np.ndarray, n: int, cells: int, m: int, max_d2: float, p: float, task_rows: int) -> tuple[list[tuple[Tree, np.ndarray, np.ndarray]], float]:
    """``(tree, tasks of each cell, number of the first)`` of each tree, and how often a vector is sent.

    ``top`` is a sample of the ``n`` unit vectors. One tree means that its cells are visited.
    """
    if cells < 2:
        return [(Tree(np.zeros((1, m), np.float32), 1, open_boxes=True), np.ones(1, np.int64), np.zeros(1, np.int64))], 1.0
    leaf, scale = -(-len(top) // cells), n / len(top)  # rounded up, else an odd row more makes two cells of one
    q = top @ projection(top.shape[1], m)
    tree = Tree(q, leaf, open_boxes=True)
    home, reach = tree.home(q), np.float32(max_d2 * chi2_quantile(p, m))
    own = np.bincount(home, minlength=len(tree.leaves))
    crowd = own.copy()
    for cell, idx in tree.visits(q, lambda i: reach):
        crowd[cell] += np.count_nonzero(visits_from(home[idx], cell))
    tasks = np.maximum(1, np.ceil(crowd * scale / task_rows)).astype(np.int64)
    sent = float((crowd + (tasks - 1) * own).sum() / len(top))
    trees = meeting_trees(top, leaf, max_d2, p, sent)
    if trees is None:
        return [(tree, tasks, np.cumsum(tasks) - tasks)], sent
    ends = np.cumsum([0, *(len(t.leaves) for t in trees)])
    return [(t, np.ones(len(t.leaves), np.int64), at + np.arange(len(t.leaves))) for t, at in zip(trees, ends[:-1], strict=True)], float(len(trees))


def usable_vectors(rows: DataFrame, id_col: str, vector: str, dim: int, newest: str | None = None) -> DataFrame:
    """``(id, v)`` of the rows whose vector counts, one row an id.

    Vectors that are null, not of ``dim`` numbers, hold a null or a number that is not
    finite, or are all zero do not count; nor do null ids. Of an id delivered more
    than once the newest usable row by ``newest`` counts.
    """
    r = pick(rows, id=id_col, v=vector, **({"at": newest} if newest else {}))
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    r = r.where(f"id is not null and v is not null and size(v) = {int(dim)}").where(finite)
    r = r.withColumn("v", F.col("v").cast("array<float>"))
    key = F.struct(*(["at"] if newest else []), "v")
    return r.groupBy("id").agg(F.max(key).alias("x")).select("id", "x.v")


def _unit(v: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(v.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _collapse(vectors: DataFrame, k: int, stage: Stage, small: int = 200_000) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Points of the index, copies ``(id, rep, ids)`` of any of them, and ``(rep, ids)``.

    Only hashes of the vectors are shuffled to find copies; a side is broadcast when it
    has at most ``small`` rows. ``ids`` are the first ``k + 1`` ids of a vector, ``rep``
    the first; they are picked in two steps over salted parts, so a vector that a
    third of all rows share is no single task's.
    """
    near = lambda df: F.broadcast(df) if df.count() <= small else df
    hashed = vectors.withColumn("h", F.xxhash64("v"))
    dups = stage.write(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "dups")
    if dups.isEmpty():
        return vectors, None, None
    copies = stage.write(hashed.join(near(dups), "h").select("id", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")), "copies")
    few = lambda df, *by: df.withColumn("r", F.expr(f"row_number() over (partition by {', '.join(by)} order by id)")).where(f"r <= {k + 1}").drop("r")
    first = few(few(copies, "v", "salt"), "v").groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).where("size(ids) > 1")
    first = stage.write(first.select("v", F.col("ids")[0].alias("rep"), "ids"), "first")
    members = stage.write(copies.join(near(first), "v").select("id", "rep", "ids"), "members")
    others = members.where("id <> rep").select("id")
    return vectors.join(near(others), "id", "left_anti"), members, first.select("rep", "ids")


def nearest(
    vectors: DataFrame, dim: int, k: int, max_distance: float = 2.0, m: int = 6, p: float = 0.95, cell_rows: int = 65536, task_rows: int = 262144, sample_rows: int = 20000, stage: Stage | None = None
) -> DataFrame:
    """``(id, neighbour, cosine)``: the up to ``k`` most similar other ids of every id.

    ``vectors`` has distinct ids and ``v``, as from :func:`usable_vectors`. Only
    neighbours within the Euclidean ``max_distance`` of the unit vectors are
    reported (2 for all). A neighbour within a query's k-th distance is missed with
    a probability of at most ``1 - p``. Equal cosines rank by id. Every vector is
    indexed; only the upper trees are fitted on a sample of ``sample_rows``, which also tells
    whether cells are visited or several trees are used, and how many tasks a cell needs
    so that each holds about ``task_rows`` visitors.

    Exact copies of a vector are one point of the index. Its first ``k + 1`` ids stand
    for it in the neighbour lists of others; each copy has the first others as its own.
    """
    spark = vectors.sparkSession
    stage = stage or Stage(spark, "neighbours")
    points, members, reps = _collapse(vectors, k, stage)
    n = points.count()
    schema = "task long, base boolean, asks boolean, id string, v array<float>"
    cells = max(1, -(-n // cell_rows))
    chi, max_d2 = chi2_quantile(p, m), max_distance**2
    reach = np.float32(max_d2 * chi)
    top = np.zeros((0, dim))
    if cells > 1:
        sample = points.select("v").sample(min(1.0, sample_rows / n), SEED)
        top = np.array([r["v"] for r in sample.limit(2 * sample_rows).collect()], np.float64)
        top = (top / np.linalg.norm(top, axis=1, keepdims=True)).astype(np.float32)
    plan, _ = routes(top, n, cells, m, max_d2, p, task_rows)
    router = spark.sparkContext.broadcast(plan)
    starts = [int(first[0]) for _, _, first in plan]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = batch.column(0), batch.column(1)
            x = _unit(v, dim)
            seat = np.array([zlib.crc32(i.encode()) for i in ids.to_pylist()], np.int64)

            def send(task: np.ndarray, idx: np.ndarray, base: bool, asks: bool) -> pa.RecordBatch:
                take = pa.array(idx)
                flag = lambda x: pa.array(np.full(len(idx), x))
                return pa.RecordBatch.from_arrays([pa.array(task), flag(base), flag(asks), ids.take(take), v.take(take)], names=["task", "base", "asks", "id", "v"])

            for number, (tree, tasks, first) in enumerate(router.value):
                q = x @ projection(dim, tree.directions, number)
                home = tree.home(q)
                # a cell's own vectors are in all of its tasks and ask each other in one; a visitor is in one
                for turn in range(int(tasks[home].max(initial=0))):
                    mine = np.flatnonzero(tasks[home] > turn)
                    at = home[mine]
                    yield send(first[at] + (seat[mine] + turn) % tasks[at], mine, True, turn == 0)
                if len(router.value) > 1:
                    continue
                for cell, idx in tree.visits(q, lambda i: reach):
                    idx = idx[visits_from(home[idx], cell)]
                    if len(idx):
                        yield send(first[cell] + seat[idx] % tasks[cell], idx, False, True)

    def solve(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, ids = _unit(t["v"].combine_chunks(), dim), t["id"].combine_chunks()
        is_base = t["base"].to_numpy()
        base, asks, visitors = np.flatnonzero(is_base), np.flatnonzero(t["asks"].to_numpy()), np.flatnonzero(~is_base)
        number = int(np.searchsorted(starts, t["task"][0].as_py(), "right")) - 1
        own = np.full(len(x), -1, np.int64)
        own[base] = np.arange(len(base))

        def best(asks: np.ndarray, others: np.ndarray, own: np.ndarray) -> pa.Table:
            i, _ = search(x[others], x[asks], own, k, m, chi, max_d2, number=number)
            q, c = np.nonzero(i >= 0)
            one, other = asks[q], others[i[q, c]]
            a, b = x[one].astype(np.float64), x[other].astype(np.float64)
            return pa.table({"id": ids.take(pa.array(one)), "neighbour": ids.take(pa.array(other)), "cosine": np.einsum("ij,ij->i", a, b)})

        found = [best(asks, base, own[asks])]
        if len(visitors):
            found.append(best(base, visitors, np.full(len(base), -1, np.int64)))
        return pa.concat_tables(found)

    # a fixed number, since tasks that search for long are not to be coalesced by their few bytes
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * sum(int(tasks.sum()) for _, tasks, _ in plan))
    routed = points.select("id", "v").mapInArrow(route, schema).repartition(partitions, "task")
    found = routed.groupBy("task").applyInArrow(solve, "id string, neighbour string, cosine double")
    if len(plan) > 1:  # some meet in several trees
        found = found.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    if members is None:
        lists = found
    else:
        # a copy stands in for its point, and its fellow copies come first
        fellows = members.select("id", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine")).where("id <> neighbour")
        for_others = found.join(reps.withColumnRenamed("rep", "neighbour"), "neighbour", "left").select(
            "id", F.explode(F.coalesce("ids", F.array("neighbour"))).alias("neighbour"), "cosine"
        )
        every = for_others.join(members.select(F.col("id").alias("member"), F.col("rep").alias("id")), "id", "left").select(
            F.coalesce("member", "id").alias("id"), "neighbour", "cosine"
        )
        lists = every.unionByName(fellows)
    ranked = lists.selectExpr("*", "row_number() over (partition by id order by cosine desc, neighbour) as rank")
    return ranked.where(F.col("rank") <= k)


def mutual_neighbours(mentions: DataFrame, min_cosine: float = 0.975, k: int = 5, dim: int = 32, **options) -> DataFrame:
    """``(mention_a, mention_b)``, a < b: pairs of at least ``min_cosine`` that are each among the k most similar of the other."""
    v = usable_vectors(mentions, "mention_id", "embedding", dim, "ingested_at")
    stage = Stage(mentions.sparkSession, "neighbours")
    v = stage.write(v, "vectors")
    near = nearest(v, dim, k, max_distance=math.sqrt(2 * (1 - min_cosine)), stage=stage, **options)
    near = near.where(F.col("cosine") >= min_cosine)
    pair = near.select(F.least("id", "neighbour").alias("mention_a"), F.greatest("id", "neighbour").alias("mention_b"))
    return pair.groupBy("mention_a", "mention_b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("mention_a", "mention_b")
