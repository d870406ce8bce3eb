"""Corpus selection: quotas, greedy choice under caps, hard negatives."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import Stage
from . import retrieval


def balanced_quotas(groups: DataFrame, group: str, total: int, seed: str) -> DataFrame:
    """``(group, quota)``: an even split of a total; what is left over goes to the groups of smallest hash."""
    g = groups.select(group).where(F.col(group).isNotNull()).distinct()
    n = g.count()
    if not n:
        return g.withColumn("quota", F.lit(0).cast("long"))
    each, rest = divmod(total, n)
    extra = g.orderBy(retrieval.stable_tie(seed, F.col(group).cast("string")), group).limit(rest).withColumn("_x", F.lit(1))
    return g.join(extra, group, "left").select(group, (F.lit(each) + F.coalesce("_x", F.lit(0))).cast("long").alias("quota"))


def quota_schedule(quotas: DataFrame, group: str) -> DataFrame:
    """``(position, group)``: the groups in turn, each as often as its quota.

    The place of a group's k-th turn is the turns before round k, which is the sum of the
    quotas cut at k, and the groups before it that still have a turn; only rounds and groups
    meet, never turns.
    """
    from pyspark.sql import Window

    turns = quotas.where("quota > 0").select(group, F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("round"))
    per = turns.groupBy("round").agg(F.count(F.lit(1)).alias("n"))
    before = per.select("round", (F.sum("n").over(Window.orderBy("round")) - F.col("n")).alias("before"))
    inside = turns.withColumn("k", F.row_number().over(Window.partitionBy("round").orderBy(group)))
    return inside.join(before, "round").select((F.col("before") + F.col("k")).alias("position"), group)


def concentration_delta(count: Column, added: Column) -> Column:
    """Growth of the sum of squared counts when ``added`` join ``count``."""
    return (count + added) * (count + added) - count * count


def stratified_sample(rows: DataFrame, stratum: str, key: str, quotas: DataFrame, seed: str) -> DataFrame:
    """The quota of each stratum, from ``(stratum, quota)``, taken in order of a seeded hash.

    The window keeps only the first rows of each stratum before it is sorted as a whole.
    """
    from pyspark.sql import Window

    tie = retrieval.stable_tie(seed, F.col(key).cast("string"))
    top = quotas.agg(F.max("quota")).first()[0] or 0
    ranked = rows.withColumn("_t", tie).withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_t", key))).where(F.col("_n") <= int(top))
    return ranked.join(quotas.select(stratum, "quota"), stratum).where("_n <= quota").select(*rows.columns)


def hard_negatives(scores: DataFrame, gold: DataFrame, answered: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """The ``k`` best scored documents of each query that are neither gold nor hold its answer."""
    s = scores.where("score > 0").join(gold.select(query, doc), [query, doc], "left_anti").join(answered.select(query, doc), [query, doc], "left_anti")
    return retrieval.top_k(s, query, doc, k)


def answer_holders(documents: DataFrame, doc: str, text: str, questions: DataFrame, query: str, answer: str, max_bytes: int = 32 << 20) -> DataFrame:
    """``(query, doc)`` of every document whose whole text holds the words of a question's answer in a row.

    Answers are broadcast in blocks of at most ``max_bytes``, and each document is read once
    a block by an automaton of all the block's answers. Generic and empty answers are held by
    none.
    """
    from ..functions import text as T

    phrase = T.normalized_phrase(F.col(answer))
    a = questions.where(~F.lower(F.trim(answer)).isin(*T.GENERIC_ANSWERS)).select(phrase.alias("p"), F.col(query).alias("q")).where("p <> ''").distinct()
    total = a.agg(F.sum(F.octet_length("p") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // max_bytes))
    d = documents.select(doc, F.concat(F.lit(" "), T.normalized_phrase(F.col(text)), F.lit(" ")).alias("w")).where(F.col("w").isNotNull())
    kinds = (documents.schema[doc].dataType.simpleString(), questions.schema[query].dataType.simpleString())
    out = None
    for k in range(blocks):
        asked: dict[str, list] = {}
        for r in a.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == k).collect():
            asked.setdefault(f" {r['p']} ", []).append(r["q"])
        held = documents.sparkSession.sparkContext.broadcast(asked)

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for p, ids in held.value.items():
                automaton.add_word(p, ids)
            automaton.make_automaton()
            for b in batches:
                rows, ids = [], []
                for i, w in enumerate(b.column(1).to_pylist()):
                    for q in {q for _, qs in automaton.iter(w) for q in qs} if len(automaton) else ():
                        rows.append(i)
                        ids.append(q)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, kind)], names=[doc, query])

        kind = pa.int64() if kinds[1] == "bigint" else pa.string()
        hit = d.mapInArrow(find, f"{doc} {kinds[0]}, {query} {kinds[1]}").select(query, doc)
        out = hit if out is None else out.unionByName(hit)
    return out


def greedy_select(candidates: DataFrame, item: str, value: str, caps: dict[str, int], size: int) -> DataFrame:
    """Up to ``size`` items of highest value such that no group of a capped column is chosen more often than its cap.

    Choice is sequential, so it runs in one task, but not over all candidates: of the items
    that share their group in every capped column no more than the tightest cap can be
    chosen, and those are the best; without caps the ``size`` best are.
    """
    from pyspark.sql import Window

    cols = sorted(caps)
    order = [F.desc(value), F.col(item)]
    c = candidates.select(item, value, *cols).where(F.col(value).isNotNull())
    if cols:
        c = c.withColumn("_n", F.row_number().over(Window.partitionBy(*cols).orderBy(*order))).where(F.col("_n") <= min(size, *caps.values())).drop("_n")
    else:
        c = c.orderBy(*order).limit(size)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict[tuple[str, object], int] = {}
        out = []
        for row in pdf.sort_values([value, item], ascending=[False, True]).to_dict("records"):
            keys = [(g, row[g]) for g in cols]
            if len(out) < size and all(used.get(x, 0) < caps[x[0]] for x in keys):
                for x in keys:
                    used[x] = used.get(x, 0) + 1
                out.append(row[item])
        return pd.DataFrame({item: out, "position": range(1, len(out) + 1)})

    kind = candidates.schema[item].dataType.simpleString()
    return c.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(solve, f"{item} {kind}, position long")


def facility_negatives(scores: DataFrame, documents: DataFrame, query: str, doc: str, size: int, caps: dict[str, int], seed: str, keep: int = 256) -> DataFrame:
    """``(doc, position, owner, gain)``: documents that together stay as close as possible to all queries.

    ``scores`` has the eligible ``(query, doc, score)``, ``documents`` the capped columns. A
    query is covered by the highest of its scores, relative to its best one, among the
    chosen; the next document is the one that adds most, of equals the one whose groups are
    used least, then the one of smallest hash. If caps leave nothing, all caps grow by one.
    ``owner`` is the query that gained most.

    Documents stay on the executors. A pass ranks all that may be chosen and gives the driver
    the first ``keep``. Gains only shrink, so these settle the choice until none of them gains
    more than the last of them did; the first of a pass is always right, so there are at most
    as many passes as choices and one more a growth of the caps. The driver holds one figure
    a query.
    """
    spark = scores.sparkSession
    cols = sorted(caps)
    stage = Stage(spark, "facility")
    s = stage.write(scores.where("score > 0").groupBy(query, doc).agg(F.max("score").alias("score")), "scores")
    best = s.groupBy(query).agg(F.max("score").alias("best")).orderBy(query).collect()
    asked = [r[query] for r in best]
    kind = lambda c: scores.schema[c].dataType.simpleString()
    numbered = spark.createDataFrame([(q, i, r["best"]) for i, (q, r) in enumerate(zip(asked, best))], f"{query} {kind(query)}, i int, best double")
    near = s.join(F.broadcast(numbered), query).select(F.col(doc).alias("d"), F.struct("i", (F.col("score") / F.col("best")).alias("s")).alias("x"))
    near = near.groupBy("d").agg(F.array_sort(F.collect_list("x")).alias("near")).select("d", F.col("near.i").alias("i"), F.col("near.s").alias("s"))
    tie = F.sha2(F.concat_ws("\x00", F.lit(seed), F.col("d").cast("string")), 256)
    groups = documents.select(F.col(doc).alias("d"), F.struct(F.lit(0), *cols).alias("g")).dropDuplicates(["d"])
    rows = near.join(groups, "d").select("d", "g", tie.alias("tie"), "i", "s")
    plain = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [pa.array([np.asarray(x, t).tobytes() for x in b.column(c).to_pylist()], pa.binary()) for c, t in ((3, np.int32), (4, np.float64))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *flat], names=["d", "g", "tie", "i", "s"])

    rows = stage.write(rows.mapInArrow(pack, f"d {plain['d']}, g {plain['g']}, tie string, i binary, s binary"), "near")
    covered = np.zeros(len(asked))
    used: dict[tuple[str, object], int] = {}
    limit = dict(caps)
    taken: set[object] = set()

    def groups_of(g: dict) -> list[tuple[str, object]]:
        return [(c, g[c]) for c in cols]

    def free(g: dict) -> bool:
        return all(used.get(x, 0) < limit[x[0]] for x in groups_of(g))

    def gain(i: np.ndarray, x: np.ndarray) -> float:
        return round(sum(np.maximum(x - covered[i], 0.0).tolist()), 15)

    def first() -> list[tuple]:
        """The documents that may be chosen, in order, as ``(gain, d, groups, tie, i, s)``; ``keep`` of them at most."""
        state = spark.sparkContext.broadcast((covered.copy(), dict(used), dict(limit), set(taken)))

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cover, used, limit, taken = state.value
            top: list[tuple] = []
            for b in batches:
                bytes_ = [b.column(k) for k in (3, 4)]
                ids, gs, ties = (b.column(k).to_pylist() for k in range(3))
                for n, (d, g, t) in enumerate(zip(ids, gs, ties)):
                    uses = [used.get((c, g[c]), 0) for c in cols]
                    if d in taken or any(u >= limit[c] for u, c in zip(uses, cols)):
                        continue
                    i, x = (np.frombuffer(v[n].as_buffer(), k) for v, k in zip(bytes_, (np.int32, np.float64)))
                    add = np.maximum(x - cover[i], 0.0)
                    if len(top) >= keep and float(add.sum()) + 1e-9 < -top[keep - 1][0][0]:
                        continue
                    top.append(((-round(sum(add.tolist()), 15), *uses, t), d, g, i.tobytes(), x.tobytes()))
                    if len(top) >= 2 * keep:
                        top = sorted(top, key=lambda x: x[0])[:keep]
            top = sorted(top, key=lambda x: x[0])[:keep]
            cells = [[x[0][0] for x in top], [x[0][1:-1] for x in top], [x[0][-1] for x in top], *([x[k] for x in top] for k in range(1, 5))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, shape)], schema=shape)

        shape = pa.schema([("loss", pa.float64()), ("uses", pa.list_(pa.int64())), ("tie", pa.string()), ("d", to_arrow_type(rows.schema["d"].dataType)), ("g", to_arrow_type(rows.schema["g"].dataType)), ("i", pa.binary()), ("s", pa.binary())])
        got = rows.mapInArrow(rank, f"loss double, uses array<bigint>, tie string, d {plain['d']}, g {plain['g']}, i binary, s binary")
        out = [(-r["loss"], r["d"], r["g"].asDict(), r["tie"], np.frombuffer(r["i"], np.int32), np.frombuffer(r["s"])) for r in got.orderBy("loss", "uses", "tie").limit(keep).collect()]
        state.unpersist()
        return out

    out: list[tuple] = []
    total = rows.count()
    while len(out) < min(size, total):
        top = first()
        if not top:  # all that are left are capped
            limit = {c: n + 1 for c, n in limit.items()}
            continue
        bound, fresh = (top[-1][0] if len(top) == keep else None), True
        while len(out) < size:
            ranked = [(-gain(i, x), *(used.get(y, 0) for y in groups_of(g)), t, n) for n, (_, d, g, t, i, x) in enumerate(top) if d not in taken and free(g)]
            if not ranked or not fresh and bound is not None and -min(ranked)[0] <= bound + 1e-12:
                break
            fresh = False
            g, (_, d, group, _, i, x) = -min(ranked)[0], top[min(ranked)[-1]]
            add = np.maximum(x - covered[i], 0.0)
            owner = min(range(len(i)), key=lambda n: (-add[n], -x[n], str(asked[i[n]])))
            covered[i] = np.maximum(covered[i], x)
            for y in groups_of(group):
                used[y] = used.get(y, 0) + 1
            taken.add(d)
            out.append((d, len(out) + 1, asked[i[owner]], round(g, 12)))
    return spark.createDataFrame(out, f"{doc} {kind(doc)}, position long, owner {kind(query)}, gain double")


def overlap(left: DataFrame, right: DataFrame, key: str, role: str) -> DataFrame:
    """``(key, left_role, right_role)`` of what two selections share."""
    one = lambda df, name: df.groupBy(key).agg(F.min(role).alias(name))
    return one(left, "left_role").join(one(right, "right_role"), key)
