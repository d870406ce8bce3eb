"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Every source is a stream of blocks of tokens. Block j of a source with share w may be
scheduled from slot floor(j / w) on and is due by slot ceil((j + 1) / w); earliest
deadline first keeps every source within one block of its share at every slot.
Shares are whole numbers of blocks in a period of slots, and a Pfair schedule begins
anew after each period, so one period is scheduled however large the mix is; documents
take the slots of their blocks.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stage, bounded_rows, empty, pick

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHOSEN = "doc_id long, source string, repeat int, n_tokens long, start long, slot long"
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(rows: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Replaces the column ``text`` by ``n_tokens``; a null text has none."""
    keep = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            n = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], n], names=[*keep, "n_tokens"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(keep).schema) + ", n_tokens long"
    return rows.select(*keep, text).mapInArrow(run, schema)


def source_key(column: str):
    """Spelling-independent name of a source: case, spacing and a leading article do not matter."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(column), r"(?U)\s+", " ")), r"^the ", "")


def plan_quotas(tokens: dict[str, int], weights: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """Tokens each source is to give. Without ``total`` the largest mix that meets all targets.

    Sources without tokens or weight give nothing, and the others keep their proportions.
    """
    have = {s: w for s, w in weights.items() if w > 0 and tokens.get(s, 0) > 0 and repeats[s] > 0}
    if not have:
        return {}
    scale = sum(have.values())
    most = min(tokens[s] * repeats[s] * scale / w for s, w in have.items())
    size = most if total is None else total
    return {s: min(tokens[s] * repeats[s], int(size * w / scale)) for s, w in have.items()}


def schedule(lengths: list[int], slots: int) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of every slot, earliest deadline first among the blocks released."""
    whole = sum(lengths)
    waiting = [(0, i, 0) for i in range(len(lengths)) if lengths[i] > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * whole // lengths[i]), i, j))
        _, i, j = heapq.heappop(ready)
        yield i, j, slot
        heapq.heappush(waiting, ((j + 1) * whole // lengths[i], i, j + 1))


def shares_of_period(lengths: list[int], period: int) -> list[int]:
    """Blocks of each source in a period of slots, by largest remainder, at least one each; they sum to the period."""
    whole = sum(lengths)
    out = [max(1, n * period // whole) for n in lengths]
    order = sorted(range(len(lengths)), key=lambda i: (-(lengths[i] * period % whole), i))
    for k in range(period - sum(out)):
        out[order[k]] += 1
    while sum(out) > period:  # sources below one block took some from the largest
        out[out.index(max(out))] -= 1
    return out


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = 4096, tokenizer: str = TOKENIZER, period: int = 1 << 20, max_targets: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Chosen documents and the share that each source got.

    The first frame has one row a use of a document: ``doc_id, source, repeat`` (from 1),
    ``n_tokens, start`` (token position in the source's stream) and ``slot``; ordered by
    ``slot, source, start`` it is the mixed corpus. The second has ``source,
    target_weight, tokens, share, max_repeats, available``, one row a target.

    Sources match ignoring case, spacing and a leading article; documents of other or
    null sources, null ids and empty texts are not used. Each pass over a source takes
    its documents in another fixed order; the last pass stops at the document nearest
    to the quota. Without ``total_tokens`` the mix is the largest that meets all targets
    within ``max_repeats``; with it, a source that cannot give its part gives all it may,
    and the shares say so. A target without documents has share 0. Of targets of one
    spelling-independent name, or with a null weight or cap, the greatest counts. There
    may be up to ``max_targets`` targets. At every slot each source is within one block of
    ``block`` tokens of its share, which is rounded to a ``period``-th. Prefix sums are made
    over hashed ranges in two steps, more ranges for more rows, so a source may hold any
    part of all rows. ``tokenizer`` is a vocabulary file that every executor can read.
    """
    spark = documents.sparkSession
    stage = Stage(spark, "mixing")
    t = pick(targets, source="source", w="target_weight", r="max_repeats").where("source is not null").withColumn("key", source_key("source"))
    rows = bounded_rows(t.groupBy("key").agg(F.max("source").alias("source"), F.max(F.coalesce("w", F.lit(0.0))).alias("w"), F.max(F.coalesce("r", F.lit(0))).alias("r")), max_targets)
    if rows is None:
        raise ValueError(f"more than {max_targets} targets")
    names = sorted(r["key"] for r in rows)
    info = {r["key"]: r for r in rows}
    docs = pick(documents, doc_id="doc_id", source="source", text="text").where("doc_id is not null and text is not null and text <> ''")
    docs = docs.withColumn("key", source_key("source")).where(F.col("key").isin(names)) if names else docs.where("false").withColumn("key", F.lit(""))
    sized = stage.write(count_tokens(docs.select("doc_id", "key", "text"), "text", tokenizer).where("n_tokens > 0"), "sized")
    totals = sized.groupBy("key").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    have = {r["key"]: r["n"] for r in totals}
    quota = plan_quotas(have, {k: info[k]["w"] for k in names}, {k: info[k]["r"] for k in names}, total_tokens)
    share_schema = "source string, target_weight double, tokens long, share double, max_repeats int, available long"
    if not quota:
        none = [(info[k]["source"], info[k]["w"], 0, 0.0, info[k]["r"], have.get(k, 0)) for k in names]
        return empty(spark, CHOSEN), spark.createDataFrame(none, share_schema)

    plan = spark.createDataFrame([(k, q, have[k], q // have[k], info[k]["source"]) for k, q in quota.items()], "key string, quota long, total long, full long, source string")
    uses = sized.join(F.broadcast(plan), "key").selectExpr("*", "explode(sequence(0L, full)) as pass").where("pass < full or quota > full * total")
    uses = uses.withColumn("h", F.xxhash64("doc_id", "pass"))
    # whole passes come in any fixed order; ranges of the hash make the two steps of the prefix sums
    bits = max(10, (max(r["rows"] for r in totals) >> 16).bit_length())
    uses = uses.withColumn("range", F.shiftrightunsigned("h", 64 - bits))
    per = uses.groupBy("key", "pass", "range").agg(F.sum("n_tokens").alias("t"))
    before = per.selectExpr("key", "pass", "range", "sum(t) over (partition by key, pass order by range) - t as before")
    placed = uses.join(before, ["key", "pass", "range"]).selectExpr(
        "*", "before + sum(n_tokens) over (partition by key, pass, range order by h, doc_id rows unbounded preceding) - n_tokens as at"
    )
    used = placed.where("pass < full or at + n_tokens / 2 <= quota - full * total")
    used = stage.write(used.selectExpr("key", "source", "doc_id", "cast(pass + 1 as int) as repeat", "n_tokens", "pass * total + at as start"), "used")
    got = {r["key"]: r["n"] for r in used.groupBy("key").agg(F.sum("n_tokens").alias("n")).collect()}
    whole = sum(got.values())
    keys = sorted(got)
    part = shares_of_period([got[k] for k in keys], period)
    shares = spark.createDataFrame(
        [(info[k]["source"], info[k]["w"], got.get(k, 0), got.get(k, 0) / whole if whole else 0.0, info[k]["r"], have.get(k, 0)) for k in names], share_schema
    )

    blocks = -(-whole // block)
    slots = min(period, blocks + len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            chunk = []
            for i, j, slot in schedule(part, slots):
                chunk.append((keys[i], j, slot))
                if len(chunk) == 65536 or slot == slots - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*chunk)], names=["key", "block", "slot"])
                    chunk = []

    timed = spark.range(1, numPartitions=1).mapInArrow(run, "key string, block long, slot long")
    sizes = spark.createDataFrame(list(zip(keys, part)), "key string, part long")
    nth = F.floor(F.col("start") / block).cast("long")
    placed = used.join(F.broadcast(sizes), "key").withColumns({"block": nth % F.col("part"), "round": F.floor(nth / F.col("part")).cast("long")})
    out = placed.join(timed, ["key", "block"], "left")
    # a block that is due after the last slot of a mix shorter than a period comes at the end
    slot = F.col("round") * period + F.coalesce("slot", F.lit(slots))
    return out.select("doc_id", "source", "repeat", "n_tokens", "start", slot.alias("slot")), shares
