"""Splitting oversized texts at natural boundaries by pointer doubling.

A token is a longest run of characters other than space, tab and newline. Every
position after a token is a boundary; each boundary is joined to its farthest
legal successor, which is the end of the next piece if a piece ends there. The
table of successors is squared again and again, while the set of boundaries
reached from the start of the text grows by the table's hops; after log2(pieces)
squarings all cuts of the greedy split are known without walking from cut to cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import pick

TOKEN = r"[^ \t\n]+"
KINDS = ("word", "clause", "sentence", "line", "paragraph", "end")

# Characters that end sentences and clauses, and those that may follow them.
SENTENCE_ENDS = ".!?…。!?"
CLAUSE_ENDS = ",;:،、,;:"
CLOSERS = "\"'”’»)]}"


def _members(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], dtype=np.uint32)


_SENTENCE, _CLAUSE, _CLOSE = _members(SENTENCE_ENDS), _members(CLAUSE_ENDS), _members(CLOSERS)


def tokens_and_boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, and the kind of boundary after each (index into KINDS)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = np.ones(len(c) + 2, dtype=bool)
    space[1:-1] = (c == 32) | (c == 9) | (c == 10)
    start, end = np.flatnonzero(~space[1:-1] & space[:-2]), np.flatnonzero(~space[1:-1] & space[2:]) + 1
    n = len(start)
    kind = np.zeros(n, dtype=np.int8)
    if n:
        last = c[end - 1]
        closed = np.isin(last, _CLOSE) & (end - start > 1)
        before = c[np.maximum(end - 2, 0)]
        kind[np.isin(last, _CLAUSE) | closed & np.isin(before, _CLAUSE)] = 1
        kind[np.isin(last, _SENTENCE) | closed & np.isin(before, _SENTENCE)] = 2
        newlines = np.concatenate([[0], np.cumsum(c == 10)])
        gap = newlines[np.append(start[1:], len(c))] - newlines[end]
        kind[gap == 1] = 3
        kind[gap > 1] = 4
        kind[-1] = 5
    return start, end, kind


def cuts(kind: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and ends (exclusive) of all pieces of a text with these boundaries."""
    n = len(kind)
    at = np.arange(n + 1)
    strength = np.concatenate([[0], kind])
    natural = np.maximum.accumulate(np.where(strength >= 2, at, 0))
    clause = np.maximum.accumulate(np.where(strength >= 1, at, 0))

    def successor(floor: np.ndarray, reach: np.ndarray) -> np.ndarray:
        reach = np.minimum(reach, n)
        best = np.where(natural[reach] > floor, natural[reach], np.where(clause[reach] > floor, clause[reach], reach))
        return np.where(reach == n, n, best)

    jump = successor(at, at - overlap + limit)
    first = int(successor(np.array([0]), np.array([limit]))[0])
    # a first cut before the overlap would start the second piece ahead of the text
    jump[:overlap] = successor(at[:overlap], np.full(min(overlap, n + 1), limit))
    reached = np.zeros(n + 1, dtype=bool)
    reached[first] = True
    known = 1
    while True:
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        now = int(np.count_nonzero(reached))
        if now == known:
            break
        known = now
    ends = np.flatnonzero(reached)
    return np.concatenate([[0], np.maximum(ends[:-1] - overlap, 0)]), ends


def split_text(text: str, limit: int = 300, overlap: int = 30) -> list[tuple[str, int, str]]:
    """Pieces of one text as (content, tokens, kind of boundary at its end)."""
    start, end, kind = tokens_and_boundaries(text)
    if not len(start):
        return [(text, 0, "end")]
    a, b = cuts(kind, limit, overlap)
    if len(b) == 1:
        return [(text, len(start), "end")]
    return [(text[start[i] : end[j - 1]], int(j - i), KINDS[kind[j - 1]]) for i, j in zip(a.tolist(), b.tolist())]


_PIECES = T.StructType(
    [
        T.StructField("document_id", T.StringType()),
        T.StructField("chunk_id", T.StringType()),
        T.StructField("chunk_order", T.LongType()),
        T.StructField("piece_order", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("boundary", T.StringType()),
    ]
)


def split_chunks(chunks: DataFrame, limit: int = 300, overlap: int = 30) -> DataFrame:
    """Pieces of every chunk, ordered by ``chunk_order`` and ``piece_order``.

    A chunk of up to ``limit`` tokens is one piece as it stands; longer ones are cut
    at the farthest paragraph, line or sentence end within the limit, failing that
    at a clause end, failing that between words; ``overlap`` tokens are repeated.
    The stored ``token_count`` is never trusted. Of a chunk delivered more than once
    the newest by ``created_at`` counts (then the greatest content). Null contents
    give no piece; empty ones give one piece of no tokens. Texts are cut whole in
    memory one at a time, so a text may be as long as a row may be.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    c = pick(chunks, document_id="document_id", chunk_id="chunk_id", chunk_order="chunk_order", content="content", created_at="created_at")
    c = c.where("content is not null and chunk_id is not null")
    newest = c.groupBy("chunk_id").agg(F.max(F.struct("created_at", "content", "document_id", "chunk_order")).alias("x"))
    c = newest.select("x.document_id", "chunk_id", F.col("x.chunk_order").cast("long").alias("chunk_order"), F.col("x.content").alias("content"))
    c = c.withColumn("token_count", F.regexp_count("content", F.lit(TOKEN)))
    whole = c.where(F.col("token_count") <= limit).select(
        "document_id", "chunk_id", "chunk_order", F.lit(0).alias("piece_order"), F.lit(1).alias("n_pieces"), "content", "token_count", F.lit("end").alias("boundary")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for row in batch.slice(at, 256).to_pylist():
                    pieces = split_text(row["content"], limit, overlap)
                    out += [(row["document_id"], row["chunk_id"], row["chunk_order"], i, len(pieces), *p) for i, p in enumerate(pieces)]
                columns = list(zip(*out)) or [[]] * 8
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=_PIECES.names)

    long = c.where(F.col("token_count") > limit).select("document_id", "chunk_id", "chunk_order", "content").mapInArrow(cut, _PIECES)
    return whole.unionByName(long)


def oversized(chunks: DataFrame, limit: int = 300, overlap: int = 30) -> DataFrame:
    """``(chunk_id)`` of the chunks that had to be cut."""
    return split_chunks(chunks, limit, overlap).where("n_pieces > 1").select("chunk_id").distinct()
