"""Evaluation texts leaking into training text.

The n-grams of the evaluation items, as sorted hashes, go to every executor; the
word windows of every document are looked up in them, and a hit counts once its
words equal the item's. The evaluation set is taken in blocks of bounded size, so
what is broadcast never grows with the data; documents are read once a block and
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import empty, pick
from . import wordhash

HITS = "doc_id long, item_id long, first_word int, n_words int"


class Grams:
    """Hash set of the n-grams of some items, with where each gram stands."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.ids, self.lists = n, [i for i, _ in items], []
        hashes, places = [], []
        for row, (_, text) in enumerate(items):
            for _, _, w in wordhash.blocks(pa.array([text.lower()], pa.string()), 1 << 30):
                self.lists.append(w.words(0, len(w.hash)))
                g, first = w.grams(n)
                hashes.append(g)
                places.append(np.stack([np.full(len(g), row), first], 1))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        p = np.concatenate(places) if places else np.zeros((0, 2), np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.place = h[order], p[order]
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[(self.hash & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, w: wordhash.Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item row, first word in the text, first word in the item) of verified hits."""
        g, first = w.grams(self.n)
        maybe = np.flatnonzero(self.bits[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.hash, g[maybe], side="left")
        hi = np.searchsorted(self.hash, g[maybe], side="right")
        for k in np.flatnonzero(hi > lo).tolist():
            at = int(first[maybe[k]])
            here = w.words(at, at + self.n)
            for row, pos in self.place[lo[k] : hi[k]].tolist():
                if self.lists[row][pos : pos + self.n] == here:
                    yield int(w.text[at]), row, at, pos


def _spans(hits: list[tuple[int, int, int, int]], n: int) -> Iterator[tuple[int, int, int, int]]:
    """Joins hits that go on where the last one did: (text, item row, first word, words)."""
    runs: dict[tuple[int, int, int], list[int]] = {}
    for text, row, at, pos in sorted(hits):
        key = (text, row, at - pos)
        run = runs.get(key)
        if run and at == run[1] + 1:
            run[1] = at
            continue
        if run:
            yield text, row, run[0], run[1] - run[0] + n
        runs[key] = [at, at]
    for (text, row, _), run in runs.items():
        yield text, row, run[0], run[1] - run[0] + n


def leaked_spans(documents: DataFrame, items: DataFrame, n: int = 8, text: str = "text", doc_id: str = "doc_id", max_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, item_id, first_word, n_words)``: runs of ``n`` or more words shared with an item.

    Words are the longest runs of a-z and 0-9 after lower-casing. ``first_word``
    counts the document's words from 0. Items of fewer than ``n`` words cannot leak;
    null or empty texts match nothing; repeated rows give repeated hits only if the
    documents repeat. Items are broadcast in blocks of at most ``max_bytes`` of text
    (one item at least), as many as it takes.
    """
    spark = documents.sparkSession
    ev = pick(items, item_id="item_id", text="text").where("item_id is not null and text is not null").dropDuplicates(["item_id", "text"])
    total = ev.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-int(total) // max(1, max_bytes // 2))
    docs = pick(documents, doc_id=doc_id, text=text).where("doc_id is not null").select("doc_id", F.lower("text").alias("text"))
    parts = []
    for k in range(n_blocks):
        rows = ev.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()
        block = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            grams = Grams(block.value, n)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                out = []
                for a, _, w in wordhash.blocks(texts):
                    firsts = np.searchsorted(w.text, np.arange(w.text[-1] + 1 if len(w.text) else 0))
                    for t, row, at, words in _spans(list(grams.hits(w)), n):
                        out.append((ids[a + t].as_py(), grams.ids[row], at - int(firsts[t]), words))
                cols = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "first_word", "n_words"])

        parts.append(docs.mapInArrow(scan, HITS))
    if not parts:
        return empty(spark, HITS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaked_documents(documents: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """``(doc_id, item_id)`` of every document that holds ``n`` consecutive words of an item."""
    return leaked_spans(documents, items, n).select("doc_id", "item_id").distinct()


_WORD = re.compile("[A-Za-z0-9]+")
_ODD = re.compile("[\u0130\u212a]")  # capitals beyond ASCII whose lower case holds an ASCII letter


def _word_ends(text: str) -> list[tuple[int, int]]:
    """Start and end of each word of the lower-cased text, in the text as it stands."""
    if not _ODD.search(text):
        return [m.span() for m in _WORD.finditer(text)]
    out, inside = [], False
    for i, c in enumerate(text):
        for x in c.lower():
            word = x in "abcdefghijklmnopqrstuvwxyz0123456789"
            if word and not inside:
                out.append((i, i + 1))
            elif word:
                out[-1] = (out[-1][0], i + 1)
            inside = word
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given runs of words (first word, words); what separates words stays."""
    words = _word_ends(text)
    drop = sorted({i for a, k in spans for i in range(a, min(a + k, len(words)))})
    out, at = [], 0
    for i in drop:
        start, end = words[i]
        out.append(text[at : max(at, start)])
        at = end
    return "".join(out) + text[at:]


def decontaminate(documents: DataFrame, items: DataFrame, n: int = 8, action: str = "document") -> DataFrame:
    """``documents`` without what leaked: whole documents, or only the shared spans.

    With ``action="span"`` the column ``text`` of the documents hit is rewritten.
    Documents with a null ``doc_id`` are kept as they are.
    """
    spans = leaked_spans(documents, items, n)
    if action == "document":
        return documents.join(spans.select("doc_id").distinct(), "doc_id", "left_anti")
    if action != "span":
        raise ValueError("action is document or span")
    per = spans.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "n_words")).alias("_spans"))

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, runs: pd.Series) -> pd.Series:
        cut = [None if t is None else cut_words(t, [(r["first_word"], r["n_words"]) for r in k]) for t, k in zip(text, runs)]
        return pd.Series(cut, dtype=object)

    hit = documents.join(per, "doc_id").withColumn("text", rewrite("text", "_spans")).select(documents.columns)
    return documents.join(per.select("doc_id"), "doc_id", "left_anti").unionByName(hit)
