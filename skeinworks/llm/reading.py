"""Reading level of documents: harmonic label propagation on the document-word graph.

Documents and words are the two sides of a graph whose edges weigh the count of the
word times its rarity. Graded documents are clamped to the mean of their grades;
every iteration sets each word to the weighted mean of its documents and each other
document to the weighted mean of its words, until the words hardly move. Two cut
points between the three bands are then fitted on the graded documents.

A word is a bucket of a fixed hash space, so the word side has a constant size and
is broadcast; documents never leave their partition. One iteration is one pass over
a staged table of word counts, which sends per partition no more than the word side.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stage, pick

BANDS = ("easy", "mid", "hard")
BUCKETS = 1 << 20

# Frequent words that tell running text of one language from another.
TELLING = {
    "en": "the a an of to in and was is had that it we they he she by on at for with from under after but although said all no did then you were be which",
    "de": "der die das und ist von mit im den dem des ein eine nicht wurde wird sich auf für rund nach stieg viele doch soll",
    "fr": "le la les des du de un une et est dans pour pas avec sur au mais après sans selon par ont",
    "es": "el la los las un una de del y es en que por para con no según pero tras se lo",
    "it": "il lo la gli le di che un una e è in per non con del della sono ma",
    "pt": "o a os as um uma de do da e em que para com não por mas se",
    "nl": "de het een van en in op te dat is voor met niet zijn maar",
}
_TELLING = {k: frozenset(v.split()) for k, v in TELLING.items()}
_INVISIBLE = re.compile("[​-‏⁠﻿­]")
_MARKUP = re.compile(r"<[^<>]{1,200}>|&(?:[a-z]+|#\d+);", re.I)
_ROW = re.compile(r"""^\s*(?:[-*•·–|>#]|\d+[.)]\s|[\[{]|[A-Z]?[\w ]{1,40}:\s*\S+$)|\|.*\|""")
_STOP = re.compile(r"""[.!?]["'”’)\]]*(?=\s|$)""")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


def prose(text: str) -> tuple[str, int, float]:
    """Running text of a document, its sentences, and its share of all characters.

    List items, table rows, code and lines without an end of sentence are left out.
    """
    text = _MARKUP.sub(" ", _INVISIBLE.sub("", text))
    kept, total = [], 0
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        total += len(line)
        if not _ROW.search(line) and _STOP.search(line):
            kept.append(line)
    out = "\n".join(kept)
    return out, len(_STOP.findall(out)), len(out) / total if total else 0.0


def is_english(words: Counter) -> bool:
    """Whether counted words are English: one in 20 is telling, and no other language is told as often."""
    counts = {k: sum(words[w] for w in v if w in words) for k, v in _TELLING.items()}
    return counts["en"] > 0 and counts["en"] * 20 >= words.total() and counts["en"] == max(counts.values())


def words_of(text: str | None, min_sentences: int = 3) -> Counter | None:
    """Word counts of a document of running English prose, else None.

    Words that begin with a capital are mostly names or begin a sentence; they are left
    out where enough others remain.
    """
    if not text:
        return None
    body, sentences, share = prose(text)
    if sentences < min_sentences or share < 0.5:
        return None
    words = Counter(_WORD.findall(body))
    low: Counter = Counter()
    for w, n in words.items():
        low[w.lower()] += n
    if not is_english(low):
        return None
    small = Counter({w: n for w, n in words.items() if w[0].islower()})
    return small if 4 * small.total() >= words.total() else low


GRAPH = "doc_id long, words array<int>, counts array<float>"


def word_graph(documents: DataFrame) -> DataFrame:
    """``(doc_id, words, counts)`` of the documents that have a reading level."""
    docs = pick(documents, doc_id="doc_id", text="text").where("doc_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    count = words_of(text)
                    if count:
                        buckets: Counter = Counter()
                        for w, n in count.items():
                            b = known.get(w)
                            if b is None:
                                if len(known) > 500_000:
                                    known.clear()
                                b = known[w] = zlib.crc32(w.encode()) & (BUCKETS - 1)
                            buckets[b] += n
                        rows.append((doc, list(buckets), list(buckets.values())))
                cols = list(zip(*rows)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float32())))], names=["doc_id", "words", "counts"])

    return docs.mapInArrow(run, GRAPH)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document row, word and count of every edge of a batch."""
    words, counts = batch.column("words"), batch.column("counts")
    sizes = np.diff(words.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), sizes), words.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float64)


def _sums(df: DataFrame, names: list[str]) -> np.ndarray:
    """Per-bucket sums of partial rows ``(word, *names)``; the result has a fixed size."""
    t = df.groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((len(names), BUCKETS))
    for i, n in enumerate(names):
        out[i, t.column("word").to_numpy()] = t.column(n).to_numpy()
    return out


def _partial(sums: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    at = np.flatnonzero(sums[-1])
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(s[at]) for s in sums]], names=["word", *names])


def _doc_scores(batch: pa.RecordBatch, rarity: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    row, word, count = _arrays(batch)
    weight = count * rarity[word]
    n = batch.num_rows
    total = np.bincount(row, weight, n)
    f = np.bincount(row, weight * score[word], n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return row, word, weight, np.where(total > 0, f / total, np.nan)


def grade(documents: DataFrame, labels: DataFrame, tolerance: float = 1e-3, most_rounds: int = 500, min_df: int = 3, fit_rows: int = 50_000) -> DataFrame:
    """``(doc_id, score, band)`` of every document of running English prose.

    ``labels`` grades some documents easy, mid or hard, ignoring case and white space;
    other grades, null ids and unknown documents are ignored, repeated rows of a rater
    count once, disagreeing raters are averaged. Briefs of up to two sentences, lists,
    tables and other languages have no row, whatever ``lang`` says. Words in fewer than
    ``min_df`` documents carry nothing. Cut points are fitted on up to ``fit_rows``
    graded documents; without graded documents there are no rows. A score of 0 is
    easy, 1 mid and 2 hard, drawn towards the mean as harmonic functions are. Rounds go
    on until no word moves by ``tolerance``; if ``most_rounds`` do not get there, an
    error says so.
    """
    spark = documents.sparkSession
    stage = Stage(spark, "reading")
    value = F.create_map(*[x for i, b in enumerate(BANDS) for x in (F.lit(b), F.lit(float(i)))])
    marks = pick(labels, doc_id="doc_id", band="band", rater="rater").withColumn("label", value[F.lower(F.trim("band"))])
    marks = marks.dropna(subset=["doc_id", "label"]).dropDuplicates(["doc_id", "rater", "label"])
    marks = marks.groupBy("doc_id").agg(F.avg("label").alias("label"))
    graph = stage.write(word_graph(documents).join(marks, "doc_id", "left"), "graph")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS)
        for b in batches:
            df += np.bincount(b.column("words").flatten().to_numpy(), minlength=BUCKETS)
        yield _partial([df], ["df"])

    (df,) = _sums(graph.select("words").mapInArrow(frequencies, "word int, df double"), ["df"])
    n_docs = graph.count()
    mean = graph.agg(F.avg("label")).first()[0]
    if mean is None:
        return graph.where("false").select("doc_id", F.lit(0.0).alias("score"), F.lit("mid").alias("band"))
    rarity = np.where(df >= min_df, np.log(np.maximum(n_docs, 2) / np.maximum(df, 1)), 0.0).astype(np.float32)
    rarity = spark.sparkContext.broadcast(rarity)
    score = np.full(BUCKETS, mean, np.float32)
    first, past = True, []
    for _ in range(most_rounds):
        held = spark.sparkContext.broadcast(score)

        def spread(batches: Iterator[pa.RecordBatch], held=held, first=first) -> Iterator[pa.RecordBatch]:
            top, weight_sum = np.zeros(BUCKETS), np.zeros(BUCKETS)
            for b in batches:
                label = b.column("label").to_numpy(zero_copy_only=False).astype(np.float64)
                row, word, weight, f = _doc_scores(b, rarity.value, held.value)
                f = np.where(np.isnan(label), np.nan if first else f, label)  # at first only graded documents speak
                use = ~np.isnan(f[row])
                top += np.bincount(word[use], (weight * f[row])[use], BUCKETS)
                weight_sum += np.bincount(word[use], weight[use], BUCKETS)
            yield _partial([top, weight_sum], ["top", "weight"])

        top, weight = _sums(graph.mapInArrow(spread, "word int, top double, weight double"), ["top", "weight"])
        new = np.where(weight > 0, top / np.maximum(weight, 1e-12), score).astype(np.float32)
        moved = float(np.abs(new - score).max())
        held.unpersist()
        if moved < tolerance:
            score = new
            break
        score, first = (new if first else ahead(past, score, new)), False
    else:
        raise RuntimeError(f"words still move by {moved} after {most_rounds} rounds")
    final = spark.sparkContext.broadcast(score)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _doc_scores(b, rarity.value, final.value)[3]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f), b.column("label")], names=["doc_id", "score", "label"])

    scores = stage.write(graph.mapInArrow(read, "doc_id long, score double, label double").where("not isnan(score)"), "scores")
    sample = scores.where("label is not null").orderBy(F.xxhash64("doc_id")).limit(fit_rows).toArrow()
    low, high = cut_points(sample.column("score").to_numpy(), sample.column("label").to_numpy())
    band = F.when(F.col("score") < low, "easy").when(F.col("score") < high, "mid").otherwise("hard")
    return scores.select("doc_id", "score", band.alias("band"))


def ahead(past: list[tuple[np.ndarray, np.ndarray]], score: np.ndarray, new: np.ndarray, memory: int = 4) -> np.ndarray:
    """Where the next harmonic round should start: the mix of the last rounds that would have moved least.

    The rounds' fixed point stays what it is, it is only reached in fewer of them. ``past`` has
    (result, move) of the last rounds and is brought up to date.
    """
    move = (new - score).astype(np.float64)
    step = new.astype(np.float64)
    if past:
        moves = np.stack([move - m for _, m in past], axis=1)
        mix = np.linalg.lstsq(moves.T @ moves + 1e-12 * np.eye(len(past)), moves.T @ move, rcond=None)[0]
        step = step - sum(k * (new - r) for k, (r, _) in zip(mix, past))
    past.append((new.astype(np.float64), move))
    del past[:-memory]
    return np.clip(step, 0.0, len(BANDS) - 1.0).astype(np.float32)


def cut_points(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """The two cuts of the sorted scores with the least total distance to the labels."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order]
    n = len(s)
    cost = [np.concatenate([[0], np.cumsum(np.abs(y - v))]) for v in range(3)]
    # for each second cut j the best first cut i <= j
    gain = cost[0] - cost[1]
    best = np.minimum.accumulate(gain)
    total = best + cost[1] + (cost[2][n] - cost[2])
    j = int(np.argmin(total))
    i = int(np.argmin(gain[: j + 1]))

    def between(k: int) -> float:
        if k == 0:
            return -np.inf
        if k == n:
            return np.inf
        return float((s[k - 1] + s[k]) / 2)

    return between(i), between(j)


def bands(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return grade(documents, labels).select("doc_id", "band")
