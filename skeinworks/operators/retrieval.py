"""Text retrieval: BM25, document ranking and rank metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def rank_documents(rows: DataFrame, key: str, ids: str) -> DataFrame:
    """``(key, document_id, rank)`` from an array of ids with separators: first occurrences, contiguous ranks from 1."""
    flat = rows.select(key, F.posexplode(ids).alias("p", "x")).select(key, "p", F.posexplode(F.split("x", r"<SEP>|\|")).alias("q", "d"))
    first = flat.withColumn("d", F.trim("d")).where("d <> ''").groupBy(key, F.col("d").alias("document_id")).agg(F.min(F.struct("p", "q")).alias("at"))
    return first.select(key, "document_id", F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("rank"))


def first_relevant_rank(found: Column, gold: Column) -> Column:
    """Position from 1 of the first gold id in a ranked array, null without one."""
    hits = F.filter(F.transform(found, lambda d, i: F.when(F.array_contains(gold, d), i + 1)), lambda x: x.isNotNull())
    return F.array_min(hits)


def retrieval_metrics(found: Column, gold: Column, answerable: Column) -> dict[str, Column]:
    """Hit, recall, reciprocal rank and whole chain in the first five; null for questions without an answer."""
    on = lambda c: F.when(answerable, c)
    rank = first_relevant_rank(found, gold)
    return {
        "first_relevant_rank": on(rank),
        "retrieval_hit": on(F.arrays_overlap(found, gold).cast("int")),
        "retrieval_recall": on(F.size(F.array_intersect(gold, found)) / F.size(F.array_distinct(gold))),
        "reciprocal_rank": on(F.coalesce(1.0 / rank, F.lit(0.0))),
        "complete_chain": on((F.size(F.array_except(gold, F.slice(found, 1, 5))) == 0).cast("int")),
    }


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)``, counted in the rows before any shuffle of terms."""
    return rows.select(key, F.explode(T.lexical_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_index(documents: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """Postings ``(key, term, tf, dl, n, avgdl, df, idf)``.

    With ``terms`` only postings of those terms are made; lengths and document counts stay
    those of all documents. Postings of other terms are then never shuffled.
    """
    tokens = documents.select(key, T.lexical_tokens(F.col(text)).alias("tokens")).select(key, "tokens", F.size("tokens").alias("dl"))
    stats = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    flat = tokens.select(key, "dl", F.explode("tokens").alias("term"))
    if terms is not None:
        flat = flat.join(terms.select("term").distinct(), "term", "left_semi")
    tf = flat.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25(index: DataFrame, key: str, queries: DataFrame, query: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query, key, score)`` of every document that shares a term with a query.

    Terms of all queries cut the postings before anything is joined to documents.
    """
    q = term_counts(queries, query, text).withColumnRenamed("tf", "qtf")
    hit = index.join(q, "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("qtf")
    return hit.groupBy(query, key).agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, by: str, item: str, k: int, score: str = "score", tie: Column | None = None) -> DataFrame:
    order = [F.desc(score), *([tie] if tie is not None else []), F.col(item)]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def topic_terms(counts: DataFrame, key: str, k: int = 8) -> DataFrame:
    """The ``k`` rarest terms of each row, by document frequency and then the term."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy(key).orderBy("df", "term")
    return counts.join(df, "term").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select(key, "term", "df", F.col("rn").alias("position"))


def stable_tie(seed: str, *parts: Column) -> Column:
    """Hash by which equal candidates are ordered, as fixed-width hexadecimal."""
    return F.substring(F.sha2(F.concat_ws("\x00", F.lit(seed), *parts), 256), 1, 16)
