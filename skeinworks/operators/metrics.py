"""Retrieval and answer metrics per question, and their aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as T
from . import latest
from .retrieval import retrieval_metrics

LATENCY_OK = "{0} is not null and not isnan({0}) and {0} >= 0"


def clean_latency(df: DataFrame, column: str = "latency_ms") -> DataFrame:
    """Latencies that cannot be become null."""
    return df.withColumn(column, F.expr(f"case when {LATENCY_OK.format(column)} then {column} end"))


def one_each(df: DataFrame, key: str, at: str) -> DataFrame:
    """Newest row of each id."""
    return latest.latest(df.where(F.col(key).isNotNull()), [key], [F.col(at).desc_nulls_last()])


def question_rows(retrievals: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """One row a retrieval and its answer: lineage, rank metrics and answer metrics.

    An operational failure counts as a miss; a metric that does not apply is null.
    """
    r = clean_latency(one_each(retrievals, "retrieval_result_id", "retrieved_at")).select(
        "retrieval_result_id", "question_id", "base_run_id", F.col("builder_model").alias("builder"), F.col("graph_regime").alias("regime"), "retrieval_outcome",
        F.col("latency_ms").alias("retrieval_latency_ms"), "context_token_count", F.coalesce("retrieved_document_ids", F.array().cast("array<string>")).alias("found"),
    )
    a = clean_latency(one_each(answers, "answer_result_id", "ingested_at")).select(
        "retrieval_result_id", "answer_result_id", "raw_answer", F.lower(T.strip(F.col("answer_outcome"))).alias("answer_outcome"), F.col("latency_ms").alias("answer_latency_ms"), "input_tokens", "output_tokens"
    )
    q = questions.select("question_id", F.coalesce("question_type", F.lit("unknown")).alias("question_type"), "gold_answer", "answerable", F.coalesce("gold_document_ids", F.array().cast("array<string>")).alias("gold"))
    j = r.join(a, "retrieval_result_id").join(q, "question_id")
    applies = F.col("answerable") & (F.size("gold") > 0)
    ranks = retrieval_metrics(F.col("found"), F.col("gold"), applies)
    failed = F.coalesce(F.col("answer_outcome") != "success", F.lit(True))
    j = j.select("*", *[c.alias(k) for k, c in ranks.items()], failed.alias("answer_failed"))
    j = j.withColumn("predicted", A.normalize_answer("raw_answer")).withColumn("gold_norm", A.normalize_answer("gold_answer"))
    abstained = F.when(~F.col("answer_failed"), F.col("predicted") == A.ABSTAIN)
    exact = F.when(F.col("answerable"), (~F.col("answer_failed") & (F.col("predicted") == F.col("gold_norm"))).cast("int"))
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    f1 = F.when(F.col("answerable"), F.when(F.col("answer_failed"), 0.0).otherwise(T.token_f1(words("predicted"), words("gold_norm"))))
    right = F.when(~F.col("answerable"), F.coalesce(abstained, F.lit(False)).cast("int"))
    return j.select(
        "*",
        exact.alias("exact_match"),
        f1.alias("token_f1"),
        F.coalesce(exact, right).alias("answer_correct"),
        right.alias("unanswerable_correct"),
        F.when(~F.col("answerable") & ~F.col("answer_failed"), (~abstained).cast("int")).alias("hallucination"),
        F.when(F.col("answerable") & ~F.col("answer_failed"), abstained.cast("int")).alias("over_abstention"),
    ).drop("found", "gold")


def aggregate(rows: DataFrame, by: list[str]) -> DataFrame:
    """Micro means over the questions a metric applies to, overall and by each value of ``by[-1]``, in one pass."""
    overall = F.coalesce(F.col(by[-1]), F.lit("(all)"))
    mean = [F.round(F.avg(c), 6).alias(c) for c in ("retrieval_hit", "retrieval_recall", "reciprocal_rank", "complete_chain", "token_f1", "answer_correct", "hallucination", "over_abstention")]
    tails = [F.round(F.percentile(c, F.lit(p)), 6).alias(f"{c}_p{int(p * 100)}") for c in ("retrieval_latency_ms", "answer_latency_ms") for p in (0.5, 0.95)]
    sets = rows.groupingSets([[*map(F.col, by)], [*map(F.col, by[:-1])]], *by)
    return sets.agg(F.count(F.lit(1)).alias("questions"), *mean, *tails).withColumn(by[-1], overall)
