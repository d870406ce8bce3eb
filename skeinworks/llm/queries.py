"""Named queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import table
from . import answers, components, leakage, mixing, names, neighbours, quantiles, reading, splitting, survivors


def p1_found(spark, d):
    return names.variant_pairs(table(spark, d, "mentions"))


def p2_found(spark, d):
    t = lambda n: table(spark, d, n)
    return components.group_mentions(t("pair_decisions"), t("blocked_merges"), t("mentions"))


def p3_found(spark, d):
    return splitting.oversized(table(spark, d, "chunks"))


def p4_found(spark, d):
    return quantiles.wrong_p95(table(spark, d, "retrievals"), table(spark, d, "request_efficiency_by_builder_and_regime"))


def p4_percentiles(spark, d):
    """Medians and high percentiles of both latencies per run, builder and regime."""
    parts = []
    for name, key, at in (("retrievals", "retrieval_result_id", "retrieved_at"), ("answers", "answer_result_id", "answered_at")):
        r = quantiles.latency_readings(table(spark, d, name), key, at)
        parts.append(quantiles.sketch(r, quantiles.KEYS, "latency_ms").selectExpr(f"'{name}' as kind", "*"))
    by = ("kind", *quantiles.KEYS)
    return quantiles.percentiles(parts[0].unionByName(parts[1]), by, [0.5, 0.9, 0.95, 0.99])


def p5_found(spark, d):
    return survivors.surviving_mentions(table(spark, d, "mentions"), table(spark, d, "builder_trust"))


def p5_records(spark, d):
    return survivors.surviving_records(table(spark, d, "mentions"), table(spark, d, "builder_trust"))


def p6_found(spark, d):
    return answers.defective_answers(table(spark, d, "answers"), table(spark, d, "questions"))


def p7_found(spark, d):
    return neighbours.mutual_neighbours(table(spark, d, "mentions"))


def p8_found(spark, d):
    return leakage.leaked_documents(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_kept(spark, d):
    """Documents without any leak."""
    return leakage.decontaminate(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id")


def p8_cleaned(spark, d):
    """Every document with its length before and after the spans that leaked are cut."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.length("text").alias("chars"))
    return leakage.decontaminate(docs, table(spark, d, "eval_items"), action="span").select("doc_id", "chars", F.length("text").alias("chars_left"))


def p9_mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[0]


def p9_shares(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[1]


def p10_found(spark, d):
    return reading.bands(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def queries():
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_percentiles": p4_percentiles, "p5_found": p5_found, "p5_records": p5_records, "p6_found": p6_found, "p7_found": p7_found, "p8_found": p8_found, "p8_kept": p8_kept, "p8_cleaned": p8_cleaned, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found}


def oracle_sql():
    from . import oracle

    return dict(oracle.SQL)
