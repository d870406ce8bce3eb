"""Named queries of the library over the driver's tables."""

from __future__ import annotations

from . import q_audit, q_graph, q_metrics, q_more, q_resolution, q_sources, q_text  # noqa: F401
from .registry import QUERIES, SQL


def flagship(spark, sf_dir):
    return QUERIES["question_metrics"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
