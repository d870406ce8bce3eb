"""Registers named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Decorator: the function's name is the query's; it gets a loader of tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Common table expressions: rows delivered twice count once.
M = "m as (select * from (select *, row_number() over (partition by mention_id order by ingested_at desc) rn from mentions) where rn = 1)"
R = "r as (select * exclude (latency_ms), case when not isnan(latency_ms) and latency_ms >= 0 then latency_ms end latency_ms from (select *, row_number() over (partition by retrieval_result_id order by retrieved_at desc) rn from retrievals) where rn = 1)"
A = "a as (select * exclude (latency_ms), case when not isnan(latency_ms) and latency_ms >= 0 then latency_ms end latency_ms from (select *, row_number() over (partition by answer_result_id order by ingested_at desc) rn from answers) where rn = 1)"

#: White space of any kind, for the SQL engine's patterns.
WS = "[\\s\\x{0b}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def collapsed(column: str) -> str:
    """SQL for a column without outer white space and with single spaces inside."""
    return f"trim(regexp_replace({column}, '{WS}', ' ', 'g'))"
