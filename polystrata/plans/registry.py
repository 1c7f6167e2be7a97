"""Named queries: Spark callables and the DuckDB SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a callable (spark, sf_dir) -> DataFrame, with its SQL if there is any."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


@query(
    """SELECT date_trunc('minute', ts) AS bucket, count(*) AS n, round(sum(value), 6) AS total,
              round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most
       FROM events GROUP BY ALL"""
)
def telemetry_minute_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("bucket")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def load() -> None:
    """Imports the modules that register the other queries."""
    from polystrata.plans import content_queries, graph_queries, relation_queries, retrieval_queries, store_queries, stream_queries, telemetry_queries  # noqa: F401
