"""Queries that run as streams over all there is, end, and give what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polystrata.operators import telemetry as T
from polystrata.plans.registry import query
from polystrata.session import shared_dir
from polystrata.streaming import jobs
from polystrata.sources.files import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return T.plain(jobs.source(spark, f"{d}/event[s].parquet", schema, 1000))


def _written(stream: DataFrame) -> DataFrame:
    at = f"{shared_dir(stream.sparkSession)}/polystrata-stream-{uuid.uuid4().hex}"
    jobs.write(stream, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


@query("""SELECT date_trunc('minute', ts) AS bucket, event_type AS key, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM events
          WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def stream_minute_buckets(spark, d):
    """Buckets that the watermark, 10 minutes behind the last event, has closed."""
    s = _written(jobs.minute_buckets(_events(spark, d)))
    return s.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "key", "n", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


@query("SELECT DISTINCT event_type AS key, 'user_' || user_id AS source, value FROM events")
def stream_first_seen(spark, d):
    """Each key, source and value once."""
    return _written(jobs.first_seen(_events(spark, d))).select("key", "source", "value")
