"""Streams: tumbling buckets, first-seen rows, bounded queues by key, and ingestion of log files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from polystrata.operators import logs


def source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of a folder, some a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def minute_buckets(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean by key and minute; rows later than the watermark are left out."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = s.groupBy(F.window("ts", "1 minute"), "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("bucket"), "key", "n", "total", "mean")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows and span of each source's sessions, that a pause ends."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return s.groupBy(F.session_window("ts", gap), "source").agg(F.count("*").alias("n")).select("source", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def first_seen(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each key, source and value within the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["key", "source", "value"])


class Queue(StatefulProcessor):
    """Keeps the last ``capacity`` values of a key, and gives the queue's length and mean after each batch."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        for p in rows:
            held = (held + p.sort_values(["ts", "id"])["value"].tolist())[-self.capacity :]
        self.held.put([(v,) for v in held])
        yield pd.DataFrame({"key": [key[0]], "held": [len(held)], "mean": [sum(held) / len(held)]})

    def close(self) -> None:
        pass


def bounded_queues(stream: DataFrame, capacity: int) -> DataFrame:
    """Each key's queue after every batch; its state is in RocksDB, so it may outgrow memory."""
    return stream.groupBy("key").transformWithStateInPandas(statefulProcessor=Queue(capacity), outputStructType="key string, held long, mean double", outputMode="Update", timeMode="None")


def ingest_logs(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry records of the log files of a folder; lines that fit no pattern are left out."""
    return logs.records(logs.parse(spark.readStream.text(path).withColumnRenamed("value", "line")))


def write(stream: DataFrame, path: str, checkpoint: str, by: list[str] | None = None) -> StreamingQuery:
    """Appends all there is now to Parquet files, then ends; started again, it goes on where it was."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (w.partitionBy(*by) if by else w).start()
