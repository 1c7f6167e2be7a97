"""Multidimensional cells: samples at 1 to 3 coordinates, each cell with a bounded queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell_key(*at: Column) -> Column:
    """x, x_y or x_y_z."""
    return F.concat_ws("_", *(a.cast("string") for a in at))


def queued(samples: DataFrame, capacity: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What is left of each cell after pushing all its samples in order: the last ``capacity``."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(o) for o in order))
    return samples.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= capacity).drop("__r")


def within(samples: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Samples whose coordinates lie in inclusive bounds."""
    for c, (lo, hi) in bounds.items():
        samples = samples.where(F.col(c).between(lo, hi))
    return samples


def in_time(samples: DataFrame, cell: str, start, end, ts: str = "ts") -> DataFrame:
    """One cell's samples of an inclusive range of time."""
    return samples.where((F.col("cell") == cell) & F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def summary(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    return samples.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def registered(dims: DataFrame, new: DataFrame) -> DataFrame:
    """(label, added) of dimensions to register: one that is there already isn't added."""
    have = dims.select("label", F.lit(True).alias("__has")).distinct()
    return new.select("label").distinct().join(have, "label", "left").select("label", F.col("__has").isNull().alias("added"))


def dropped(samples: DataFrame, dim: str, labels: Sequence) -> DataFrame:
    """Samples without those of dropped dimensions."""
    return samples.where(~F.col(dim).isin(list(labels)))
