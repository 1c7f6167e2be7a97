"""Shards: how rows are routed to them, and how evenly they lie."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polystrata.operators.order import numbered


def hash32(key: Column) -> Column:
    """The first 8 hexadecimal digits of a key's MD5, as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def by_hash(key: Column, shards: int) -> Column:
    return F.pmod(hash32(key), F.lit(shards)).cast("int")


def by_prefix(key: Column, ranges: list[tuple[str, str, int]]) -> Column:
    """The shard of the first range [from, to) that the key lies in; 0 if none."""
    return reduce(lambda rest, r: F.when((key >= r[0]) & (key < r[1]), F.lit(r[2])).otherwise(rest), reversed(ranges), F.lit(0)).cast("int")


def round_robin(df: DataFrame, by: str, shards: int) -> DataFrame:
    """Rows dealt to the shards in turn, in the order of an integer column."""
    return numbered(df, by, "__n").withColumn("shard", (F.col("__n") % shards).cast("int")).drop("__n")


def ring(shards: int, points: int = 150) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes of a consistent-hash ring, by place."""
    import hashlib

    return sorted((int(hashlib.md5(f"shard_{s}:{v}".encode()).hexdigest()[:8], 16), s) for s in range(shards) for v in range(points))


def consistent(key: Column, shards: int, points: int = 150) -> Column:
    """The shard of the first virtual node at or after the key's place, around the ring."""
    nodes = ring(shards, points)
    places = F.array(*(F.lit(p).cast("long") for p, _ in nodes))
    owners = F.array(*(F.lit(s) for _, s in nodes))
    h = hash32(key)
    after = F.size(F.filter(places, lambda p: p < h))
    return F.get(owners, F.pmod(after, F.lit(len(nodes))))


def balance(df: DataFrame, shard: str = "shard") -> DataFrame:
    """Rows of the shards: entropy 1 - min(deviation / mean, 1), balance mean / most, and share of the largest."""
    c = df.groupBy(shard).agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("shards"), F.sum("n").alias("rows"), F.round(1 - F.least(F.stddev_pop("n") / F.avg("n"), F.lit(1.0)), 6).alias("entropy"), F.round(F.avg("n") / F.max("n"), 6).alias("balance"))


def shares(df: DataFrame, shard: str = "shard") -> DataFrame:
    """Rows of each shard and their share of all."""
    c = df.groupBy(shard).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


# ------------------------------------------------------------------- routed store


def put(stored: DataFrame, new: DataFrame, shard: Column) -> DataFrame:
    """The sharded store (key, shard, data, seq) after writing ``new`` (key, data, seq) to its shards; a key keeps the shard that it has, and the last write wins."""
    own = stored.groupBy("key").agg(F.min("shard").alias("__own"))
    new = new.join(own, "key", "left").withColumn("shard", F.coalesce("__own", shard)).drop("__own")
    w = Window.partitionBy("key", "shard").orderBy(F.desc("__new"), F.desc("seq"))
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__new", "__r")


def written(new: DataFrame) -> DataFrame:
    """Writes of each shard: every one counts, an overwriting one too."""
    return new.groupBy("shard").agg(F.count("*").alias("writes"), F.countDistinct("key").alias("keys"))


def _first(stored: DataFrame, shard: Column) -> Column:
    return F.row_number().over(Window.partitionBy("key").orderBy(F.col("shard") != shard, "shard"))


def lookup(stored: DataFrame, keys: DataFrame, shard: Column) -> DataFrame:
    """Of each key asked for its copy in its own shard, else the one in the first shard that has it; no row if none has."""
    hits = stored.join(keys.select("key").distinct(), "key", "left_semi")
    return hits.withColumn("__r", _first(hits, shard)).where("__r = 1").drop("__r")


def exists(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, there) of each key asked for."""
    have = stored.select("key", F.lit(True).alias("__has")).distinct()
    return keys.select("key").distinct().join(have, "key", "left").select("key", F.col("__has").isNotNull().alias("there"))


def delete(stored: DataFrame, keys: DataFrame, shard: Column) -> DataFrame:
    """The store without the first copy, as lookup() finds it, of each key; other copies stay."""
    gone = lookup(stored, keys, shard).select("key", "shard")
    return stored.join(gone, ["key", "shard"], "left_anti")


def replicated(df: DataFrame, shards: int) -> DataFrame:
    """Every row in every shard."""
    return df.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def health(df: DataFrame, shards: int, shard: str = "shard") -> DataFrame:
    """(shard, rows, keys, healthy) of every shard; an empty one is healthy too, one that holds a null key isn't."""
    g = df.groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("rows"), F.countDistinct("key").alias("keys"), F.count_if(F.col("key").isNull()).alias("__bad"))
    every = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(g, "shard", "left").select("shard", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("keys", F.lit(0)).alias("keys"), (F.coalesce("__bad", F.lit(0)) == 0).alias("healthy"))


def redirected(df: DataFrame, shards: int, ratio: float = 0.7, shard: str = "shard") -> DataFrame:
    """Rows whose shard holds more than 1 / ``ratio`` times the mean go to the emptiest one; new_shard is where each lies then. Ties go to the lower shard."""
    n = df.groupBy(F.col(shard).alias("__s")).agg(F.count("*").alias("__n"))
    every = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("__s")).join(n, "__s", "left").select("__s", F.coalesce("__n", F.lit(0)).alias("__n"))
    all_ = every.agg(F.avg("__n").alias("__mean"), F.min(F.struct("__n", "__s"))["__s"].alias("__low"))
    over = every.crossJoin(F.broadcast(all_)).where(F.col("__mean") < ratio * F.col("__n")).select("__s", "__low")  # one row by one row a shard
    return df.join(F.broadcast(over), F.col(shard) == F.col("__s"), "left").withColumn("new_shard", F.coalesce("__low", shard)).drop("__s", "__low")


def resharded(df: DataFrame, key: Column, before: int, after: int) -> DataFrame:
    """Each row's shard among ``before`` and among ``after`` shards of a consistent-hash ring, and whether it moves."""
    return df.withColumns({"old_shard": consistent(key, before), "new_shard": consistent(key, after)}).withColumn("moves", F.col("old_shard") != F.col("new_shard"))
