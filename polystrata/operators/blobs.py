"""Key/value blobs: a table of key, data (binary), prefix (a label), size, checksum, seq (order of writing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checksum(data: Column) -> Column:
    """Exclusive or of all bytes, as a number."""
    h = F.hex(data)
    pairs = F.transform(F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)), lambda i: F.conv(h.substr(i, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(h) > 1, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))).otherwise(F.lit(0).cast("long"))


def from_documents(docs: DataFrame) -> DataFrame:
    """Each document's text as the blob doc:<id>, labelled by its source."""
    data = F.encode("text", "UTF-8")
    return docs.select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("key"), data.alias("data"), F.col("source").alias("prefix"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("seq"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Last write wins; of several new rows of a key the one of the greatest seq. created_at is that of the new row."""
    w = Window.partitionBy("key").orderBy(F.desc("__new"), F.desc("seq"))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__new", "__rank")


def update(old: DataFrame, new: DataFrame) -> DataFrame:
    """As upsert(), but a key keeps its created_at, and its prefix where the new one is null."""
    kept = old.select("key", F.col("created_at").alias("__at"), F.col("prefix").alias("__prefix"))
    return upsert(old, new).join(kept, "key", "left").withColumn("created_at", F.coalesce("__at", "created_at")).withColumn("prefix", F.coalesce("prefix", "__prefix")).drop("__at", "__prefix")


def get(blobs: DataFrame, key: str) -> DataFrame:
    """The row of a key, or none; the equality reaches the scan."""
    return blobs.where(F.col("key") == key)


def remove(blobs: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the keys of another."""
    return blobs.join(keys.select("key"), "key", "left_anti")


def removal(blobs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, existed) of the distinct keys to remove."""
    have = blobs.select("key", F.lit(True).alias("__has")).distinct()
    return keys.select("key").distinct().join(have, "key", "left").select("key", F.col("__has").isNotNull().alias("existed"))


def cleared(blobs: DataFrame) -> DataFrame:
    """The table without rows."""
    return blobs.where(F.lit(False))


def scan_prefix(blobs: DataFrame, prefix: str) -> DataFrame:
    return blobs.where(F.col("key").startswith(prefix))


def glob(c: Column, pattern: str, single: bool = False) -> Column:
    """Whether the whole of a text fits a pattern in which * stands for anything, and ? for one character if ``single``."""
    special = "\\.[]{}()+-^$|" + ("" if single else "?")
    body = "".join(".*" if x == "*" else "." if x == "?" and single else "\\" + x if x in special else x for x in pattern)
    return c.rlike(f"(?s)\\A{body}\\z")


def find(blobs: DataFrame, prefix: str | None = None, pattern: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of a label whose key fits a pattern, in key order where paged; an offset past the end gives none."""
    if prefix is not None:
        blobs = blobs.where(F.col("prefix") == prefix)
    if pattern is not None:
        blobs = blobs.where(glob(F.col("key"), pattern))
    if offset or limit is not None:
        blobs = blobs.orderBy("key").offset(offset)
        blobs = blobs if limit is None else blobs.limit(limit)
    return blobs


def verify(blobs: DataFrame) -> DataFrame:
    """Whether each blob's checksum and size still hold."""
    return blobs.select("key", ((checksum(F.col("data")) == F.col("checksum")) & (F.octet_length("data") == F.col("size"))).alias("intact"))


def all_keys(shards: list[DataFrame], prefix: str | None = None) -> DataFrame:
    """Distinct keys of all shards but the index's own."""
    out = shards[0].select("key")
    for s in shards[1:]:
        out = out.unionByName(s.select("key"))
    out = out.where("key <> 'system.index'")
    return (out if prefix is None else out.where(F.col("key").startswith(prefix))).distinct()


def search_keys(blobs: DataFrame, part: str) -> DataFrame:
    """Distinct keys with a substring; internal (__) and telemetry keys are left out."""
    k = F.col("key")
    return blobs.where(k.contains(part) & ~k.startswith("__") & ~k.startswith("telemetry:")).select("key").distinct()


def with_metadata(hits: DataFrame, blobs: DataFrame, key: str = "key") -> DataFrame:
    """Search hits with the label, size and checksum of their blob, nulls where there is none."""
    meta = blobs.select(F.col("key").alias(key), "prefix", "size", "checksum")
    return hits.join(meta, key, "left")


def stats(blobs: DataFrame) -> DataFrame:
    """Keys and bytes by label."""
    return blobs.groupBy("prefix").agg(F.countDistinct("key").alias("keys"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))
