"""Helpers shared by the training-data operators: tables, shared storage,
vectorised text decoding and connected components."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polystrata.session import materialize, release, ship  # noqa: F401

#: Bytes up to which a driver-built lookup may be broadcast; beyond it the
#: operators join on the key instead.
BROADCAST_LIMIT = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what one Arrow batch holds, so that long texts can't fill a Python worker; executors get this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ------------------------------------------------------------------------ tables


def packed(docs: DataFrame, leave: tuple[str, ...] = ()) -> tuple[Column, list[Column]]:
    """The columns of ``docs`` but ``leave`` as one struct, out of the way of the names that an operator uses, and what gives all of them again in their order."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    rest = [c for c in docs.columns if c not in leave]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    row = F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(rest)]).alias(name)
    return row, [F.col(quoted(c)) if c in leave else F.col(name).getField(f"c{rest.index(c)}").alias(c) for c in docs.columns]


def trim() -> None:
    """Gives memory that a finished task no longer needs back to the machine: Python workers live on for later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run):
    """An Arrow function that trims the worker's memory once it ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished queries now."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(doc_id, label, text) of about ``rows`` labelled documents of each class of ``column`` (0 or 1), chosen by a hash of doc_id.

    Labels with a null, or of a doc_id with both values, are left out. The
    chosen labels, of a bounded number, are broadcast.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(column).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IN (0, 1)")
    own = own.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__y1")).where("__y = __y1").drop("__y1")
    counts = {r[0]: r[1] for r in own.groupBy("__y").count().collect()}
    part = F.pmod(F.xxhash64("__id"), F.lit(1 << 20))
    keep = F.lit(False)
    for y, n in sorted(counts.items()):
        keep = keep | ((F.col("__y") == y) & (part < int((1 << 20) * min(1.0, rows / n)) + 1))
    d = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    return d.join(F.broadcast(own.where(keep)), "__id").select(F.col("__id").alias("doc_id"), F.col("__y").alias("label"), "text")


# ------------------------------------------------------------------------- text


@functools.cache
def lower_table() -> np.ndarray:
    """Code point -> its lower case where that is one code point."""
    t = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        low = chr(i).lower()
        if len(low) == 1:
            t[i] = ord(low)
    return t


@functools.cache
def alnum_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@functools.cache
def alpha_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a 0, and where each text begins."""
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    cps = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lens[:-1] + 1, out=starts[1:])
    return cps, starts


def slices(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole texts of about ``most`` characters; a longer text is a run of its own."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t)
    if len(texts) > i:
        yield i, len(texts)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased alphanumeric words, and the text each is in."""
    cps, at = code_points(texts)
    low = lower_table()[cps]
    m = alnum_table()[low]
    edge = np.flatnonzero(np.diff(m, prepend=False).astype(bool))
    begin, end = edge[0::2], edge[1::2]  # the 0 after every text closes its last word
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lens = end - begin
    inside = np.flatnonzero(m)
    first = np.zeros(len(begin), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    pos = np.arange(len(inside)) - np.repeat(first, lens)
    pw = np.multiply.accumulate(np.full(int(lens.max()), _M1 | np.uint64(1), np.uint64))
    h = np.add.reduceat((low[inside].astype(np.uint64) + np.uint64(1)) * pw[pos], first)
    return mix(h), np.searchsorted(at, begin, "right") - 1


def ngram_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams and the text each is in. A text of fewer than n words has one n-gram, of all its words."""
    w, d = word_hashes(texts)
    if not len(w):
        return w, d
    h, same = w.copy(), np.ones(len(w), bool)
    for k in range(1, n):
        nxt, ok = np.zeros_like(w), np.zeros(len(w), bool)
        if k < len(w):
            ok[:-k] = d[k:] == d[:-k]
            nxt[:-k][ok[:-k]] = w[k:][ok[:-k]]
        h = mix(h * _M1 + nxt)
        same = ok
    first = np.ones(len(w), bool)
    first[1:] = d[1:] != d[:-1]
    short = first & ~same
    keep = same | short
    return h[keep], d[keep]


# ---------------------------------------------------------- connected components


@lean
def _contract(batches: Iterable) -> Iterator:
    """Union-find over the edges of one partition; gives a star for each component found."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(x, find(x)) for x in list(parent) if find(x) != x]
    for i in range(0, len(pairs), 50_000):
        a, b = zip(*pairs[i : i + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (two integer columns); a
    component is named by its least node.

    Every partition first contracts its own edges to stars, so that at most one
    row for each node and partition is left; then large-star and small-star
    steps alternate until nothing changes. Each round ends in a table of the
    shared folder.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = materialize(e.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    w = Window.partitionBy("u")
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(w))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = large.withColumn("m", F.min("v").over(w))
        small = m.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        release(e)
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
