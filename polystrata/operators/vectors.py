"""Vectors: similarity expressions, exact nearest neighbours, hybrid and time-weighted ranking, embeddings of bytes and words."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

LEAST = 0.3  #: hits must be above
BLOCK = 2048  #: vectors that are multiplied at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance over the shorter one's length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))))


def unit(a: Column) -> Column:
    """Length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def scored(vectors: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """``vectors`` with their cosine to one query vector, as score; 0 where either is zero, or a vector is null or has a null."""
    return vectors.withColumn("score", to_query(query)(F.col(vector)))


def to_query(query: Sequence[float]) -> Callable[[Column], Column]:
    """The cosine of a column of vectors to one, as scored() has it, by blocks of vectors. It counts as chance, so that a filter on it isn't pushed before it and has it worked out again."""
    q = np.array(query, np.float64)
    length = float(np.linalg.norm(q))

    def cosines(a: pa.Array) -> pa.Array:
        out = np.zeros(len(a))
        for k in range(0, len(a), BLOCK):
            part = a.slice(k, BLOCK)
            n = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
            flat = part.flatten()
            bad = pc.is_null(flat).to_numpy(zero_copy_only=False)
            x = np.where(bad, 0.0, flat.to_numpy(zero_copy_only=False)).astype(np.float64)
            if len(q) and (n == len(q)).all():
                m = x.reshape(len(n), -1)
                dots, own = m @ q, np.sqrt(np.einsum("ij,ij->i", m, m))
            else:  # a dot product goes over the shorter one's length
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                dots = np.bincount(row, np.where(at < len(q), x * np.append(q, 0.0)[np.minimum(at, len(q))], 0.0), len(n))
                own = np.sqrt(np.bincount(row, x * x, len(n)))
            if bad.any():
                own[np.unique(np.repeat(np.arange(len(n)), n)[bad])] = 0
            own = own * length
            some = ~(own <= 0)  # one that is no number gives none
            out[k : k + len(n)][some] = dots[some] / own[some]
        return pa.array(out)

    return F.arrow_udf(cosines, DoubleType()).asNondeterministic()


def knn(vectors: DataFrame, query: Sequence[float], n: int, key: str = "vec_id", vector: str = "embedding", least: float = LEAST, digits: int = 6) -> DataFrame:
    """The n nearest by cosine above ``least``, ties by key."""
    return scored(vectors, query, vector).where(F.col("score") > least).withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), key).limit(n)


def knn_join(queries: DataFrame, vectors: DataFrame, n: int, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, key, score): the n nearest of every query in a batch, by blocks of matrix products.

    Queries and vectors are hashed into blocks of about ``block`` rows, and each
    pair of blocks is multiplied in one task, which keeps the n best of each query;
    neither side reaches the driver. Each side is shuffled once for each block of
    the other, so the work is that of all pairs.
    """
    q = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(0).alias("side")).where("id IS NOT NULL AND v IS NOT NULL")
    x = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.lit(1).alias("side")).where("id IS NOT NULL AND v IS NOT NULL")
    many, all_ = (max(1, -(-d.count() // block)) for d in (q, x))
    if n < 1:
        raise ValueError("n must be at least 1")
    q = q.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(many))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(all_ - 1).cast("long"))))
    x = x.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(all_))).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        own, other = p[p["side"] == 0], p[p["side"] == 1]
        if own.empty or other.empty:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), key: pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        unit_ = lambda d: (lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300))(np.array(d["v"].tolist(), np.float64))
        ids, to, u, w = own["id"].to_numpy(), other["id"].to_numpy(), unit_(own), unit_(other)
        got = []
        for k in range(0, len(ids), 512):
            s = np.round(u[k : k + 512] @ w.T, 6)
            s[ids[k : k + 512, None] == to[None, :]] = -np.inf
            least = np.partition(s, -min(n, s.shape[1]), axis=1)[:, -min(n, s.shape[1])]
            r, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
            o = np.lexsort((to[c], -s[r, c], r))
            r, c = r[o], c[o]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < n
            got.append((ids[k + r[keep]], to[c[keep]], s[r[keep], c[keep]]))
        return pd.DataFrame({"query_id": np.concatenate([g[0] for g in got]), key: np.concatenate([g[1] for g in got]), "score": np.concatenate([g[2] for g in got])})

    out = q.unionByName(x).groupBy("a", "b").applyInPandas(run, f"query_id long, {key} long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def averages(vectors: DataFrame, by: str, vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(by, n, centroid): element-wise means of each group."""
    g = vectors.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return g.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", F.round("m", digits).alias("m")))), lambda s: s["m"]).alias("centroid"))


def hybrid_top(semantic: DataFrame, keyword: DataFrame, n: int, weight: float = 0.5, scale: float = 100.0, key: str = "doc_id") -> DataFrame:
    """hybrid() of the 2n best of either list, ties by key; the n best of it."""
    best = lambda d: d.orderBy(F.desc("score"), key).limit(2 * n)
    return hybrid(best(semantic), best(keyword), weight, scale, key).orderBy(F.desc("score"), key).limit(n)


def within_time(scored_rows: DataFrame, start: str, end: str, weight: float = 0.7, time_weight: float = 0.3, least: float = 0.2) -> DataFrame:
    """Similarity and time combined: the time score is 1 inside an inclusive range and 0 outside."""
    t = F.when(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")), 1.0).otherwise(0.0)
    return scored_rows.withColumn("combined", F.round(weight * F.col("score") + time_weight * t, 6)).where(F.col("combined") >= least)


def around_event(rows: DataFrame, ident, hours: float, weight: float = 0.8, time_weight: float = 0.2, least: float = 0.4) -> DataFrame:
    """(id, combined): rows (id, ts, key, source, embedding) like one of them: of its key and source, at most ``hours`` from it, by similarity and nearness in time; not itself. No row if there is no such id."""
    me = F.broadcast(rows.where(F.col("id") == ident).orderBy("ts").limit(1).select(F.col("ts").alias("__ts"), F.col("key").alias("__key"), F.col("source").alias("__source"), F.col("embedding").alias("__v")))  # one row
    gap = F.abs(F.col("ts").cast("timestamp").cast("double") - F.col("__ts").cast("timestamp").cast("double"))
    near = rows.where(F.col("id") != ident).join(me, (F.col("key") == F.col("__key")) & (F.col("source") == F.col("__source")) & (gap <= hours * 3600))
    score = F.round(weight * F.round(cosine(F.col("embedding"), F.col("__v")), 6) + time_weight * (1 - gap / (hours * 3600)), 6)
    return near.select("id", score.alias("combined")).where(F.col("combined") >= least)


def upserted(stored: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Vectors (key, modality, embedding, seq) after writing more: of a key and modality the last stays."""
    w = Window.partitionBy(key, "modality").orderBy(F.desc("__new"), F.desc("seq"))
    both = stored.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__new", "__r")


def text_similarity(a: Column, b: Column) -> Column:
    """Cosine of the byte embeddings of two texts."""
    return cosine(byte_embedding(a), byte_embedding(b))


def hybrid(semantic: DataFrame, keyword: DataFrame, weight: float = 0.5, scale: float = 100.0, key: str = "doc_id") -> DataFrame:
    """Full outer combination of two hit lists: weight x similarity + (1 - weight) x min(tf / scale, 1)."""
    v = semantic.select(key, F.col("score").alias("v"))
    k = keyword.select(key, F.col("score").alias("k"))
    return v.join(k, key, "full").select(key, F.round(F.coalesce("v", F.lit(0.0)) * weight + F.least(F.coalesce("k", F.lit(0)) / scale, F.lit(1.0)) * (1 - weight), 6).alias("score"))


def time_weighted(scored_rows: DataFrame, as_of, window_seconds: float, weight: float = 0.7, time_weight: float = 0.3, least: float = 0.2) -> DataFrame:
    """Similarity and nearness in time combined: the time score falls from 1 at ``as_of`` to 0 at the window's end."""
    gap = F.abs(F.col("ts").cast("timestamp").cast("double") - F.lit(as_of).cast("timestamp").cast("double"))
    t = F.greatest(F.lit(0.0), 1 - gap / window_seconds)
    return scored_rows.withColumn("combined", F.round(weight * F.col("score") + time_weight * t, 6)).where(F.col("combined") >= least)


def byte_vectors(a: pa.Array) -> np.ndarray:
    """byte_embedding() of texts or binary values as rows of a matrix; nulls are zero."""
    a = a.cast(pa.large_binary()) if not pa.types.is_large_binary(a.type) else a
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8) if len(a) else np.zeros(0, np.uint8)
    out = np.zeros((len(a), 384))
    for v, i, j in zip(out, off[:-1].tolist(), off[1:].tolist()):
        k = (j - i) // 384 * 384
        if k:
            v += data[i : i + k].reshape(-1, 384).sum(0)
        v[: j - i - k] += data[i + k : j]
    out /= 255.0
    n = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.where(n > 0, n, 1.0)[:, None]
    return out


def _lists(m: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix as a list column that shares its memory."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1)), mask=None if null is None else pa.array(null))


@F.arrow_udf(ArrayType(DoubleType()))
def byte_embedding(a: pa.Array) -> pa.Array:
    """384 numbers: byte i of a text adds its value / 255 to number i mod 384; then unit length."""
    null = a.is_null().to_numpy(zero_copy_only=False)
    m = byte_vectors(pc.fill_null(a, b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else ""))
    return _lists(m, null if null.any() else None)


@F.arrow_udf(ArrayType(DoubleType()))
def binary_embedding(data: pa.Array) -> pa.Array:
    """384 numbers of a binary value: i / 384 where it is under 1000 bytes, else 384 bytes at an even stride, / 255."""
    i = np.arange(384)
    null = data.is_null().to_numpy(zero_copy_only=False)
    d = pc.fill_null(data, b"").cast(pa.large_binary())
    out = np.tile(i / 384, (len(d), 1))
    if len(d):
        off, b = np.frombuffer(d.buffers()[1], np.int64)[d.offset : d.offset + len(d) + 1], np.frombuffer(d.buffers()[2] or b"", np.uint8)
        n = np.diff(off)
        long = n >= 1000
        out[long] = b[off[:-1][long][:, None] + n[long][:, None] // 384 * i] / 255
    return _lists(out, null if null.any() else None)


@functools.lru_cache(1 << 16)
def _word_place(w: str) -> int:
    h = 0
    for x in w.encode():
        h = (h * 31 + x) & 0xFFFFFFFF
    return h % 128


@F.arrow_udf(ArrayType(DoubleType()))
def word_embedding(a: pa.Array) -> pa.Array:
    """128 numbers: each word adds 1 + log10 of its count at the place of its polynomial hash; then unit length."""
    out = np.zeros((len(a), 128))
    for v, t in zip(out, a):
        for w, c in Counter((t.as_py() or "").lower().split()).items():
            v[_word_place(w)] += 1 + math.log10(c)
    n = np.sqrt(np.einsum("ij,ij->i", out, out))
    out /= np.where(n > 0, n, 1.0)[:, None]
    return _lists(out)
