"""Exact top-k full-text search by a three-phase uniform threshold.

The score of a document is a sum over the query's terms (BM25), and every term's
posting list is a list of local scores:

1. each list gives its k best entries; the k-th best of their partial sums is a
   lower bound of the k-th best total, and the largest cutoff T with
   sum(min(T, best of list)) no more than that bound is safe: a document below
   T in every list can't be among the k best;
2. T is broadcast, every list gives its entries of at least T, and documents
   whose upper bound stays below the k-th best lower bound are dropped;
3. the scores still missing of the remaining documents are looked up, so that
   their totals, order and ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polystrata.llm.common import BROADCAST_LIMIT, free_shuffles, materialize, slices, tune, word_hashes

K, K1, B = 10, 1.2, 0.75
_EPS = 1e-9
PLACES = 6  #: of a score
_UNIT = 1.01 * 10.0**-PLACES  #: totals this near may be equal once rounded, and then the lower doc_id is first


def _few(df: DataFrame, rows: int, width: int) -> DataFrame:
    return F.broadcast(df) if rows * width <= BROADCAST_LIMIT else df


def query_terms(queries: DataFrame, ident: str, text: str) -> DataFrame:
    """(q, term, qtf): hashes of the words of each query and how often it has them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(texts):
                h, d = word_hashes(texts[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids[i:j], np.int64)[d] if len(d) else [], pa.int64()), pa.array(h.view(np.int64), pa.int64())], ["q", "term"])

    q = queries.select(F.col(ident).cast("long").alias("q"), F.col(text).cast("string").alias("t")).where("q IS NOT NULL AND t IS NOT NULL")
    return q.mapInArrow(run, "q long, term long").groupBy("q", "term").agg(F.count("*").alias("qtf"))


def _postings(terms: np.ndarray | None):
    """One row for each document and term (of ``terms``, if given): term, row, doc_id, tf, dl. A row with tf -1 has the partition's documents and words."""
    names = ["term", "r", "doc_id", "tf", "dl"]

    def batch(*cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, words, base = 0, 0, TaskContext.get().partitionId() << 40
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(texts):
                h, d = word_hashes(texts[i:j])
                dl = np.bincount(d, minlength=j - i)
                words += len(h)
                if terms is not None and len(h):
                    at = np.searchsorted(terms, h)
                    ok = terms[np.minimum(at, len(terms) - 1)] == h if len(terms) else np.zeros(len(h), bool)
                    h, d = h[ok], d[ok]
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                first = np.flatnonzero((np.diff(d, prepend=-1) != 0) | np.append(True, h[1:] != h[:-1])[: len(h)]) if len(h) else np.zeros(0, np.int64)
                tf = np.diff(np.append(first, len(h)))
                own = d[first]
                yield batch(h[first].view(np.int64), base + r + own, ids.slice(i, j - i).take(pa.array(own)), tf, dl[own])
                r += j - i
        yield batch([0], [r], [words], [-1], [0])

    return run


def _local_top(k: int):
    """The k best entries of each term in one partition; ties go to the lower row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, row, w = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for b in batches:
            term, row, w = (np.concatenate([x, b.column(c).to_numpy(zero_copy_only=False)]) for c, x in enumerate((term, row, w)))
            order = np.lexsort((row, -w, term))
            term, row, w = term[order], row[order], w[order]
            first = np.flatnonzero(np.diff(term, prepend=term[0] - 1 if len(term) else 0))
            rank = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
            term, row, w = (x[rank < k] for x in (term, row, w))
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(row), pa.array(w)], ["term", "r", "w"])

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = K, ident: str = "item_id", text: str = "text") -> DataFrame:
    """(query, rank, doc_id, score): the k best documents of every row of ``queries`` by BM25, exactly.

    ``docs`` needs doc_id and text, ``queries`` the columns ``ident`` and
    ``text``. Words are runs of letters and digits in lower case. Document
    counts, lengths and frequencies cover all documents, those with a null or
    empty text too (of length 0). A document that shares no word with the query
    isn't found, so a query may have fewer than k rows, or none if it is null,
    empty or shares no word. Rows that repeat a doc_id are documents of their
    own. Scores are rounded to PLACES places; ties of what is rounded go to the
    lower doc_id, nulls first, so both cutoffs leave a unit of the last place.
    The whole of a very long text counts, by its length. Other columns are
    ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    qt = materialize(query_terms(queries, ident, text), "terms")
    n_terms = qt.select("term").distinct().count()
    few_terms = n_terms * 8 <= BROADCAST_LIMIT
    terms = np.sort(qt.select("term").distinct().toArrow().column(0).to_numpy().view(np.uint64)) if few_terms else None  # 8 bytes each
    shared = _postings(terms)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = src.mapInArrow(shared, "term long, r long, doc_id long, tf int, dl int")
    if not few_terms:
        got = got.join(qt.select("term").distinct().unionByName(spark.range(1).select(F.lit(0).cast("long").alias("term"))), "term", "left_semi")
    got = materialize(got, "postings")
    n, words = got.where("tf < 0").agg(F.sum("r"), F.sum("doc_id")).first()
    mean = float(words or 0) / max(1, n or 0) or 1.0
    weight = F.expr(f"tf * {K1 + 1!r}D / (tf + {K1!r}D * ({1 - B!r}D + {B!r}D * dl / {mean!r}D))")
    post = got.where("tf > 0").withColumn("w", weight)

    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.lit(float(n or 0)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    qt = materialize(qt.join(df, "term").select("q", "term", (F.col("qtf") * idf).alias("coef")), "coefs")
    n_coef = qt.count()
    lists = _few(qt, n_coef, 24)

    # 1: k best of each list, a bound of the k-th total, the safe cutoff.
    best = post.select("term", "r", "w").mapInArrow(_local_top(k), "term long, r long, w double")
    wt = Window.partitionBy("term").orderBy(F.desc("w"), "r")
    best = materialize(best.withColumn("rank", F.row_number().over(wt)).where(F.col("rank") <= k).drop("rank"), "lists")
    entry = best.join(lists, "term").withColumn("s", F.col("coef") * F.col("w"))
    tops = entry.groupBy("q", "term").agg(F.max("s").alias("most"))
    wq = Window.partitionBy("q").orderBy(F.desc("sum"))
    part = entry.groupBy("q", "r").agg(F.sum("s").alias("sum")).withColumn("rank", F.row_number().over(wq)).where(F.col("rank") == k).select("q", F.col("sum").alias("bound"))
    wm = Window.partitionBy("q").orderBy("most", "term")
    level = tops.join(part, "q", "left").withColumn("bound", F.greatest(F.coalesce("bound", F.lit(0.0)) - _UNIT, F.lit(0.0)))
    level = level.withColumns({"before": F.sum("most").over(wm) - F.col("most"), "left": F.count("*").over(Window.partitionBy("q")) - F.row_number().over(wm) + 1})
    level = level.withColumn("t", (F.col("bound") - F.col("before")) / F.col("left"))
    cut = level.groupBy("q").agg(F.min(F.when(F.col("t") <= F.col("most"), F.struct("before", "t"))["t"]).alias("t0"), F.max("most").alias("top"), F.max("bound").alias("bound"), F.collect_list("most").alias("mosts"))
    cut = cut.withColumn("t", F.greatest(F.coalesce("t0", "top") * (1 - _EPS), F.lit(0.0))).withColumn("unseen", F.aggregate("mosts", F.lit(0.0), lambda a, m: a + F.least(m, F.col("t"))))
    cut = materialize(cut.select("q", "t", "bound", "unseen"), "cuts")

    # 2: entries of at least the cutoff; bounds.
    want = qt.join(cut, "q")
    floor = want.groupBy("term").agg(F.min(F.col("t") / F.col("coef")).alias("least"))
    seen = post.select("term", "r", "w").join(_few(floor, n_terms, 16), "term").where("w >= least").select("term", "r", "w")
    seen = seen.join(_few(want.select("q", "term", "coef", "t"), n_coef, 32), "term").where("coef * w >= t")
    low = seen.groupBy("q", "r").agg(F.sum(F.expr("coef * w")).alias("low"), F.count("*").alias("lists"))
    low = materialize(low, "bounds")
    wl = Window.partitionBy("q").orderBy(F.desc("low"))
    second = low.withColumn("rank", F.row_number().over(wl)).where(F.col("rank") == k).select("q", F.col("low").alias("second"))
    n_q = max(1, cut.count())
    cand = low.join(_few(cut.join(second, "q", "left"), n_q, 64), "q")
    cand = cand.where(F.expr(f"low + unseen - lists * t >= greatest(bound, coalesce(second, 0D) - {_UNIT!r}) - {_EPS!r} * (1 + bound)")).select("q", "r")
    cand = materialize(cand, "candidates")
    free_shuffles(spark)

    # 3: exact totals of the candidates.
    rows = cand.select("r").distinct()
    n_cand = cand.count()
    full = post.select("term", "r", "doc_id", "w").join(_few(rows, n_cand, 16), "r", "left_semi" if n_cand * 16 > BROADCAST_LIMIT else "inner")
    total = full.join(_few(cand, n_cand, 24), "r").join(lists, ["q", "term"])
    total = total.groupBy("q", "r").agg(F.first("doc_id").alias("doc_id"), F.round(F.sum(F.expr("coef * w")), PLACES).alias("score"))
    wr = Window.partitionBy("q").orderBy(F.desc("score"), "doc_id", "r")
    return total.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= k).select(F.col("q").alias("query"), "rank", "doc_id", "score")


#: The same rows in DuckDB SQL over documents and benchmark.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS a FROM documents),
s AS (SELECT count(*) AS n, sum(len(a)) / count(*)::DOUBLE AS mean FROM d),
q AS (SELECT item_id AS q, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT r, doc_id, dl, term, count(*) AS tf FROM (SELECT r, doc_id, len(a) AS dl, unnest(a) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
t AS (SELECT q.q, p.r, any_value(p.doc_id) AS doc_id,
             round(sum(qtf * ln(1 + (s.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {K1 + 1!r}::DOUBLE / (tf + {K1!r}::DOUBLE * ({1 - B!r}::DOUBLE + {B!r}::DOUBLE * dl / s.mean))), {PLACES}) AS score
      FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY q.q, p.r)
SELECT q AS query, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM t) WHERE rank <= {K}
"""
