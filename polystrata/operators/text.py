"""Full-text search: tokens, postings, ranking, fuzzy, phrase and proximity search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

STOP = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "this", "that", "it", "as", "from")
SUFFIXES = ("ing", "ed", "s", "es", "ly", "ment", "tion", "able", "ible")


def stem(word: Column) -> Column:
    """The word without the first of SUFFIXES that it ends in, if more than two characters stay."""
    out = F.lit(None).cast("string")
    for s in reversed(SUFFIXES):
        out = F.when(word.endswith(s) & (F.length(word) > len(s) + 2), word.substr(F.lit(1), F.length(word) - len(s))).otherwise(out)
    return F.coalesce(out, word)


def stemmed(word: str) -> str:
    """stem() of one word, in Python."""
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) > len(s) + 2), word)


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def tokens(text: Column, least: int = 2, most: int = 50, stems: bool = True, stop: tuple[str, ...] = STOP) -> Column:
    """Words of a length in bytes, without stop words, stemmed."""
    keep = F.filter(words(text), lambda w: F.octet_length(w).between(least, most) & ~w.isin(*stop))
    return F.transform(keep, stem) if stems else keep


def query_tokens(query: str) -> list[str]:
    """tokens() of a query, on the driver."""
    import re

    out = []
    for w in re.findall(r"[^\W_]+", query.lower()):
        if 2 <= len(w.encode()) <= 50 and w not in STOP:
            out.append(stemmed(w))
    return out


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf): the inverted index."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def may_hold(text: Column, terms: list[str]) -> Column:
    """Whether a text has any of some stems in it: a test on the raw text, before it is cut into words; one that fails has none of them as a term."""
    low = F.lower(text)
    out = F.lit(False)
    for t in sorted(set(terms)):
        out = out | F.contains(low, F.lit(t))
    return out


def search(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, matched): term frequencies of the query's terms summed, a repeated term twice.

    A filter on each text's own tokens: nothing is shuffled.
    """
    q = query_tokens(query)
    hit = F.filter(tokens(F.col(text)), lambda t: t.isin(*q) if q else F.lit(False))
    weigh = F.create_map(*[x for t in sorted(set(q)) for x in (F.lit(t), F.lit(q.count(t)))]) if q else F.create_map()
    d = docs.where(may_hold(F.col(text), q)).select(key, text, hit.alias("__hit")).where(F.size("__hit") > 0)
    score = F.aggregate("__hit", F.lit(0).cast("long"), lambda a, t: a + F.element_at(weigh, t)) if q else F.lit(0).cast("long")
    return d.select(key, score.alias("score"), F.array_sort(F.array_distinct("__hit")).alias("matched"), text)


# ------------------------------------------------------------------ persisted index


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of (key, words that aren't stemmed): a row for each term with the keys, numbers of words and term frequencies of its documents, and a row '' with the sum of words and the number of documents. A word is stemmed once a batch."""
    for b in batches:
        key, lists = b.column(0), b.column(1)
        n, words = len(key), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        raw = lists.flatten().dictionary_encode()
        stems = pa.array([stemmed(w) for w in raw.dictionary.to_pylist()], pa.string()).dictionary_encode()
        term = stems.indices.to_numpy(zero_copy_only=False)[raw.indices.to_numpy(zero_copy_only=False)]
        pairs, tf = np.unique(term.astype(np.int64) * n + np.repeat(np.arange(n), words), return_counts=True)  # by term, then place in the batch
        of, at = np.divmod(pairs, max(1, n))
        ends = np.append(np.searchsorted(of, np.arange(len(stems.dictionary) + 1)), len(of) + 1).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(np.minimum(ends, len(of))), key.take(pa.array(at)))
        words_of, tfs = (pa.ListArray.from_arrays(pa.array(ends), pa.array(np.append(x, total).astype(np.int32))) for x, total in ((words[at], words.sum()), (tf, n)))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([stems.dictionary, pa.array([""])]), keys, words_of, tfs], ["term", "keys", "words", "tfs"])


def _folder(term: Column, slots: int, parts: int) -> Column:
    """The folder of a term: neighbouring partitions of a shuffle by term into ``slots`` share one."""
    return F.floor(F.pmod(F.hash(term), F.lit(slots)) * parts / slots).cast("int")


def save_index(docs: DataFrame, path: str, parts: int = 16, key: str = "doc_id", text: str = "text") -> None:
    """Writes the inverted index with each document's number of words, in folders by a hash of the term and sorted by term in each file, so that a query reads few row groups of few folders; and the documents and words there are. ``key`` is unique.

    A text is cut into words once, and its terms are counted before they are shuffled, once: a row holds a term's
    documents of an Arrow batch. The totals of batches are in the folder -1.
    """
    spark = docs.sparkSession
    raw = F.coalesce(tokens(F.col(text), stems=False), F.array().cast("array<string>"))
    schema = StructType().add("term", "string").add("keys", ArrayType(docs.schema[key].dataType)).add("words", ArrayType(IntegerType())).add("tfs", ArrayType(IntegerType()))
    none = spark.createDataFrame([("", [], [0], [0])], schema)  # so that an index of no document has its columns
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = tasks * -(-parts // tasks)
    p = docs.select(key, raw.alias("words")).mapInArrow(_inverted, schema).unionByName(none).repartition("term")
    p = p.withColumn("part", F.when(F.col("term") == "", -1).otherwise(_folder(F.col("term"), slots, parts)))
    p.sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    total = spark.read.parquet(f"{path}/postings").where("part = -1").select(F.get("tfs", F.lit(0)).alias("documents"), F.get("words", F.lit(0)).alias("words"))
    total.agg(F.sum("documents").alias("documents"), F.sum("words").alias("words"), F.lit(parts).alias("parts"), F.lit(slots).alias("slots")).coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")


def load_index(spark, path: str, terms: list[str] | None = None) -> DataFrame:
    """The postings (key, words, term, tf, part) of some terms, or all; folders and row groups of others aren't read."""
    p = spark.read.parquet(f"{path}/postings").where("part >= 0")
    if terms is not None and not terms:
        p = p.where(F.lit(False))
    elif terms is not None:
        s = spark.read.parquet(f"{path}/summary").first()
        owner = spark.range(1).select(F.array_distinct(F.array(*(_folder(F.lit(t), s["slots"], s["parts"]) for t in terms)))).first()[0]
        p = p.where(F.col("part").isin(owner) & F.col("term").isin(terms))
    documents = F.arrays_zip(F.col("keys").alias("key"), F.col("words"), F.col("tfs").alias("tf"))
    return p.select("term", "part", F.explode(documents).alias("x")).select("x.key", "x.words", "term", "x.tf", "part")


def search_index(spark, path: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score, bm25) from a saved index: term frequencies summed, a repeated term twice, and Okapi BM25 of the distinct terms. Only the query's postings are read and shuffled."""
    q = query_tokens(query)
    p = load_index(spark, path, sorted(set(q)))
    s = spark.read.parquet(f"{path}/summary").select(F.col("documents").alias("n"), (F.col("words") / F.greatest("documents", F.lit(1))).alias("len"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))  # one row a query term
    weigh = F.create_map(*[x for t in sorted(set(q)) for x in (F.lit(t), F.lit(q.count(t)))]) if q else F.create_map(F.lit(""), F.lit(1))
    one = p.join(F.broadcast(df), "term").crossJoin(F.broadcast(s))  # one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("words") / F.col("len")))
    return one.groupBy("key").agg(F.sum(F.col("tf") * F.element_at(weigh, F.col("term"))).cast("long").alias("score"), F.round(F.sum(part), 6).alias("bm25"))


def without(index: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings without those of some documents."""
    return index.join(keys.select(key).distinct(), key, "left_anti")


def vocabulary(docs: DataFrame, word: str, budget: int, text: str = "text") -> DataFrame:
    """(term, distance): the distinct words of all texts that at most ``budget`` substitutions, insertions, deletions and transpositions make of ``word``.

    Lengths and letters bound the distance before it is worked out: an edit changes
    the length by one at most, and the letters of at most two places.
    """
    w = word.lower()
    t = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).distinct().where(F.length("term").between(len(w) - budget, len(w) + budget))
    have = F.array(*(F.lit(c) for c in sorted(set(w)))) if w else F.array().cast("array<string>")
    lost = F.size(F.filter(have, lambda c: ~F.contains(F.col("term"), c)))
    return t.where(lost <= budget).withColumn("distance", damerau(F.col("term"), F.lit(w))).where(F.col("distance") <= budget)


def mean_similarity(a: Column, b: Column) -> Column:
    """Mean of Jaro-Winkler and Dice similarity."""
    return (jaro_winkler(a, b) + dice(a, b)) / 2


def facet_page(items: DataFrame, facets: list[str], where: Column, key: str, offset: int, limit: int) -> DataFrame:
    """(total, page, counts) after all filters: how many items fit, the keys of a page in their order, and of each facet its values by falling count, those of count 0 left out."""
    fits = items.where(where)
    long = fits.select(F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets))).alias("x")).where("x.value IS NOT NULL")
    counts = long.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
    counts = counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("facet", (-F.col("n")).alias("m"), "value"))), lambda x: F.concat_ws(":", x["facet"], x["value"], (-x["m"]).cast("string"))).alias("counts"))
    page = fits.orderBy(key).offset(offset).limit(limit).agg(F.array_sort(F.collect_list(key)).alias("page"))
    return fits.agg(F.count("*").alias("total")).crossJoin(page).crossJoin(counts)  # one row each


def top(hits: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The n best by score, ties by key."""
    return hits.orderBy(F.desc("score"), key).limit(n)


def _count_of(column: str, term: str) -> Column:
    return F.size(F.filter(column, lambda x: x == term))


def log_tf(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Mean over the query's terms of (1 + log10 count) / (1 + count / words)."""
    q = sorted(set(query_tokens(query)))
    # A row of one: a projection would be put into the filter on the score, which would cut the text into words for each use.
    d = docs.where(may_hold(F.col(text), q)).select(key, F.explode(F.array(tokens(F.col(text)))).alias("__t"))
    total = F.lit(0.0)
    for t in q:
        c = _count_of("__t", t)
        total = total + F.when(c > 0, (1 + F.log10(c.cast("double"))) / (1 + c / F.size("__t"))).otherwise(0.0)
    return d.select(key, F.round(total / max(1, len(q)), 6).alias("score")).where("score > 0")


def bm25(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Okapi BM25 over the whole table's statistics: one pass for them, one for the scores."""
    q = sorted(set(query_tokens(query)))
    d = docs.select(key, tokens(F.col(text)).alias("__t"))
    count = {t: _count_of("__t", t) for t in q}
    stats = d.agg(F.count("*").alias("n"), F.avg(F.size("__t")).alias("len"), *(F.count(F.when(c > 0, 1)).alias(f"df{i}") for i, c in enumerate(count.values())))
    s = docs.where(may_hold(F.col(text), q)).select(key, tokens(F.col(text)).alias("__t")).crossJoin(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i, c in enumerate(count.values()):
        idf = F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        total = total + idf * c * (k1 + 1) / (c + k1 * (1 - b + b * F.size("__t") / F.col("len")))
    return s.select(key, F.round(total, 6).alias("score")).where("score > 0")


def fuzzy(docs: DataFrame, word: str, distance: Column | None = None, most: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Best score of each document: 1 for the word itself, else 1 - d/3 for a word of the same three first letters at a distance of 1 to 3."""
    w = word.lower()
    term = docs.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("term")).where(F.substring("term", 1, 3) == w[:3])
    d = F.levenshtein(F.col("term"), F.lit(w), most) if distance is None else distance
    hit = term.withColumn("d", d).where(F.col("d").between(0, most))
    return hit.groupBy(key).agg(F.round(F.max(1 - F.col("d") / 3), 6).alias("score"))


def phrase(docs: DataFrame, text_of: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold the phrase in lower case: their term score, plus 10 for each occurrence that doesn't overlap another."""
    p = text_of.lower()
    low = F.lower(text)
    n = ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("long")
    return search(docs.where(low.contains(p)), text_of, key, text).select(key, (F.col("score") + 10 * n).alias("score"))


def near(docs: DataFrame, a: str, b: str, within: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in which two words stand at most ``within`` words apart, with the least distance."""
    w = F.split(F.lower(F.trim(F.regexp_replace(text, "\\s+", " "))), " ")
    at = lambda x: F.filter(F.transform(F.col("__w"), lambda v, i: F.when(v == x, i)), lambda i: i.isNotNull())
    d = docs.select(key, w.alias("__w")).where(F.array_contains("__w", a) & F.array_contains("__w", b)).select(key, at(a).alias("__a"), at(b).alias("__b"))
    gap = F.array_min(F.transform("__a", lambda i: F.array_min(F.transform("__b", lambda j: F.abs(i - j)))))
    return d.select(key, gap.alias("gap")).where(F.col("gap") <= within)


def highlight(text: Column, terms: list[str]) -> Column:
    """Each term, one after another, between two pairs of stars."""
    for t in terms:
        text = F.replace(text, F.lit(t), F.lit(f"**{t}**"))
    return text


def contains(docs: DataFrame, part: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold a substring in any case."""
    return docs.where(F.lower(text).contains(part.lower())).select(key, F.lit(1.0).alias("score"))


def loose(docs: DataFrame, word: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """1 for a substring in any case; else 1 - d/10 for the nearest whitespace word at a distance of at most 2."""
    w = word.lower()
    low = F.lower(text)
    d = F.array_min(F.transform(F.array_distinct(F.split(low, "\\s+")), lambda x: F.levenshtein(x, F.lit(w))))
    return docs.select(key, F.when(low.contains(w), F.lit(1.0)).when(d <= 2, F.round(1 - d / 10, 6)).alias("score")).where("score IS NOT NULL")


def char_grams(c: Column, n: int = 2) -> Column:
    """The set of a text's runs of n characters."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: c.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of the sets of character pairs; 1 where both are empty."""
    x, y = char_grams(a), char_grams(b)
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 1.0).otherwise(2 * F.size(F.array_intersect(x, y)) / total)


def jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of the sets of character n-grams; 0 where both are empty."""
    x, y = char_grams(a, n), char_grams(b, n)
    u = F.size(F.array_union(x, y))
    return F.when(u == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / u)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    m = len(hits)
    other = [y for y, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(hits, other)) / 2
    j = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + 0.1 * p * (1 - j)


def _damerau(a: str, b: str) -> int:
    """Edits with transpositions, any number on a substring."""
    last: dict[str, int] = {}
    inf = len(a) + len(b)
    d = [[inf] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, l = last.get(b[j - 1], 0), db
            same = a[i - 1] == b[j - 1]
            if same:
                db = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + (i - k - 1) + 1 + (j - l - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


@F.pandas_udf(DoubleType())
def jaro_winkler(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Jaro-Winkler similarity with a prefix of up to 4 weighing 0.1."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(IntegerType())
def damerau(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Damerau-Levenshtein distance."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else _damerau(x, y) for x, y in zip(a, b)], dtype="Int32")


def best_of(*hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The union of hits, the best score of each key."""
    out = hits[0].select(key, F.col("score").cast("double"))
    for h in hits[1:]:
        out = out.unionByName(h.select(key, F.col("score").cast("double")))
    return out.groupBy(key).agg(F.max("score").alias("score"))


def fused(lists: list[DataFrame], k: int = 60, key: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over ranked lists, each of a bounded number of rows."""
    out = None
    for h in lists:
        r = h.select(key, (1.0 / (k + F.row_number().over(Window.orderBy(F.desc("score"), key)))).alias("s"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy(key).agg(F.round(F.sum("s"), 8).alias("score"))


def index_stats(docs: DataFrame) -> DataFrame:
    """Distinct terms and (term, document) pairs."""
    return postings(docs).agg(F.countDistinct("term").alias("terms"), F.count("*").alias("references"))


def facets(df: DataFrame, names: list[str]) -> DataFrame:
    """(facet, value, n): counts of each facet's values, in one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names))
    return df.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
