"""Steps whose work must grow no faster than their input: the results against plain loops, and the form of their plans."""

import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from polystrata.operators import graph, jsondocs, logs, rca, text, vectors

T0 = datetime.datetime(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _events(spark, rows):
    return spark.createDataFrame([(i, None if s is None else T0 + datetime.timedelta(seconds=s), k) for i, s, k in rows], "id long, ts timestamp_ntz, key string")


def test_no_frame_without_end(spark):
    """A frame that ends with its partition is worked out anew for every row."""
    r = random.Random(5)
    rows = [(i, r.randrange(0, 400), r.choice("abc")) for i in range(90)]
    got = rca.whole_windows(_events(spark, rows), ["a", "b"], 30)
    want = 0
    for i, s, _ in rows:
        later = {k for j, t, k in rows if (t > s or t == s and j >= i) and t - s <= 30}
        want += {"a", "b"} <= later
    assert got.first()[0] == want
    assert "unboundedfollowing" not in _plan(got).lower()


def test_followers_are_counted_without_pairs(spark):
    """Counts and gaps by windows are those of all pairs, with ties of times, equal and null ids, null keys and times."""
    r = random.Random(6)
    rows = [(r.choice([None, *range(40)]), r.choice([None, *range(0, 300, 3)]), r.choice(["a", "b", "c", None])) for _ in range(150)] + [(900, 9000, "a"), (901, 9030, "b"), (902, 9031, "z")]
    e = _events(spark, rows)
    pairs = [(x, j, p, q, t - s) for x, (i, s, p) in enumerate(rows) for j, t, q in rows if s is not None and t is not None and 0 <= t - s <= 30 and (t > s or None not in (i, j) and j > i)]
    assert rca.followers(e, 30).count() == len(pairs)
    want, first = {}, {}
    for x, _, p, q, gap in pairs:
        want.setdefault((p, q), []).append(gap)
        if p is not None and q is not None and p != q:
            first.setdefault((p, q), {})[x] = min(gap, first.get((p, q), {}).get(x, 99))
    got = rca.co_occurrences(e, 30)
    assert {(x.a, x.b): (x.n, x.mean_gap) for x in got.collect()} == {k: (len(v), pytest.approx(sum(v) / len(v), abs=2e-6)) for k, v in want.items()}
    of = {k: sum(p == k for _, _, p in rows) for k in "abcz"}
    found = rca.patterns(e, 30, 0.0, 0.0, 1)
    assert {(x.a, x.b): (x.n, x.confidence, x.mean_gap) for x in found.collect()} == {
        k: (len(v), pytest.approx(len(v) / of[k[0]], abs=2e-6), pytest.approx(sum(v.values()) / len(v), abs=2e-6)) for k, v in first.items()
    }
    for df in (got, found):  # a bucket's events meet in a task; they aren't joined with one another
        assert "FlatMapGroupsInArrow" in _plan(df) and "bucket" not in "".join(x for x in _plan(df).splitlines() if "Join" in x)
    assert rca.co_occurrences(e.where("false"), 30).count() == rca.patterns(e.where("false"), 30, 0.0, 0.0).count() == 0


def test_embeddings_by_batches(spark):
    """Embeddings are made in Arrow's own buffers, not as lists of Python numbers, of which a batch holds millions; a binary one has no expression of 384 parts."""
    r = random.Random(7)
    texts = ["", None, "a", "Ab ab é", "x" * 384, "y" * 999, "z" * 1000] + ["".join(r.choice("abcé ") for _ in range(r.choice([30, 700, 2500]))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    got = df.select("t", vectors.byte_embedding(F.col("t")).alias("b"), vectors.word_embedding(F.col("t")).alias("w"), vectors.binary_embedding(F.encode("t", "UTF-8")).alias("x"))
    assert vectors.byte_embedding.evalType == vectors.word_embedding.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    assert "ArrowEvalPython" in _plan(got.select("x"))
    for t, b, w, x in got.collect():
        v = np.zeros(128)
        for word, c in Counter((t or "").lower().split()).items():
            h = 0
            for y in word.encode():
                h = (h * 31 + y) % 2**32
            v[h % 128] += 1 + np.log10(c)
        assert w == pytest.approx((v / (np.linalg.norm(v) or 1)).tolist())
        if t is None:
            assert b is None and x is None
            continue
        d, v = t.encode(), np.zeros(384)
        for i, y in enumerate(d):
            v[i % 384] += y / 255
        assert b == pytest.approx((v / (np.linalg.norm(v) or 1)).tolist())
        assert x == pytest.approx([i / 384 if len(d) < 1000 else d[i * (len(d) // 384)] / 255 for i in range(384)])


def test_scores_of_odd_vectors(spark):
    """Scores by blocks are those of the expression, and are worked out once."""
    rows = [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0], None, [], [1.0, None, 3.0], [1.0], [1.0, 2.0, 3.0, 4.0], [float("nan"), 1.0, 1.0], [-1.0, 0.5, 0.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id int, embedding array<double>").repartition(1)
    for q in ([1.0, 2.0, 3.0], [0.5, -1.0], [0.0, 0.0], []):
        n, v = float(np.linalg.norm(q)), F.col("embedding")
        own = vectors.norm(v) * n
        want = df.select("vec_id", F.when(own > 0, vectors.dot(v, vectors.literal(q or [0.0])) / own).otherwise(0.0)).collect()
        got = dict(vectors.scored(df, q).select("vec_id", "score").collect())
        assert got == {i: pytest.approx(s, nan_ok=True) for i, s in want}
    p = _plan(vectors.knn(df, [1.0, 2.0, 3.0], 3))
    assert p.count("ArrowEvalPython") == 1 and "lambda" not in p


def test_one_field_of_documents_in_one_file(spark):
    """Only the field that is asked for comes back from JSON, documents of one file are spread over tasks, and no expression goes over the numbers of a print."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(['{"a": "x", "b": 1}', '{"a": "x"}', '{"b": 1}', "{no", None, "[1]", '{"a": "zz"}'])], "id int, content string").repartition(1)
    got = jsondocs.similar_field(docs, '{"a": "x"}', "a", 0.9999999, 5, "id", "content")
    assert [tuple(r) for r in got.collect()] == [(0, 1.0), (1, 1.0)]
    assert "Exchange hashpartitioning(id" in _plan(got) and "lambda" not in _plan(got)
    assert sorted(r.id for r in jsondocs.similar_field(docs, '{"b": 2}', "a", 0.0, 5, "id", "content").collect()) == [0, 1, 6]
    assert jsondocs.similar(docs, '{"a": "x"}', 0.9999999, 5, "id", "content").collect() == [(1, 1.0)]


def test_edges_are_made_once(spark):
    """However many rounds a meeting takes, its edges are worked out once."""
    made = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            made.add(len(p))
            yield p

    e = spark.createDataFrame([(i, i + 1, 1) for i in range(6)], "src int, dst int, weight int").mapInPandas(counted, "src int, dst int, weight int")
    assert [tuple(r) for r in graph.meet(e, 0, 6).collect()] == [(6, 6.0)]
    assert made.value == 6


def test_shards_are_sent_as_texts(spark):
    """A row is shuffled with its text, not with an embedding of 3 kB; repeated texts find what they would one by one, also once a ring of primaries is full."""
    r = random.Random(8)
    texts = [r.choice(["", None, *("".join(r.choice("ab") for _ in range(r.choice([1, 2, 5]))) for _ in range(3))]) for _ in range(400)]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id long, shard string, text string")
    for kept in (3, 100):
        got = logs.near_duplicates(df, ["shard"], ["id"], least=0.97, kept=kept)
        ring, want = [], {}
        for i, t in enumerate(texts):
            v = np.zeros(384)
            for k, y in enumerate((t or "").encode()):
                v[k] += y / 255
            v /= np.linalg.norm(v) or 1
            s = [(float(u @ v), -at, j) for at, (j, u) in enumerate(ring)]
            top = max(s)[0] if s else 0
            if v.any() and top > 0.97:
                want[i] = next(j for a, _, j in s if a >= top - 1e-12)
            else:
                want[i] = None
                ring = [*ring, (i, v)][-kept:]
        assert {x.id: x.primary_id for x in got.collect()} == want
    assert "ArrowEvalPython" not in _plan(got)


def test_texts_are_cut_once(spark):
    """The filter on a score doesn't cut the text into words again."""
    docs = spark.createDataFrame([(1, "heron heron walks"), (2, "none"), (3, None), (4, "")], "doc_id long, text string")
    got = text.log_tf(docs, "heron thin")
    assert [tuple(r) for r in got.collect()] == [(1, pytest.approx((1 + np.log10(2)) / (1 + 2 / 3) / 2, abs=1e-6))]
    assert _plan(got).count("regexp_extract_all") == 1


def test_index_is_saved_in_one_pass(spark, tmp_path):
    """Each text is read once and a batch's documents of a term are one row, with the postings and scores of plain loops; and an index of no document can be searched."""
    r = random.Random(15)
    vocabulary = ["walk", "walked", "walking", "the", "x", "größe", "日本", "rust", "code", "codes", "w" * 51, "İstanbul", "a1", "sing"]
    rows = [(k, r.choice([None, "", " ".join(r.choice(vocabulary) for _ in range(r.randrange(30)))])) for k in range(60)]
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want, words = {}, {}
    for x in docs.select("doc_id", text.tokens(F.col("text")).alias("t")).collect():
        words[x.doc_id] = len(x.t or [])
        want |= {(x.doc_id, t): n for t, n in Counter(x.t or []).items()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 1000):
            at = str(tmp_path / f"index{size}")
            seen.value = 0
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            text.save_index(docs.withColumn("text", F.udf(look, "string").asNondeterministic()("text")), at)
            assert seen.value == len(rows)
            got = text.load_index(spark, at).collect()
            assert len(got) == len(want) and {(x.key, x.term): (x.tf, x.words) for x in got} == {k: (n, words[k[0]]) for k, n in want.items()}
            for x in text.load_index(spark, at, ["walk", "日本", "absent"]).select("term").distinct().collect():
                assert x.term in ("walk", "日本")
            s = spark.read.parquet(f"{at}/summary").first()
            assert (s.documents, s.words) == (len(rows), sum(words.values()))
            for q in ("walking walks rust", "日本 code", "the", "absent"):
                scores = Counter()
                for t in set(text.query_tokens(q)):
                    df = sum(u == t for _, u in want)
                    for k, tf in ((k, n) for (k, u), n in want.items() if u == t):
                        scores[k] += math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * words[k] * len(rows) / sum(words.values())))
                assert {x.key: x.bm25 for x in text.search_index(spark, at, q).collect()} == {k: pytest.approx(v, abs=2e-6) for k, v in scores.items()}
        assert spark.read.parquet(f"{at}/postings").where("part >= 0").count() == len({t for _, t in want})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    none = str(tmp_path / "none")
    text.save_index(docs.where("doc_id < 0"), none)
    assert text.load_index(spark, none).count() == text.search_index(spark, none, "rust").count() == 0
    assert tuple(spark.read.parquet(f"{none}/summary").first())[:2] == (0, 0)
