"""Core operators without SQL against plain loops, and odd rows: nulls, empty texts, ties, repeats, empty tables."""

import datetime
import http.server
import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from polystrata.functions import anomalies, packing, stemming
from polystrata.operators import blobs, chunks, graph, jsondocs, logs, rca, routing, telemetry, text, vectors, vfs
from polystrata.sources import files

T0 = datetime.datetime(2024, 1, 1)


def _series(spark, rows):
    return spark.createDataFrame([(i, T0 + datetime.timedelta(seconds=s), k, v) for i, (s, k, v) in enumerate(rows)], "id long, ts timestamp_ntz, key string, value double")


# ---------------------------------------------------------------------- telemetry


def test_percentiles_of_odd_groups(spark):
    r = random.Random(1)
    rows = [(k, r.choice("abc"), r.choice([1.0, 2.5, 2.5, r.random() * 1e6, -3.0])) for k in range(500)] + [(600, "one", 7.0), (601, "none", None), (602, None, 1.0), (603, None, 2.0)] + [(700 + i, "same", 4.0) for i in range(9)]
    got = {x.key: (x.p50, x.p95, x.p99) for x in telemetry.percentiles(_series(spark, rows), cells=7).collect()}
    by = {}
    for _, k, v in rows:
        by.setdefault(k, []).append(v)
    for k, vs in by.items():
        vs = [v for v in vs if v is not None]
        want = tuple(round(float(np.percentile(vs, p)), 6) for p in (50, 95, 99)) if vs else (None,) * 3
        assert got[k] == pytest.approx(want) if vs else got[k] == want
    assert telemetry.percentiles(_series(spark, []).where("false")).count() == 0


def test_smoothing_crosses_slices(spark):
    r = random.Random(2)
    rows = [(r.randrange(0, 40_000), r.choice(["a", "b", None]), r.choice([None, 1.0, 5.0, r.random()])) for _ in range(300)]
    for n in (1, 3, 5):
        got = {x.id: x.smooth for x in telemetry.smoothed(_series(spark, rows), n, seconds=600).collect()}
        assert len(got) == len(rows)
        for key in ("a", "b", None):
            own = sorted((s, i) for i, (s, k, _) in enumerate(rows) if k == key)
            for p, (_, i) in enumerate(own):
                vs = [rows[j][2] for _, j in own[max(0, p - n + 1) : p + 1] if rows[j][2] is not None]
                assert got[i] == (pytest.approx(sum(vs) / len(vs), abs=2e-6) if vs else None)


def test_scale_of_odd_series(spark):
    got = {x.id: x.scaled for x in telemetry.normalised(_series(spark, [(0, "a", 1.0), (1, "a", 3.0), (2, "a", None), (3, "b", 4.0), (4, None, 0.0), (5, None, 10.0)])).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: None, 3: 4.0, 4: 0.0, 5: 1.0}


def test_windows_that_hold_a_pattern(spark):
    r = random.Random(3)
    rows = [(r.randrange(0, 3000), r.choice("abcd"), 1.0) for _ in range(120)]
    for keys in (["a", "b"], ["a", "b", "c"], ["a"], ["a", "zz"]):
        want = 0
        for i, (s, _, _) in enumerate(rows):
            later = {k for j, (t, k, _) in enumerate(rows) if (t > s or t == s and j >= i) and t - s <= 60}
            want += set(keys) <= later
        assert rca.whole_windows(_series(spark, rows), keys, 60).first()[0] == want


def test_chains_are_greedy(spark):
    links = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.7), ("x", "y", 0.85), ("b", "d", 0.1)], "cause string, effect string, confidence double")
    assert rca.chains(links) == [["a", "b", "c"], ["x", "y"], ["c", "a"], ["b", "d"]]
    assert rca.chains(links, 0.8) == [["a", "b", "c"], ["x", "y"]] and rca.chains(links.where("false")) == []


# ---------------------------------------------------------------------------- logs


def _greedy(rows, least, kept):
    """rows: (shard, order, id, vector) in order."""
    out, held = {}, {}
    for g, _, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        own = held.setdefault(g, [])
        best = max(((float(np.dot(w, v)), -k, j) for k, (j, w) in enumerate(own)), default=None) if v is not None and np.any(v) else None
        if best and best[0] > least:
            top = best[0]
            out[i] = next(j for j, w in own if float(np.dot(w, v)) >= top - 1e-12)
        else:
            out[i] = None
            own.append((i, np.zeros(384) if v is None else v))
            if len(own) > kept:
                own.pop(0)
    return out


@pytest.mark.parametrize("kept", [3, 10_000])
def test_near_duplicate_logs_as_a_plain_loop(spark, kept):
    r = random.Random(4)
    words = ["disk full", "disk is full", "login ok", "login failed for root", "timeout", "", None, "x"]
    rows = [(k, r.choice(["h1", "h2", None]), r.randrange(30), r.choice(words)) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, shard string, at long, text string").repartition(3)
    got = {x.id: x.primary_id for x in logs.near_duplicates(df, ["shard"], ["at"], kept=kept).collect()}
    v = {x.text: None if x.e is None else np.array(x.e) for x in df.select("text").distinct().select("text", vectors.byte_embedding(F.col("text")).alias("e")).collect()}
    assert got == _greedy([(s or "", a, i, v[t]) for i, s, a, t in rows], logs.DUPLICATE, kept)
    assert logs.near_duplicates(df.where("false"), ["shard"], ["at"]).count() == 0


def test_bloom_filter_has_no_false_negative(spark):
    have = spark.range(3000).selectExpr("concat('k', id) AS v").unionByName(spark.createDataFrame([(None,)], "v string"))
    bits = logs.bloom(have, "v", 3000, 0.01)
    assert logs.maybe_in(have.where("v IS NOT NULL"), "v", bits, 3000, 0.01).where("NOT maybe").isEmpty()
    other = spark.range(5000).selectExpr("concat('other', id) AS v").unionByName(spark.createDataFrame([(None,)], "v string"))
    assert logs.maybe_in(other, "v", bits, 3000, 0.01).where("maybe").count() < 150
    assert logs.maybe_in(other, "v", bits, 3000, 0.01).where("v IS NULL AND maybe").isEmpty()


def test_pairs_of_odd_metadata(spark):
    got = spark.createDataFrame([("a=1,b=2,a=3",), ("",), (None,), ("x",), ("k=v=w, z = 1 ",)], "m string").select(logs.pairs(F.col("m")).alias("p")).collect()
    assert [r.p for r in got] == [{"b": "2", "a": "3"}, {}, None, {}, {"k": "v=w", "z": "1"}]


# --------------------------------------------------------------------------- texts


def test_mean_similarity(spark):
    rows = [("martha", "marhta"), ("dixon", "dicksonx"), ("", ""), ("a", ""), (None, "a"), ("same", "same"), ("blue gizmo", "medium")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.jaro_winkler(F.col("a"), F.col("b")).alias("j"), text.dice(F.col("a"), F.col("b")).alias("d"), text.mean_similarity(F.col("a"), F.col("b")).alias("m")).collect()
    j = {(r.a, r.b): r.j for r in got}
    assert j["martha", "marhta"] == pytest.approx(0.961111, abs=1e-6) and j["dixon", "dicksonx"] == pytest.approx(0.813333, abs=1e-6) and j["blue gizmo", "medium"] == pytest.approx(0.563889, abs=1e-6)
    assert all(r.m == pytest.approx((r.j + r.d) / 2) for r in got if r.m is not None) and j[None, "a"] is None


def _edits(a, b):
    d = {(-1, -1): 0}
    for i in range(len(a)):
        d[i, -1] = i + 1
    for j in range(len(b)):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_vocabulary_search_leaves_nothing_out(spark):
    r = random.Random(5)
    words = {"".join(r.choice("abcde") for _ in range(r.randrange(1, 7))) for _ in range(300)}
    docs = spark.createDataFrame([(k, w) for k, w in enumerate(sorted(words))] + [(999, None), (1000, "")], "doc_id long, text string")
    for budget in (0, 1, 2):
        got = {x.term: x.distance for x in text.vocabulary(docs, "abcda", budget).collect()}
        assert got == {w: e for w in words if (e := _edits(w, "abcda")) <= budget}


def test_saved_index_of_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "rust rust code"), (2, None), (3, ""), (4, "rust"), (5, "the")], "doc_id long, text string")
    text.save_index(docs, str(tmp_path / "index"), 4)
    got = {x.key: x.score for x in text.search_index(spark, str(tmp_path / "index"), "rust rust").collect()}
    assert got == {1: 4, 4: 2}
    assert text.search_index(spark, str(tmp_path / "index"), "the absent").count() == 0
    assert text.load_index(spark, str(tmp_path / "index")).count() == 3


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"), ("hopping", "hop"), ("hoped", "hope"), ("luxuriating", "luxuri"), ("happy", "happi"), ("say", "say"), ("by", "by"), ("generically", "generic"), ("consolidation", "consolid"), ("knightly", "knight"), ("national", "nation"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("sensibility", "sensibl"), ("replacement", "replac"), ("adjustment", "adjust"), ("dying", "die"), ("skies", "sky"), ("succeeding", "succeed"), ("agreed", "agre"), ("communism", "communism"), ("running", "run"), ("analogous", "analog"), ("hopefulness", "hope"), ("controlling", "control"), ("rolling", "roll"), ("it", "it"), ("Walking", "walk")])
def test_english_stems(word, want):
    assert stemming.stem(word) == want


# -------------------------------------------------------------------------- chunks


def test_rebuilt_chunks(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(k, "".join(r.choice("abc é\n") for _ in range(n))) for k, n in enumerate((1, 50, 99, 512, 513, 600, 3000))] + [(50, None), (51, "")], "doc_id long, text string")
    got = {x.doc_id: x.text for x in chunks.rebuilt(chunks.fixed(docs, least=0)).collect()}
    assert got == {x.doc_id: x.text for x in docs.collect() if x.text}


def test_context_and_hybrid_of_no_document(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    kept = chunks.stored(chunks.fixed(none), 4)
    assert kept.count() == 0 and chunks.hybrid(kept, "a query", 5).count() == 0 and chunks.near(kept, "a query", 5).count() == 0


# -------------------------------------------------------------------- stores, graph


def test_routed_store_of_odd_keys(spark):
    empty = spark.createDataFrame([], "key string, shard int, data long, seq long")
    shard = routing.by_hash(F.col("key"), 4)
    new = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 3)], "key string, data long, seq long")
    s = routing.put(empty, new, shard)
    assert {(x.key, x.data) for x in s.collect()} == {("a", 2), ("b", 3)}
    ask = spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "key string")
    assert [x.key for x in routing.lookup(s, ask, shard).collect()] == ["a"]
    assert {(x.key, x.there) for x in routing.exists(s, ask).collect()} == {("a", True), ("zz", False), (None, False)}
    assert {x.key for x in routing.delete(s, ask, shard).collect()} == {"b"}
    assert blobs.removal(s, ask).where("existed").count() == 1


def test_meeting_from_both_ends(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 9.0), ("c", "d", 1.0), ("d", "a", 1.0), ("x", "x", 1.0)], "src string, dst string, weight double")
    assert [tuple(r) for r in graph.meet(e, "a", "d").collect()] == [(2, 10.0)]
    assert [tuple(r) for r in graph.meet(e, "a", "a").collect()] == [(0, 0.0)]
    assert graph.meet(e, "a", "x").count() == 0


def test_nearest_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {(x.query_id, x.vec_id): x.score for x in vectors.knn_join(v, v, 1, block=2).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (3, 1): 0.0}
    assert vectors.knn_join(v.where("false"), v, 3).count() == 0


def test_field_prints_of_odd_json(spark):
    rows = [(1, '{"a": 1, "b": [1, "X "]}'), (2, "[1]"), (3, "{no"), (4, None), (5, "{}")]
    got = {x.id: x.m for x in spark.createDataFrame(rows, "id long, c string").select("id", jsondocs.field_prints(F.col("c")).alias("m")).collect()}
    assert got == {1: {"a": "1", "b": "[1, x]"}, 2: {}, 3: None, 4: None, 5: {}}


def test_nodes_that_can_be_made(spark):
    n = spark.createDataFrame([("/", "folder"), ("/a", "folder"), ("/a/f", "text")], "path string, kind string")
    new = spark.createDataFrame([("a/b/",), ("/a",), ("/a/f/x",), ("/q/r",), ("/",)], "path string")
    assert {(x.path, x.error) for x in vfs.created(n, new).collect()} == {("/a/b", None), ("/a", "exists"), ("/a/f/x", "parent is no folder"), ("/q/r", "no parent"), ("/", "exists")}
    assert {x.path for x in vfs.walked(n, "/a/f").collect()} == {"/", "/a", "/a/f"} and vfs.walked(n, "/a/zz").count() == 0


# ------------------------------------------------------------------ files, packing


@pytest.mark.parametrize("v", [None, True, False, 0, 127, 128, 255, 256, 65535, 65536, 2**32, -1, -32, -33, -128, -129, -40000, -(2**40), 1.5, -0.25, "", "é" * 40, "x" * 70000, [], list(range(20)), {}, {"a": {"b": [1, None, "c"]}}, {str(i): i for i in range(40)}], ids=repr)
def test_packed_values_come_back(v):
    assert packing.from_msgpack(packing.to_msgpack(v)) == v and packing.from_cbor(packing.to_cbor(v)) == v


def test_packed_bytes_are_the_published_ones():
    assert packing.to_msgpack({"compact": True, "schema": 0}) == bytes.fromhex("82a7636f6d70616374c3a6736368656d6100")
    assert packing.to_cbor({"a": 1, "b": [2, 3]}) == bytes.fromhex("a26161016162820203")
    for b in (b"", b"\xda\x00", b"\xc1"):
        with pytest.raises((IndexError, KeyError, packing.struct.error)):
            packing.from_msgpack(b)


class _Server(http.server.BaseHTTPRequestHandler):
    seen: dict = {}

    def do_GET(self):  # noqa: N802
        n = self.seen[self.path] = self.seen.get(self.path, 0) + 1
        code = 404 if self.path == "/none" else 503 if self.path == "/late" and n < 3 or self.path == "/never" else 200
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps({"path": self.path}).encode())

    def log_message(self, *_):
        pass


def test_fetching_tries_again(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        urls = spark.createDataFrame([(f"{at}/{p}",) for p in ("ok", "late", "none", "never")] + [(None,)], "url string").coalesce(1)
        got = {r.url: (r.text, r.tries, r.error) for r in files.fetched(urls, tries=3, first_wait=0.01).collect()}
    finally:
        server.shutdown()
    assert got == {f"{at}/ok": ('{"path": "/ok"}', 1, None), f"{at}/late": ('{"path": "/late"}', 3, None), f"{at}/none": (None, 1, "status 404"), f"{at}/never": (None, 3, "status 503"), None: (None, 0, "no url")}


# ---------------------------------------------------------------------- anomalies


def test_seasonal_outliers():
    r = np.random.default_rng(1)
    x = np.tile([0.0, 5, 10, 5], 60) + r.normal(0, 0.3, 240)
    clean = anomalies.seasonal_outliers(x, 4, alpha=0.001)
    x[[33, 120]] += 8
    assert anomalies.seasonal_outliers(x, 4, alpha=0.001) == sorted({33, 120, *clean}) and len(clean) < 3
    assert anomalies.seasonal_outliers([], 4) == [] and anomalies.seasonal_outliers([1.0] * 30, 4) == []


@pytest.mark.parametrize(("p", "df", "want"), [(0.975, 10, 2.228139), (0.995, 5, 4.032143), (0.9999, 30, 4.233986), (0.975, 1000, 1.962339)])
def test_student_quantiles(p, df, want):
    assert anomalies.student_quantile(p, df) == pytest.approx(want, abs=2e-4)


def test_breakouts_and_clusters():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, 60), r.normal(6, 1, 60), r.normal(1, 1, 60)])
    got = anomalies.breakouts(x)
    assert len(got) == 2 and abs(got[0] - 60) <= 2 and abs(got[1] - 120) <= 2
    assert anomalies.breakouts(r.normal(0, 1, 100)) == [] and anomalies.breakouts([]) == [] and anomalies.breakouts([2.0] * 80) == []
    a = [np.array([0, 1, 2, 3.0]), np.array([0, 0, 1, 2, 3.0]), np.array([9, 9, 9.0]), np.array([9, 9.0]), np.array([50.0])]
    assert anomalies.clusters(a, 0.5) == [0, 0, 1, 1, -1]
    assert anomalies.outlying([[1, 1, 1, 9], [1, 1, 1, 1], [1, 1, 1, 1.0]]) == [[(3, 4)], [], []]
    assert anomalies.outlying([[1, 1, 1, 9], [1, 1, 1, 1], [1, 1, 1, 1.0]], "dbscan", 0.5) == [[(3, 4)], [], []]


def test_dense_series_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(anomalies, "SLICE", 50)
    rows = [(k, "a", 0.0 if k < 500 else 9.0) for k in range(1000)]
    got = anomalies.per_series(_series(spark, rows), "breakouts", hours=0.2777777778, least=5).collect()
    assert [(r.key, r.slice) for r in got] and all(abs(r.position - 25) <= 1 for r in got)
