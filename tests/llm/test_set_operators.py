"""Near copies, search, mixing, sharding, embeddings and wrappers against brute force."""

import math
import random
from collections import Counter

import compare
import numpy as np
import pytest

from polystrata.llm import mixing, ngram_join, nn_descent, queries, sharding, topk_search, wrappers
from polystrata.llm.common import connected_components, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, name):
    assert compare.compare(spark, compare.views(SF), SF, queries.QUERIES[name], queries.ORACLE[name]) is None


def _classes_of(pairs):
    """{node: (class, links)} of pairs of nodes."""
    parent, n = {}, Counter()

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        n[a] += 1
        n[b] += 1
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: (find(x), n[x]) for x in n}


def _near(df):
    return {x.doc_id: (x.class_id, x.links) for x in df.collect()}


@pytest.mark.parametrize(("threshold", "block_rows", "cold"), [(0.3, 2, 2), (0.5, 512, 2), (0.5, 2, 24), (0.8, 512, 24)])
def test_pairs_as_brute_force(spark, threshold, block_rows, cold):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for _ in range(60)]
    for k in range(60):
        t = texts[k].split()
        for _ in range(r.randrange(0, 4)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    for k in range(20):
        t = texts[0].split() + [f"v{i}" for i in range(30)]
        t[r.randrange(len(t))] = "other"
        texts += [" ".join(t)] * (1 + k % 3)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = _near(ngram_join.near_copies(docs, 3, threshold, batch_grams=200, block_rows=block_rows, cold=cold))
    assert got == _classes_of(ngram_join.brute_pairs(rows, 3, threshold))


def test_pairs_of_odd_rows(spark, odd, none, odd_rows):
    got = _near(ngram_join.near_copies(odd))
    assert got == _classes_of(ngram_join.brute_pairs([r[:2] for r in dict.fromkeys(odd_rows)]))
    assert {1, 2, 3, 7, 8, 9, 10} <= set(got)
    assert ngram_join.near_copies(none).count() == 0
    left = ngram_join.drop_near_copies(odd)
    assert left.columns == odd.columns
    assert not {r.doc_id for r in left.collect()} & {2, 3, 8, 10}
    assert left.count() == len(odd_rows) - 4
    assert ngram_join.drop_near_copies(none).count() == 0


def test_pairs_at_the_threshold(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f x y z"), (3, "a b c d e f g")]  # 4 of 9, 5 of 6
    assert _near(ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 5 / 6)) == {1: (1, 1), 3: (1, 1)}


def test_a_repeated_row_of_a_hot_text_is_one_document(spark):
    rows = [(1, "one two three four five")] * 500 + [(2, "one two three four five six")] * 500 + [(3, "one two three four five")] * 500
    assert _near(ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == {1: (1, 2), 2: (1, 2), 3: (1, 2)}


def test_each_text_of_a_doc_id_is_a_document(spark):
    rows = [(1, "one two three four five"), (1, "six seven eight nine ten"), (2, "one two three four five"), (3, "six seven eight nine ten eleven"), (4, "quite another text than these")]
    got = _near(ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert got == {1: (1, 2), 2: (1, 1), 3: (1, 1)}


def test_a_chain_costs_no_more_than_its_links(spark):
    """Each document shares two thirds of its words with the next one and nothing with others."""
    n = 20_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(cast(id * 10 AS int), cast(id * 10 + 31 AS int)), x -> concat('w', x))) AS text")
    got = ngram_join.near_copies(docs)
    assert got.count() == n and got.where("class_id <> 0 OR links <> IF(doc_id IN (0, 19999), 1, 2)").isEmpty()


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == want


def _bm25(docs, queries_, k):
    words = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
    d = [(i, Counter(words(t))) for i, t in docs]
    mean = sum(sum(c.values()) for _, c in d) / max(1, len(d)) or 1.0
    out = {}
    for q, t in queries_:
        if q is None or t is None:
            continue
        terms = Counter(words(t))
        rows = []
        for i, c in d:
            s, hit = 0.0, False
            for w, n in terms.items():
                if c[w]:
                    df = sum(1 for _, o in d if o[w])
                    s += n * math.log(1 + (len(d) - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
                    hit = True
            if hit:
                rows.append((-round(s, 6), i is not None, i or 0))
        out[q] = [(i if known else None, round(-s, 5)) for s, known, i in sorted(rows)[:k]]
    return {q: v for q, v in out.items() if v}


def test_top_k_as_brute_force(spark, odd, none, odd_rows):
    asked = [(1, odd_rows[0][1]), (2, "river stone nothing"), (3, None), (4, ""), (None, "river"), (5, "one two one"), (6, "absent")]
    qs = spark.createDataFrame(asked, "item_id long, text string")
    for k in (1, 3, 10):
        got = {}
        for x in sorted(topk_search.search(odd, qs, k).collect(), key=lambda x: (x["query"], x["rank"])):
            got.setdefault(x["query"], []).append((x.doc_id, round(x.score, 5)))
        want = _bm25([r[:2] for r in odd_rows], asked, k)
        assert {q: [s for _, s in v] for q, v in got.items()} == {q: [pytest.approx(s, abs=2e-5) for _, s in v] for q, v in want.items()}
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert topk_search.search(none, qs).count() == 0
    assert topk_search.search(odd, qs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [None, 0])
def test_near_ties_of_rounded_scores(spark, monkeypatch, limit):
    """Documents 0 and 5 are 4e-7 apart and equal once rounded, so the lower doc_id is first."""
    if limit is not None:
        monkeypatch.setattr(topk_search, "BROADCAST_LIMIT", limit)
    size = {0: 501, 5: 500}
    rows = [(i, "word" + " other" * (size.get(i, 600) - 1)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    qs = spark.createDataFrame([(1, "word")], "item_id long, text string")
    got = topk_search.search(docs, qs, 1).collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [(0, 1)]
    want = _bm25(rows, [(1, "word")], 3)[1]
    assert [r.doc_id for r in sorted(topk_search.search(docs, qs, 3).collect(), key=lambda r: r["rank"])] == [i for i, _ in want]


def test_mixture_of_odd_rows(spark, odd, none, labels, odd_rows):
    rows = mixing.mix(odd, labels).collect()
    assert len(rows) == len(odd_rows)
    assert len({r.copies for r in rows if r.doc_id == 4}) == 1
    again = mixing.mix(odd.repartition(5), labels).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    out = mixing.mixed(odd, labels)
    assert out.columns == odd.columns and {r.copies for r in out.collect()} <= {99}
    assert out.count() == sum(r.copies for r in rows)
    assert mixing.mix(none, labels).count() == 0


def test_mixture_meets_targets(spark, documents):
    labels = table(spark, SF, "labels")
    targets = {"src0": 3.0, "src1": 1.0}
    rows = mixing.mix(documents, labels, targets, budget=1.5).collect()
    total = sum(r.tokens for r in rows)
    for s, w in targets.items():
        own = [r for r in rows if r.source == s]
        want, whole = int(total * 1.5 * w / 4), sum(r.tokens for r in own)
        got = sum(r.tokens * r.copies for r in own)
        assert got <= want and {r.copies for r in own} <= {want // whole, want // whole + 1}
        assert want - got <= max(r.tokens for r in own)
    assert all(r.copies == 0 for r in rows if r.source not in targets)


@pytest.mark.parametrize("capacity", [7, 50, 1000])
def test_packing_as_one_by_one(capacity):
    r = random.Random(capacity)
    sizes = sorted((r.choice([1, 2, 3, 5, 8, 13, 60, 0]) * r.randrange(1, 4) for _ in range(400)), reverse=True)
    runs, n = sharding.pack(dict(Counter(sizes)), capacity)
    got = Counter()
    for x in runs:
        for i in range(x.count):
            got[x.bin + i // x.each, x.size] += 1
    want = Counter(zip(sharding.brute_pack(sizes, capacity), sizes))
    assert n == len({b for b, _ in want})
    load = lambda c: sorted(sum(s * m for (b, s), m in c.items() if b == k) for k in {b for b, _ in c})
    assert load(got) == load(want)


def test_shards_of_odd_rows(spark, odd, none, odd_rows):
    from pyspark.sql import functions as F

    rows = sharding.shard(odd, ["text"], F.col("n_chars"), 100_000).collect()
    assert len(rows) == len(odd_rows)
    of = {}
    for r in rows:
        assert of.setdefault(r.text, r.shard) == r.shard
    load = Counter()
    for r in rows:
        load[r.shard] += r.n_chars or 0
    assert all(v <= 100_000 or len({r.text for r in rows if r.shard == s and r.n_chars}) == 1 for s, v in load.items())
    assert sharding.shard(none, ["text"], F.col("n_chars")).count() == 0


@pytest.mark.parametrize(("capacity", "span"), [(40, 1), (40, 7), (300, 1 << 16)])
def test_shards_as_packed_one_by_one(spark, monkeypatch, capacity, span):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "_SPAN", span)
    monkeypatch.setattr(sharding, "_LANES", 3)
    r = random.Random(capacity + span)
    size = [min(400, int(r.lognormvariate(2, 1))) if k % 3 else 5 for k in range(700)]
    rows = [(k, k % 2, s // 2 if part else s - s // 2, -1, "s", "r") for k, s in enumerate(size) for part in (0, 1)]
    df = spark.createDataFrame(rows, "g long, half int, s long, shard_ int, `a.b` string, `__row` string").repartition(5)
    got = sharding.shard(df, ["g"], F.col("s"), capacity).collect()
    assert len(got) == len(rows) and {(x.g, x["s"], x["a.b"], x["__row"], x.group_size) for x in got} == {(k, s, "s", "r", size[k]) for k, _, s, *_ in rows}
    of = {x.g: x.shard for x in got}
    assert all(of[x.g] == x.shard for x in got)
    mine, want = {}, {}
    for g, s in of.items():
        mine.setdefault(s, []).append(size[g])
    order = sorted(size, reverse=True)
    for b, s in zip(sharding.brute_pack(order, capacity), order):
        want.setdefault(b, []).append(s)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_columns_of_any_name(spark, labels):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, f"one two three four five {k // 2}", "s", 7, 8, 9, 10) for k in range(6)], "doc_id long, text string, source string, __g int, __s int, __drop int, `x.y` int")
    for out in (sharding.shard(df, ["text"], F.col("doc_id")).drop("shard", "group_size"), ngram_join.drop_near_copies(df), mixing.mixed(df, labels, budget=1.0)):
        assert out.columns == df.columns
        assert {(r["__g"], r["__s"], r["__drop"], r["x.y"]) for r in out.collect()} == {(7, 8, 9, 10)}


def test_joins_in_place_of_broadcasts(spark, monkeypatch, odd, labels):
    asked = spark.createDataFrame([(1, "river stone winter"), (2, "one two")], "item_id long, text string")
    pages = table(spark, SF, "pages")
    of = {
        "search": lambda: topk_search.search(odd, asked),
        "mixed": lambda: mixing.mixed(odd, labels),
        "near": lambda: ngram_join.drop_near_copies(odd),
        "pairs": lambda: ngram_join.near_copies(odd),
        "pages": lambda: wrappers.extract(pages),
    }
    few = {k: sorted(map(repr, f().collect())) for k, f in of.items()}
    for m in (topk_search, mixing, ngram_join, wrappers):
        monkeypatch.setattr(m, "BROADCAST_LIMIT", 0)
    assert {k: sorted(map(repr, f().collect())) for k, f in of.items()} == few


def _linked(x, threshold):
    """{index: (class, links)} by brute force."""
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    out = {}
    for i in range(len(x)):
        if i not in out:
            seen, todo = {i}, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            out.update({int(j): (i, int(near[j].sum())) for j in seen})
    return {i: x for i, x in out.items() if x[1]}


def _vectors(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, links int").repartition(parts)


def _found(df):
    return {r.vec_id: (r.class_id, r.links) for r in df.collect()}


def _recall(got, want):
    assert all(n <= want[i][1] for i, (_, n) in got.items())
    return sum(n for _, n in got.values()) / max(1, sum(n for _, n in want.values()))


def test_neighbours_as_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((300, 32))
    tight = np.repeat(base[:1], 60, 0) + 0.02 * r.standard_normal((60, 32))
    loose = np.repeat(base[1:2], 80, 0) + 0.22 * r.standard_normal((80, 32))  # near one another in part
    x = np.concatenate([base, base[:100] + 0.1 * r.standard_normal((100, 32)), tight, loose, np.repeat(base[2:3], 30, 0)])
    want = _linked(x, 0.9)
    got = _found(nn_descent.neighbours(_vectors(spark, x)))
    assert len(want) > 250
    assert _recall(got, want) >= 0.97
    assert np.mean([got.get(i, (None, 0))[1] / want[i][1] for i in want]) > 0.97
    assert np.mean([got.get(i, (None, 0))[0] == want[i][0] for i in want]) > 0.97


def test_balls_hold_near_vectors(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 16))
    x = np.concatenate([base + s * r.standard_normal((40, 16)) for s in (0.01, 0.05, 0.1, 0.2)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vec = nn_descent.unit_vectors(_vectors(spark, x))
    radius = np.arccos(0.9) / 2 - nn_descent.MARGIN
    centres, members = nn_descent.balls(vec, len(x), radius)
    rho = {r.id: r.rho for r in centres.collect()}
    of = {r.id: r.centre for r in members.collect()}
    assert set(rho) | set(of) == set(range(len(x))) and not set(rho) & set(of) and len(of) > 60
    for i, c in of.items():
        assert np.arccos(min(1, x[i] @ x[c])) <= rho[c] + 1e-3 and rho[c] <= radius


def test_neighbours_where_rounds_do_not_help(spark, monkeypatch):
    for name, x in (("ROUNDS", 1), ("TREES", 1), ("LEAF", 0.01), ("LEAST_GAIN", 1.0), ("COVERS", 1)):
        monkeypatch.setattr(nn_descent, name, x)
    r = np.random.default_rng(4)
    base = r.standard_normal((200, 32))
    x = np.concatenate([base, base + 0.3 * r.standard_normal((200, 32))])
    want = _linked(x, 0.9)
    got = _found(nn_descent.neighbours(_vectors(spark, x), k=1))
    assert sum(n for _, n in want.values()) > 200 and _recall(got, want) == 1


def test_balls_that_are_neither_whole_nor_apart(spark, monkeypatch):
    """Vectors of two wide balls are compared, in blocks."""
    monkeypatch.setattr(nn_descent, "BLOCK", 7)
    a = np.linspace(0, 1.2, 60)
    x = np.stack([np.cos(a), np.sin(a), 0 * a], 1)
    want = _linked(x, 0.9)
    assert _found(nn_descent.neighbours(_vectors(spark, x))) == want


def test_audit_needs_partners(spark):
    r = np.random.default_rng(5)
    x = r.standard_normal((1500, 32))
    x[1] = x[0]
    vec = nn_descent.unit_vectors(_vectors(spark, x))
    none_ = spark.createDataFrame([], "id long, links long")
    assert nn_descent.audit(vec, none_, 0.9, sample=20) == 0.0


def test_neighbours_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [0.0, 2.0]), (7, [2.0, 0.1]), (8, [1.0, 0.0, 0.0]), (9, [2.0, 0.0, 0.0]), (10, [1.0]), (11, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert _found(nn_descent.neighbours(df)) == {1: (1, 2), 2: (1, 2), 7: (1, 2), 8: (8, 1), 9: (8, 1)}
    assert nn_descent.neighbours(df.where("vec_id > 100")).count() == 0


def test_a_hot_group_is_one_ball(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.standard_normal((2000, 16)), np.repeat(r.standard_normal((1, 16)), 1000, 0) + 0.01 * r.standard_normal((1000, 16))])
    got = _found(nn_descent.neighbours(_vectors(spark, x)))
    assert all(got[i][1] >= 999 and got[i][0] == got[2000][0] for i in range(2000, 3000))


def _page(title, items, note=None):
    extra = f"<aside><p>{note}</p></aside>" if note else ""
    body = "".join(f"<p>{i}</p>" for i in items)
    return f"<html><body><nav><a>Home</a><a>News</a></nav><article><h1>{title}</h1>{body}</article>{extra}<footer>All rights reserved</footer></body></html>"


def test_wrapper_of_a_host(spark):
    pages = [(k, f"http://a.example/{k}", _page(f"Title {k}", [f"Text {k} {i} &amp; more" for i in range(1 + k % 3)], "A note" + str(k) if k % 2 else None), "x") for k in range(6)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, content string")
    w = wrappers.wrappers(df).collect()
    assert len(w) == 1 and ")+" in w[0].wrapper and ")?" in w[0].wrapper
    for r in wrappers.extract(df).collect():
        k = r.page_id
        assert r.content == "\n".join([f"Title {k}", *(f"Text {k} {i} & more" for i in range(1 + k % 3))])
        assert not any(f.text in ("Home", "News", "All rights reserved") for f in r.fields)


def test_content_is_a_subtree_of_each_layout(spark):
    top = "<html><body><nav><a>Home</a></nav>"
    rows = [(k, f"http://a.example/{k}", f"{top}<article class=story><h1>Head {k}</h1><p>Long text of page {k}</p><ul><li>One {k}</li></ul><blockquote>Said {k}</blockquote><div><table><tr><td>Cell {k}</td></tr></table></div><pre>Code {k}</pre></article></body></html>") for k in range(6)]
    rows += [(k, f"http://a.example/{k}", f"{top}<div class=product><b>Name {k}</b><ul><li>Size {k}</li></ul></div></body></html>") for k in range(6, 9)]
    for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        k = r.page_id
        want = [f"Head {k}", f"Long text of page {k}", f"One {k}", f"Said {k}", f"Cell {k}", f"Code {k}"] if k < 6 else [f"Name {k}", f"Size {k}"]
        assert r.content == "\n".join(want)


def test_template_is_in_every_distinct_page(spark):
    copies = [(k, "http://copy.example/", _page("One title", ["Only text of this page"])) for k in range(3)]
    noted = [(10 + k, f"http://note.example/{k}", _page(f"Title {k}", [f"Text {k}"], "By the same author" if k in (1, 2) else None)) for k in range(6)]
    empty = [(20, "http://note.example/e", ""), (21, "http://note.example/n", None)]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(copies + noted + empty, "page_id long, url string, html string")).collect()}
    for k, _, _ in copies:
        assert got[k].content == "One title\nOnly text of this page"
        assert [f.text for f in got[k].fields] == ["Home", "News", "One title", "Only text of this page", "All rights reserved"]
    for k in range(6):
        assert [f.text for f in got[10 + k].fields] == [f"Title {k}", f"Text {k}", *(["By the same author"] if k in (1, 2) else [])]


def _lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("cells", [1, 40, 1 << 22])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(wrappers, "TABLE_CELLS", cells)
    r = random.Random(11)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(0, 25))] for _ in range(2))
        got = wrappers._align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) == _lcs(a, b)


def _many_layouts(hosts=3, layouts=40):
    r = random.Random(12)
    rows = []
    for h in range(hosts):
        for k in range(layouts):
            for copy in range(2):
                body = "".join(f"<p>Text {h} {k} {copy} {i}</p>" for i in range(r.randrange(1, 4))) + ("<aside><p>Note %d</p></aside>" % k if k % 3 else "") + "".join(f"<{t}>{t} {k} {copy}</{t}>" for t in r.sample(["h2", "h3", "em", "b", "i", "u", "code", "q"], 3))
                rows.append((len(rows), f"http://h{h}.example/{k}", f"<html><body><nav><a>Home</a></nav><article><h1>Head {k} {copy}</h1>{body}</article><footer>All rights</footer></body></html>"))
    return rows


@pytest.mark.parametrize("fan", [2, 4, 1000])
def test_wrappers_of_many_layouts(spark, monkeypatch, fan):
    """Every text of a page is in its template or in a field, in order; slots of a page differ; the tree's shape changes neither template nor content."""
    monkeypatch.setattr(wrappers, "FAN", fan)
    rows = _many_layouts()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in wrappers.extract(df).collect()}
    assert len(got) == len(rows)
    for i, _, page in rows:
        texts = [t for k, t in wrappers.tokens(page) if k == wrappers.TEXT]
        assert [f.text for f in got[i].fields] == [t for t in texts if t not in ("Home", "All rights")]
        assert got[i].content == "\n".join(t for t in texts if t not in ("Home", "All rights"))  # the note is within the article
        slots = [f.slot for f in got[i].fields]
        assert slots == sorted(slots)
    assert wrappers.wrappers(df).count() < 20


def test_wrappers_stay_bounded():
    """Streams that share little get wrappers of their own, so that none grows with the layouts."""
    w = [wrappers.Wrapper([f"t{k}.{i}" for i in range(30)] + ["nav", "#", "/nav"], [k] * 33, k, 33, [k]) for k in range(1, 40)]
    have = []
    for x in w:
        for k, y in enumerate(have):
            if (got := wrappers.merge(y, x)) is not None:
                have[k] = got[0]
                break
        else:
            have.append(x)
    assert len(have) > 5 and all(len(x.keys) <= wrappers.WIDTH * 33 for x in have)


def test_pages_keep_their_texts(spark):
    pages = table(spark, SF, "pages")
    rows = wrappers.extract(pages).collect()
    assert len(rows) == pages.count()
    assert sum(bool(r.content) for r in rows) > 0.9 * len(rows)


def test_odd_pages(spark):
    rows = [(1, None, "<p>a</p>"), (2, "http://b.example/", None), (3, "http://b.example/", ""), (4, "no url", "<p>x<b>y"), (None, "http://b.example", "<p>q</p>"), (None, None, None), (5, "http://b.example", "<p>" * 3000 + "deep"), (5, "http://b.example", "<p>" * 3000 + "deep"), (6, "http://c.example", "text <script>no</script>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = wrappers.extract(df).collect()
    assert len(got) == len(rows)
    assert [r.content for r in got if r.page_id == 2] == [None] and [r.content for r in got if r.page_id == 3] == [""]
    assert [f.text for r in got if r.page_id == 6 for f in r.fields] == ["text"]
    assert wrappers.extract(df.where("page_id > 100")).count() == 0
