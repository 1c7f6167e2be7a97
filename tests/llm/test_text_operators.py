"""Language ID, quality, toxicity and SentencePiece against plain Python, held-out labels and round trips."""

import itertools
import math
import random

import numpy as np
import pytest
import zstandard

from polystrata.llm import language_id, quality, sentence_pieces, toxicity
from polystrata.llm.common import table

SF = "/root/testdata/sf0.01"


def test_viterbi_is_exact():
    r = np.random.default_rng(1)
    for n, k in ((1, 3), (4, 2), (6, 3)):
        for _ in range(20):
            s = r.standard_normal((n, k)) * 3
            got = language_id.viterbi(s, 2.0)
            cost = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
            best = max(cost(p) for p in itertools.product(range(k), repeat=n))
            assert cost(list(got)) == pytest.approx(best)


def test_certified_texts_need_no_switch():
    s = np.array([[10.0, -50, 0], [-50, 10, 0]])  # the third language is the best single one, the first two are better
    assert not language_id.certified(s - s[:, 2:], np.zeros(2, np.int64), 12.0)[0]
    r = np.random.default_rng(6)
    for _ in range(300):
        s = r.standard_normal((5, 3)) * r.choice([1, 3, 6])
        k = s.sum(0).argmax()
        if language_id.certified(s - s[:, [k]], np.zeros(5, np.int64), 6.0)[0]:
            p = language_id.viterbi(s, 6.0)
            assert s[np.arange(5), p].sum() - 6.0 * (p[1:] != p[:-1]).sum() <= s[:, k].sum() + 1e-9


def test_language_of_held_out_documents(spark):
    docs = table(spark, SF, "documents").where("length(text) > 200")
    held = docs.where("doc_id % 2 = 1")
    got = language_id.identify(held, language_id.train(docs.where("doc_id % 2 = 0"), 60))
    n, right = got.join(held.select("doc_id", "lang"), "doc_id").selectExpr("count(*)", "sum(cast(language = lang AS int))").first()
    assert n > 150 and right / n > 0.97


LANGUAGES = {
    "en": "the river and the stone in the garden of winter with letters that were morning",
    "de": "der fluss und die steine im garten des winters mit briefen die am morgen waren",
    "ru": "река и камни в саду зимы с письмами которые были утром на окне города",
    "uk": "річка і каміння в саду зими з листами які були вранці на вікні міста",
}


def _languages(langs=("en", "de", "ru", "uk")):
    r = random.Random(8)
    rows = []
    for lang in langs:
        ws = LANGUAGES[lang].split()
        rows += [(lang, " ".join(r.choice(ws) for _ in range(30))) for _ in range(40)]
    return language_id.fit(rows)


def test_labels_do_not_depend_on_other_texts():
    r = random.Random(9)
    pool = [w for t in LANGUAGES.values() for w in t.split()] + ["日本", "x" * 90, "qzjx" * 22, "12", "ελλάδα", "שלום", "é́", "ｆｕｌｌ"]
    for m in (_languages(), _languages(("en", "de"))):
        texts = [" ".join(r.choice(pool) for _ in range(r.randrange(0, 25))) for _ in range(150)] + [" ".join("".join(r.choice("zqxj") for _ in range(90)) for _ in range(5)), "река и камни", ""]
        whole = language_id.label(texts, m)
        assert whole == [language_id.label([t], m)[0] for t in texts]
        assert whole[::-1] == language_id.label(texts[::-1], m)
        junk = whole[150]
        assert junk[0] is not None and junk[2] < language_id.LEAST_WORDS_SHARE


def _brute_label(text, m, penalty):
    """Spans by the recursion over all words, with plain loops."""
    begin, end, kind, _, bins, first, _ = language_id.words_of([text])
    score = np.concatenate([language_id.word_scores(m, kind[[w]], bins[first[w] : first[w] + end[w] - begin[w]], np.array([0]), (end - begin)[[w]])[:, : len(m.langs)] for w in range(len(begin))])
    path = language_id.viterbi(score, penalty)
    out = []
    for b, e, k in zip(begin.tolist(), end.tolist(), path.tolist()):
        if out and out[-1][2] == m.langs[k]:
            out[-1] = (out[-1][0], e, m.langs[k])
        else:
            out.append((b, e, m.langs[k]))
    return out


def test_spans_as_by_the_recursion_over_all_words():
    r = random.Random(10)
    m = _languages()
    n = 0
    for _ in range(200):
        text = " ".join(" ".join(r.choice(LANGUAGES[lang].split()) for _ in range(r.randrange(1, 9))) for lang in r.choices(list(LANGUAGES), k=r.randrange(1, 4)))
        got = language_id.label([text], m)[0][3]
        assert got == _brute_label(text, m, language_id.PENALTY)
        n += len(got) > 1
    assert n > 60


def test_scripts_narrow_and_words_choose():
    m = _languages()
    assert [language_id.label([LANGUAGES[x]], m)[0][0] for x in LANGUAGES] == list(LANGUAGES)
    untrained = _languages(("en", "uk"))
    assert language_id.label([LANGUAGES["uk"]], untrained)[0][0] == "uk"
    assert language_id.label(["日本語 テキスト"], untrained)[0][0] == "ja" and language_id.label(["中文文本"], untrained)[0][0] == "zh"
    assert language_id.label([LANGUAGES["ru"]], _languages(("en",)))[0][0] == "ru"


def test_floor_is_from_all_training_texts():
    odd = [("en", "zxqv kjwq vvxz qqzj")] * 3
    plain = [("en", LANGUAGES["en"])] * 60
    assert language_id.fit(plain + odd).floor < language_id.fit(plain + plain[:3]).floor


def test_mixed_text_has_spans(spark):
    docs = table(spark, SF, "documents")
    m = language_id.train(docs)
    by = {r[0]: r[1] for r in docs.where("length(text) > 400").groupBy("lang").agg({"text": "max"}).collect()}
    text = by["en"][:400] + " привет мир как дела друзья " + by["de"][:400]
    spans = language_id.label([text], m)[0][3]
    assert [s[2] for s in spans] == ["en", "ru", "de"]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_language_of_odd_rows(spark, odd, none, documents):
    m = language_id.train(documents)
    rows = language_id.identify(odd, m).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id in (5, 6, 11, 14):
            assert r.language is None and not r.accepted and r.spans == []
    assert len({(r.doc_id, r.language, r.fit) for r in rows if r.doc_id == 4}) == 1
    kept = language_id.keep_accepted(odd, m)
    assert kept.columns == odd.columns and kept.count() == sum(r.accepted for r in rows)
    assert language_id.identify(none, language_id.train(none)).count() == 0


def test_quality_of_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [(r[0], r[1]) for r in docs.join(labels, "doc_id").select("quality", "text").where("text <> ''").orderBy("doc_id").collect()]
    m = quality.fit(rows[0::2])
    score = quality._scorer(m)
    good = [score(t)[1] for q, t in rows[1::2] if q == 1]
    bad = [score(t)[1] for q, t in rows[1::2] if q == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.8
    assert np.mean([g >= m.threshold for g in good]) > 0.95


def test_dictionary_has_all_of_every_text():
    texts = [f"[{k:04d}]" * 700 + f"<{k:04d}>" * 700 for k in range(1500)]
    d = quality._dictionary(texts).decode()
    assert len(d) <= quality.DICT_BYTES
    assert all(f"{k:04d}]" in d and f"{k:04d}>" in d for k in range(1500))
    for n in (*range(150, 200), 700, 701, 702, 1399):  # texts about as long as their share
        d = quality._dictionary([f"{k:07d}" * (n // 7) + "x" * (n % 7 + 1) for k in range(quality.DICT_BYTES // n)])
        assert 0 < len(d) <= quality.DICT_BYTES
    assert quality._dictionary(["short", "short", "a" * 10]) == b"a" * 10 + b"short"
    assert len(quality._dictionary(["x" * 400_000, "y"])) == quality.DICT_BYTES


def _plain_difference(text, m):
    """More bytes under the bad than under the good dictionary, block by block, with compressors made for each block."""
    raw, more = text.encode("utf-8", "surrogatepass"), 0
    for i in range(0, len(raw), quality.BLOCK):
        size = []
        for d in (m.good, m.bad):
            z = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            size.append(len(z.compress(raw[i : i + quality.BLOCK])))
        more += size[1] - size[0]
    return (more + quality.PRIOR_BYTES * m.prior) / (len(raw) + quality.PRIOR_BYTES)


def test_scores_as_by_plain_compression(spark, odd):
    m = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    text = docs.collect()
    got = sorted(((r.doc_id, round(r.difference, 9), round(r.score, 9), r.keep) for r in quality.classify(docs, m).collect()), key=repr)
    want = []
    for r in text:
        d = _plain_difference(r.text, m) if r.text else 0.0
        p = 1 / (1 + math.exp(-max(-30, min(30, m.slope * d + m.offset)))) if r.text else 0.0
        want.append((r.doc_id, round(d, 9), round(p, 9), bool(r.text) and p >= m.threshold))
    assert got == sorted(want, key=repr)


def test_a_score_at_the_threshold_is_kept(spark):
    docs = spark.createDataFrame([(1, "river stone winter"), (2, None)], "doc_id long, text string")
    m = quality.Model(b"river stone", b"buy now", 0.0, 0.0, 0.0, 0.5)
    assert {(r.doc_id, r.keep) for r in quality.classify(docs, m).collect()} == {(1, True), (2, False)}


def test_what_only_the_end_of_a_text_shows():
    """Good and bad texts begin alike; only what follows the first 2,000 bytes tells them apart."""
    r = random.Random(12)
    word = lambda abc: "".join(r.choice(abc) for _ in range(7))
    start, ok, junk = ([word(a) for _ in range(60)] for a in ("abcdefgh", "ijklmnop", "qrstuvwx"))
    text = lambda tail: " ".join(r.choice(start) for _ in range(260)) + " " + " ".join(r.choice(tail) for _ in range(260))
    rows = [(k % 2, text(ok if k % 2 else junk)) for k in range(200)]
    m = quality.fit(rows[:160])
    score = quality._scorer(m)
    assert all((score(t)[1] > 0.5) == bool(q) for q, t in rows[160:])


def test_quality_of_odd_rows(spark, odd, none, labels, documents):
    m = quality.train(documents, table(spark, SF, "labels"))
    rows = quality.classify(odd, m).collect()
    assert len(rows) == odd.count()
    assert all(r.score == 0 and not r.keep for r in rows if r.doc_id in (5, 6))
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    kept = quality.keep_good(odd, m)
    assert kept.columns == odd.columns and kept.count() == sum(r.keep for r in rows)
    assert quality.classify(none, quality.train(none, labels)).count() == 0
    assert quality.classify(odd, quality.train(odd, labels)).count() == odd.count()


def _obfuscated(w):
    return ["".join({"e": "3", "i": "1", "o": "0", "a": "4", "s": "5"}.get(c, c) for c in w), " ".join(w), "".join(c * 3 for c in w), "-".join(w)]


def test_restored_words():
    counts = np.bincount(toxicity._grams(["grumble blockhead nastiness and other words of this grumble blockhead nastiness " * 50]), minlength=toxicity.ALPHABET**4)
    lm = toxicity.model_of(counts.astype(float))
    for w in ("grumble", "blockhead"):
        for s in _obfuscated(w):
            assert toxicity.restore(s, lm) == w


def _cheapest(s, lm):
    """Least cost of any path of the lattice, by trying all."""
    best = math.inf
    for path in itertools.product(*toxicity.lattice(s), [(0, 0.0)]):
        st, cost = [0, 0, 0], 0.0
        for sym, price in path:
            cost += price
            if sym < 0 or sym == 0 and st[-1] == 0:
                continue
            st.append(sym)
            g = 0
            for x in st[-4:]:
                g = g * toxicity.ALPHABET + x
            cost += float(lm[g])
        best = min(best, cost)
    return best


def _cost_of(out, s, lm):
    """Least cost of the paths of the lattice that spell ``out``."""
    best = math.inf
    for path in itertools.product(*toxicity.lattice(s), [(0, 0.0)]):
        st, cost = [0, 0, 0], 0.0
        for sym, price in path:
            cost += price
            if sym < 0 or sym == 0 and st[-1] == 0:
                continue
            st.append(sym)
            g = 0
            for x in st[-4:]:
                g = g * toxicity.ALPHABET + x
            cost += float(lm[g])
        if "".join(chr(x + 96) if x else " " for x in st[3:]).strip() == out:
            best = min(best, cost)
    return best


def test_restored_text_is_the_best_path():
    r = random.Random(13)
    counts = np.bincount(toxicity._grams(["idiot moron it is on to tom and so did sit " * 30]), minlength=toxicity.ALPHABET**4)
    lm = toxicity.model_of(counts.astype(float))
    for _ in range(40):
        s = "".join(r.choice("iiddoott1103 .-$") for _ in range(r.randrange(1, 7)))
        assert _cost_of(toxicity.restore(s, lm), s, lm) == pytest.approx(_cheapest(s, lm), abs=1e-3), s


def test_a_score_at_the_threshold_is_toxic(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "you"), (3, "you idiot"), (3, "you idiot")], "doc_id long, text string")
    lm = toxicity.model_of(np.ones(toxicity.ALPHABET**4))
    got = toxicity.toxic_documents(docs, toxicity.Model({"idiot": 4.0}, 1.0, -4.0, 0.5, lm)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.doc_id)] == [1, 3, 3] and all(r.score == 0.5 for r in got)


def test_toxic_documents_found(spark):
    r = random.Random(5)
    bad = ["grumblefool", "stinkhead", "nastyface"]
    base = [a + b for a in ("riv", "sto", "mark", "lett", "gard", "wind", "morn", "ligh", "pap", "nor") for b in ("er", "ne", "et", "ing", "en", "ow", "el", "th", "um", "ay", "ock", "ust")]  # texts of few words would count as copies
    rows = []
    for i in range(400):
        ws = [r.choice(base) for _ in range(30)]
        tox = i % 4 == 0
        if tox:
            for _ in range(2):
                ws[r.randrange(30)] = r.choice(bad)
        rows.append((i, " ".join(ws), int(tox)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    m = toxicity.train(docs, labels)
    hidden = [(1000 + k, f"the river and the {s} in the garden") for k, s in enumerate(x for w in bad for x in _obfuscated(w))]
    clean = [(2000, "12 rivers in 1999, www.stone.example, 3 4 5 and a b c"), (2001, "letter 4 you"), (2002, None), (2003, "")]
    got = {x.doc_id for x in toxicity.toxic_documents(spark.createDataFrame(hidden + clean, "doc_id long, text string"), m).collect()}
    assert got == {i for i, _ in hidden}
    assert {x.doc_id for x in toxicity.toxic_documents(docs, m).collect()} == {i for i, _, y in rows if y}


def _scorer(words):
    text = " ".join(words) + " you and that of the one in this other words to be so "
    counts = np.bincount(toxicity._grams([text * 50]), minlength=toxicity.ALPHABET**4)
    return toxicity.Scorer(toxicity.Model(dict.fromkeys(words, 4.0), 1.0, 0.0, 0.5, toxicity.model_of(counts.astype(float))))


def test_every_noise_of_the_channel_is_decoded():
    s = _scorer(["jerks", "idiot", "moron"])
    forms = {"jerks": ["jerk$"], "moron": ["morron", "mo-ron"], "idiot": ["idio+", "iddiot", "idi-ot", "id.iot", "id iot", "i  d  i  o  t", "i - d - i - o - t", "1d10t", "i d i o t"]}
    for w, own in forms.items():
        for f in own:
            assert s.score([f"you and {f} of the other"])[0][2] == [w], f
    clean = ["you and the one", "idiots", "xid-iot", "id-iots", "c l a s s i c", "ídiot", "", "mor onto"]
    assert all(r == (0.0, [], []) for r in s.score(clean))
    assert [r[2] for r in s.score(["clean words", "id-iot", "none"])] == [[], ["idiot"], []]


def test_long_stretches_are_decoded_whole():
    s = _scorer(["idiot"])
    for f in ("idi" + "o" * 80 + "t", "i" * 30 + "-" + "d" * 30 + " i " + "o" * 40 + ".t", "id1" + "0" * 50 + "+" * 40, "i d i" + " o" * 50 + " t", "other-" * 30 + "id-iot"):
        assert s.score([f"you and {f} of the other"])[0][2] == ["idiot"], f
    assert s.score(["x" * 31 + "id-iot", "other" * 40 + "id-iot", "i" * 100])[0:3] == [(0.0, [], [])] * 3


def test_toxicity_of_odd_rows(spark, odd, none, labels):
    assert toxicity.toxic_documents(none, toxicity.train(none, labels)).count() == 0
    got = toxicity.toxic_documents(odd, toxicity.train(odd, labels)).collect()
    assert not {r.doc_id for r in got} & {5, 6}


def test_pieces_as_by_plain_scan():
    v = sentence_pieces.vocabulary(sentence_pieces.MODEL)
    texts = ["The quick brown fox  jumps", "", "été à Zürich 日本 \U0001f600", "aaaaaaaaaaaaaaaaaa", " lead and trail ", "internationalisation " * 5]
    keys = sentence_pieces.doc_keys(list(range(len(texts))), 3)
    for p in (0.0, 0.1, 0.7, 1.0):
        ids, off = sentence_pieces.encode_batch(v, texts, keys, p)
        for k, t in enumerate(texts):
            own = ids[off[k] : off[k + 1]].tolist()
            assert own == sentence_pieces.brute_encode(v, t, keys[k], p)
            assert sentence_pieces.decode(v, own) == t


def test_long_words_as_by_plain_scan():
    """Words of more symbols than are merged row by row."""
    v = sentence_pieces.vocabulary(sentence_pieces.MODEL)
    r = random.Random(14)
    texts = ["".join(r.choice("abcdeilnorst") for _ in range(n)) for n in (sentence_pieces._LONG, sentence_pieces._LONG + 1)] + ["internationalisation" * 11, "é日" * 100]
    keys = sentence_pieces.doc_keys(list(range(len(texts))), 5)
    for p in (0.0, 0.3):
        ids, off = sentence_pieces.encode_batch(v, texts, keys, p)
        for k, t in enumerate(texts):
            own = ids[off[k] : off[k + 1]].tolist()
            assert own == sentence_pieces.brute_encode(v, t, keys[k], p)
            assert sentence_pieces.decode(v, own) == t


def test_pieces_without_dropout_as_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    v = sentence_pieces.vocabulary(sentence_pieces.MODEL)
    t = "Rivers and stones are in the northern garden"
    ids, _ = sentence_pieces.encode_batch(v, [t], sentence_pieces.doc_keys([0], 1), 0.0)
    assert ids.tolist() == sp.encode(t)


def test_pieces_vary_by_seed(spark, documents):
    one, two, again = (sentence_pieces.encode(documents, seed=s).select("doc_id", "ids") for s in (1, 2, 1))
    assert one.exceptAll(again).isEmpty()
    assert one.exceptAll(two).count() > documents.count() / 2


def test_pieces_of_odd_rows(spark, odd, none, odd_rows):
    e = sentence_pieces.encode(odd)
    rows = e.collect()
    assert len(rows) == len(odd_rows) and all(r.lossless for r in rows)
    assert [r.ids for r in rows if r.doc_id == 5] == [None] and [r.ids for r in rows if r.doc_id == 6] == [[]]
    back = sorted(((r.doc_id, r.text) for r in sentence_pieces.decoded(e).collect()), key=repr)
    assert back == sorted(((r[0], r[1]) for r in odd_rows), key=repr)
    assert sentence_pieces.encode(none).count() == 0
