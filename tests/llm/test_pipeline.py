"""The pipeline's stages follow one another, each takes effect, and their rows are those of plain loops."""

import math

import corpus_pipeline
import xxhash

from polystrata.llm import language_id, mixing, ngram_join, quality, sentence_pieces
from polystrata.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    docs = documents
    rows = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = materialize(stage(spark, docs, SF), "test")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns
        if k < 3:
            assert out.exceptAll(docs).isEmpty()
        docs = out
        rows.append(docs.count())
    assert rows[0] >= rows[1] > rows[2] > rows[3] > 0 and rows[4] == rows[5] > 0
    assert docs.where("NOT lossless").isEmpty()


def _copies(docs, quality_of):
    """{doc_id: copies} of the mixture, by plain loops over (doc_id, text, source)."""
    import hashlib

    rows = []
    for i, t, s in docs:
        u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        rows.append((s, -math.log(u) / mixing.QUALITY[quality_of.get(i)], str(i), i, len((t or "").split())))
    total = {}
    for s, *_, n in rows:
        total[s] = total.get(s, 0) + n
    whole, weight = sum(total.values()), sum(n**mixing.TEMPER for n in total.values())
    out = {}
    for s, n in total.items():
        want = math.floor(whole * mixing.BUDGET * n**mixing.TEMPER / weight)
        epochs, rest = (want // n, want % n) if n else (0, want)
        cum = 0
        for r in sorted(r for r in rows if r[0] == s):
            cum += r[4]
            out[r[3]] = epochs + (cum <= rest)
    return out


def test_pipeline_as_plain_loops(spark, documents, tmp_path):
    """All five stages over documents with junk, copies and an unknown language, against their brute-force versions in turn."""
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in documents.where("length(text) < 1500").collect()]
    junk = "".join(chr(0x61 + xxhash.xxh32_intdigest(str(k)) % 26) if k % 90 else " " for k in range(2000))
    rows += [(10_000, junk, None, "src0", len(junk)), (10_001, None, "en", "src0", None), (10_002, rows[0][1], rows[0][2], "src1", rows[0][4]), (10_003, "", "de", None, 0)]
    spark.createDataFrame(rows, documents.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = table(spark, SF, "labels")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (table(spark, str(tmp_path), x) for x in ("documents", "labels"))

    model = language_id.train(docs)
    fit = {r[0]: language_id.label([r[1] or ""], model)[0] for r in rows}
    kept = [r for r in rows if fit[r[0]][0] is not None and fit[r[0]][2] >= language_id.LEAST_WORDS_SHARE]
    assert {10_000, 10_001, 10_003} <= {r[0] for r in rows} - {r[0] for r in kept}

    m = quality.train(spark.createDataFrame(kept, documents.schema), labels)
    score = quality._scorer(m)
    good = [r for r in kept if score(r[1])[1] >= m.threshold]
    assert 0 < len(good) < len(kept)

    pairs = ngram_join.brute_pairs([r[:2] for r in good])
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    single = [r for r in good if find(r[0]) == r[0]]
    assert len(single) < len(good) and 10_002 not in {r[0] for r in single}

    worst = {}
    for r in labels.collect():
        worst[r.doc_id] = r.quality if worst.get(r.doc_id) is None else min(worst[r.doc_id], r.quality)
    copies = _copies([(r[0], r[1], r[3]) for r in single], worst)
    v = sentence_pieces.vocabulary(sentence_pieces.MODEL)
    want = []
    for r in single:
        ids, _ = sentence_pieces.encode_batch(v, [r[1]], sentence_pieces.doc_keys([r[0]], sentence_pieces.SEED), sentence_pieces.DROPOUT)  # by itself; brute-forced elsewhere
        want += [(r[0], ids.tolist())] * copies[r[0]]
    got = [(r.doc_id, list(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_odd_rows(spark, odd):
    """Null, empty and long texts, repeated rows, and columns that clash with names that the stages use."""
    kept = corpus_pipeline.identify_language(spark, odd, SF)
    assert not {r.doc_id for r in kept.collect()} & {5, 6, 11, 14}
    for docs in (odd, odd.where("false")):
        empty = docs.isEmpty()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs
            docs = materialize(stage(spark, docs, SF), "test")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == odd.columns
                assert {r["copies"] for r in docs.collect()} <= {99} and {r.id for r in docs.collect()} <= {5}
                assert docs.join(before, "doc_id", "left_anti").where("doc_id IS NOT NULL").isEmpty()
            assert docs.isEmpty() if empty else True
            if k == 2:
                assert not {r.doc_id for r in docs.collect()} & {2, 3, 8, 10}
