"""Language identification of spans: the script of a word narrows its candidate
languages, character trigrams score it, and a Viterbi path with a switching
penalty labels the spans of mixed-language text.

The candidates of a word are the languages whose training texts use its script,
each by its own trigram scores, and the language that stands for the script where
no text trains it. Any other language is ``FAR`` below the word's best one,
whatever the texts beside it are.

The path is exact. Most texts are in one language, for which a bound (see
``certified``) shows without running the recursion that no switch can pay.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystrata.llm.common import alpha_table, code_points, lean, lower_table, slices, tune

BINS = 1 << 16
PENALTY = 12.0  #: nats that a switch of language costs
LEAST_WORDS_SHARE = 0.5  #: of the letters of an accepted text, the least share in words that fit their language
TRAIN_ROWS = 400  #: labelled rows a language, at most in expectation, that the scores and the floor are fitted on
FAR = 1000.0  #: nats by which a language that isn't a candidate of a word is below its best one
AT_ONCE = 1 << 17  #: characters, about, that are labelled at once; it bounds a worker's memory and changes no label
OWN_SCRIPT = 0.05  #: of the letters of a language's training texts, the share from which a script is one that it is written in

#: Scripts besides Latin with the language that stands for them where no trained language uses them, and their code point ranges.
SCRIPTS: tuple[tuple[str, tuple[tuple[int, int], ...]], ...] = (
    ("ru", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("el", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("he", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("ar", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("hi", ((0x900, 0x97F), (0xA8E0, 0xA8FF))),
    ("th", ((0xE00, 0xE7F),)),
    ("ko", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("ja", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("zh", ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))),
    ("hy", ((0x530, 0x58F),)),
    ("ka", ((0x10A0, 0x10FF),)),
)


@dataclass(frozen=True)
class Model:
    """Log probability of each hashed trigram in each trained language, the floor of a fitting word, a trigram, and which
    languages may write a word of each script: the trained ones, then those that stand for a script."""

    langs: tuple[str, ...]
    logp: np.ndarray
    floor: float
    may: np.ndarray


@functools.cache
def script_table() -> np.ndarray:
    """Code point -> 0 no letter, 1 Latin or any script without a range, 2.. the scripts."""
    t = alpha_table().astype(np.uint8)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            t[a : b + 1] = np.where(t[a : b + 1] > 0, k + 2, 0)
    t[0x900:0x980] = np.where(t[0x900:0x980] > 0, t[0x900:0x980], 0)
    return t


def words_of(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Letter runs of one script: begin, end (code points of the joined texts), script, text, then the
    trigram bins of their letters and where each word's begin; last, where each text begins."""
    cps, at = code_points(texts)
    script = script_table()[cps]
    edge = np.flatnonzero(np.diff(script, prepend=0))
    inside = script[edge] > 0
    begin = edge[inside]
    nxt = np.append(edge[1:], len(script))
    end, kind = nxt[inside], script[begin]
    text = np.searchsorted(at, begin, "right") - 1
    low = lower_table()[cps]
    c = np.where(script > 0, low, np.uint32(32))
    p, n = np.empty_like(c), np.empty_like(c)
    p[1:], n[:-1] = c[:-1], c[1:]
    p[:1], n[-1:] = 32, 32
    h = (p * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77)) ^ (n * np.uint32(0xC2B2AE3D) + np.uint32(0x165667B1))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    letters = np.flatnonzero(script)
    bins = (h[letters] >> np.uint32(16)).astype(np.int64)
    first = np.zeros(len(begin), np.int64)
    if len(begin):
        np.cumsum((end - begin)[:-1], out=first[1:])
    return begin, end, kind, text, bins, first, at


def fit(rows: list[tuple[str, str]], alpha: float = 0.05) -> Model:
    """A model from (language, text) rows; rows without either are ignored."""
    rows = [(a, t) for a, t in rows if a and t]
    langs = tuple(sorted({a for a, _ in rows})) or ("und",)
    counts = np.zeros((len(langs), BINS))
    letters = np.zeros((len(langs), len(SCRIPTS) + 2))
    for k, lang in enumerate(langs):
        own = [t for a, t in rows if a == lang]
        for i, j in slices(own, AT_ONCE):
            begin, end, kind, _, bins, _, _ = words_of(own[i:j])
            counts[k] += np.bincount(bins, minlength=BINS)
            letters[k] += np.bincount(kind, weights=end - begin, minlength=letters.shape[1])
    seen = max(1, int((counts.sum(0) > 0).sum()))
    logp = np.log((counts + alpha) / (counts.sum(1, keepdims=True) + alpha * seen))
    table = np.ascontiguousarray(logp.T.astype(np.float32))
    # A word fits when its mean score a trigram is above what nearly all training words reach.
    means = []
    for k, lang in enumerate(langs):
        own = [t for a, t in rows if a == lang]
        for i, j in slices(own, AT_ONCE):
            begin, end, kind, _, bins, first, _ = words_of(own[i:j])
            if len(begin):
                means.append(np.add.reduceat(table[bins, k], first) / (end - begin))
    floor = float(np.quantile(np.concatenate(means), 0.002)) - 1.0 if means else -np.inf
    return Model(langs, table, floor, _candidates(langs, letters))


def _candidates(langs: tuple[str, ...], letters: np.ndarray) -> np.ndarray:
    """Scripts x (trained languages, languages that stand for a script): which may write a word of the script."""
    may = np.zeros((len(SCRIPTS) + 2, len(langs) + len(SCRIPTS)), bool)
    may[:, : len(langs)] = (letters >= OWN_SCRIPT * np.maximum(letters.sum(1, keepdims=True), 1)).T
    may[1, : len(langs)] |= not may[1, : len(langs)].any()
    for k, (name, _) in enumerate(SCRIPTS):
        if name in langs:  # trained, if on another script
            may[k + 2, langs.index(name)] |= not may[k + 2, : len(langs)].any()
        else:
            may[k + 2, len(langs) + k] = True
    ja, zh = (2 + [s for s, _ in SCRIPTS].index(x) for x in ("ja", "zh"))
    may[zh] |= may[ja]  # Han letters also write Japanese
    return may


def certified(gain: np.ndarray, text: np.ndarray, penalty: float) -> np.ndarray:
    """For each text whether its best single language is the best path.

    ``gain`` (words x languages) is what each word would gain over the text's best
    language. A path that leaves that language has pieces of one other language;
    k pieces cost at least k - 1 switches, and a path of one piece gains nothing.
    If every run of words gains less than half a switch in any language, k pieces
    gain less than k / 2 switches, so that no path of two or more is as good. What
    a word loses counts up to one switch, which changes no such run and keeps the
    sums exact to far less than the margin.
    """
    n = int(text[-1]) + 1
    ok = np.ones(n, bool)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    for k in range(gain.shape[1]):
        g = np.maximum(gain[:, k], -penalty)
        total = np.cumsum(g)
        before = total - g
        step = float(np.abs(g).sum()) + 1.0  # each text starts below all before it
        shift = np.repeat(before[first], np.diff(np.append(first, len(g))))
        low = np.minimum.accumulate(before - shift - step * text)
        run = (total - shift - step * text) - low
        worst = np.maximum.reduceat(run, first)
        ok[text[first]] &= worst < penalty / 2 - 1e-3
    return ok


def viterbi(score: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels for words x languages scores where every switch costs ``penalty``; ties stay, then go to the first language."""
    n, m = score.shape
    rows = score.tolist()
    best = rows[0]
    back = []
    for r in rows[1:]:
        top = max(best)
        j = best.index(top)
        top -= penalty
        back.append([k if best[k] >= top else j for k in range(m)])
        best = [(b if b >= top else top) + s for b, s in zip(best, r)]
    path = [best.index(max(best))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return np.array(path[::-1], np.int64)


def word_scores(model: Model, kind: np.ndarray, bins: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words x (trained languages, languages that stand for a script): the score of each word, by itself, in each of its candidates, and FAR below the best of them in all others.

    A language that stands for a script without training texts scores as a word at the floor does.
    """
    lat = len(model.langs)
    trained = np.add.reduceat(model.logp[bins], first, axis=0).astype(np.float64)
    if model.may[1, :lat].all() and not (kind > 1).any():
        return trained
    score = np.full((len(kind), model.may.shape[1]), -np.inf)
    score[:, :lat] = trained
    w = np.flatnonzero(kind > 1)
    score[w, lat:] = (model.floor if np.isfinite(model.floor) else 0.0) * size[w, None]
    names = [s for s, _ in SCRIPTS]
    han = w[kind[w] == 2 + names.index("zh")]
    score[han, lat + names.index("ja")] -= 0.5 * size[han]
    may = model.may[kind]
    best = np.where(may, score, -np.inf).max(1, keepdims=True)
    return np.where(may, score, best - FAR)


def label(texts: list[str], model: Model, penalty: float = PENALTY) -> list[tuple]:
    """For each text (language or None, share of letters in it, share that fits, spans); a span is (begin, end, language), in characters."""
    begin, end, kind, text, bins, first, at = words_of(texts)
    out: list[tuple] = [(None, 0.0, 0.0, [])] * len(texts)
    if not len(begin):
        return out
    names = [*model.langs, *(s for s, _ in SCRIPTS)]
    size = end - begin
    score = word_scores(model, kind, bins, first, size)
    firsts = np.flatnonzero(np.diff(text, prepend=-1))
    own = text[firsts]
    best = np.add.reduceat(score, firsts, axis=0).argmax(1)
    runs = np.diff(np.append(firsts, len(text)))
    lang = np.repeat(best, runs)
    dense = np.repeat(np.arange(len(own)), runs)
    ok = certified(score - score[np.arange(len(score)), lang][:, None], dense, penalty)
    for k in np.flatnonzero(~ok):
        a, b = firsts[k], firsts[k] + runs[k]
        lang[a:b] = viterbi(score[a:b], penalty)
    chosen = score[np.arange(len(score)), lang]
    fits = (lang >= len(model.langs)) | (chosen / size >= model.floor)
    good = np.add.reduceat(np.where(fits, size, 0), firsts)
    letters = np.add.reduceat(size, firsts)
    cut = np.flatnonzero((np.diff(lang, prepend=-1) != 0) | (np.diff(dense, prepend=-1) != 0))
    last = np.append(cut[1:], len(lang)) - 1
    b0, e0 = begin[cut] - at[text[cut]], end[last] - at[text[cut]]
    cum = np.append(0, np.cumsum(size))
    weight = cum[last + 1] - cum[cut]
    of = dense[cut]
    lo = np.searchsorted(of, np.arange(len(own)))
    hi = np.append(lo[1:], len(of))
    for k, t in enumerate(own):
        i, j = lo[k], hi[k]
        spans = [(int(b0[q]), int(e0[q]), names[lang[cut[q]]]) for q in range(i, j)]
        if j - i == 1:
            main, share = spans[0][2], 1.0
        else:
            by = np.bincount(lang[cut[i:j]], weights=weight[i:j], minlength=score.shape[1])
            main, share = names[int(by.argmax())], float(by.max() / letters[k])
        out[t] = (main, share, float(good[k] / letters[k]), spans)
    return out


SCHEMA = "doc_id long, language string, share double, fit double, accepted boolean, spans array<struct<begin:int,end:int,language:string>>"


def _arrow(doc: list, rows: list[tuple], least: float) -> pa.RecordBatch:
    spans = [r[3] for r in rows]
    flat = [s for x in spans for s in x]
    off = np.zeros(len(spans) + 1, np.int32)
    np.cumsum([len(x) for x in spans], out=off[1:])
    struct = pa.StructArray.from_arrays(
        [pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.string())], ["begin", "end", "language"]
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc, pa.int64()),
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([round(r[1], 6) for r in rows], pa.float64()),
            pa.array([round(r[2], 6) for r in rows], pa.float64()),
            pa.array([r[0] is not None and r[2] >= least for r in rows], pa.bool_()),
            pa.ListArray.from_arrays(pa.array(off, pa.int32()), struct),
        ],
        ["doc_id", "language", "share", "fit", "accepted", "spans"],
    )


def train(docs: DataFrame, rows_a_language: int = TRAIN_ROWS) -> Model:
    """Fits the scores on about ``rows_a_language`` whole texts of each value of ``lang``, chosen by a hash of doc_id.

    Only this fit is on a bounded sample, so its size doesn't depend on the table's.
    """
    base = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in base.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == lang) & (part < int((1 << 20) * min(1.0, rows_a_language / n)) + 1))
    return fit([(r[0], r[1]) for r in base.where(keep).select("lang", "text", "doc_id").orderBy("doc_id", "text").select("lang", "text").collect()])


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, least_fit: float = LEAST_WORDS_SHARE) -> DataFrame:
    """One row for each row of ``docs``: its main language, that language's share of the letters, the share of
    letters in words that fit the language labelled, whether the text is accepted, and the labelled spans.

    ``docs`` needs doc_id and text. A null, empty or letterless text has language
    null and no span and isn't accepted. A text's labels depend on it alone, so
    that equal texts get equal labels, repeated rows a row each; ties between languages go to the first by name; spans are
    in characters of the whole text. Other columns are ignored. An empty table
    gives no rows.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 65,536 bins x languages, whatever the data's size

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, text = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices(text, AT_ONCE):
                yield _arrow(doc[i:j], label(text[i:j], shared.value, penalty), least_fit)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_accepted(docs: DataFrame, model: Model, penalty: float = PENALTY, least_fit: float = LEAST_WORDS_SHARE) -> DataFrame:
    """The rows of ``docs`` whose text identify() accepts, with all their columns, whatever their names; decided row by row, without a join.

    A null, empty or letterless text goes; a very long one is labelled whole;
    repeated rows stay or go together. An empty table gives no rows.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [t or "" for t in b.column(at).to_pylist()]
            ok = []
            for i, j in slices(text, AT_ONCE):
                ok += [r[0] is not None and r[2] >= least_fit for r in label(text[i:j], shared.value, penalty)]
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
