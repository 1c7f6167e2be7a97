"""Toxicity of text behind leetspeak, spacing and repetition.

A noisy channel: what was written comes from clean letters by substitution
(1 for i), by separators between letters and by repeated letters. Each stretch
that could hold a lexicon entry (see ``Gate``) is a lattice of the letters it may
stand for; Viterbi finds the best path under a character 4-gram model of the whole corpus and the channel's costs.
Toxic words, learnt from labelled documents, are then sought in the text as
written and in what was restored, and their weights give a calibrated score.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystrata.llm.common import code_points, labelled, lean, slices, tune

LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c",
}
SEPARATORS = " .-_*~,·"
SUBSTITUTE, DROP_SEPARATOR, DROP_REPEAT, KEEP_REPEAT = 1.5, 0.5, 0.3, 0.7  #: channel costs in nats
TRAIN_ROWS = 4000  #: labelled rows of each class, about, that the lexicon and the calibration are fitted on
ALPHABET = 27  #: letters folded to a-z, and the word boundary
MOST_RUN = 4  #: of a letter or sign repeated more often, apart or not, so many are decoded
MOST_MEMO = 256  #: characters of a stretch whose result is kept
_RUN = re.compile(r"([^\W_]|[" + re.escape("".join(c for c in LEET if not c.isalnum())) + r"])(?:([" + re.escape(SEPARATORS) + r"]*)\1){" + str(MOST_RUN) + ",}")


# ------------------------------------------------------------- character model


@functools.cache
def fold_table() -> np.ndarray:
    """Code point -> 1..26 for a letter with that base letter, 0 for a boundary; other letters as boundary."""
    t = np.zeros(0x110000, np.uint8)
    for i in range(0x2000):
        base = unicodedata.normalize("NFKD", chr(i).lower())[:1]
        if "a" <= base <= "z":
            t[i] = ord(base) - 96
    t[ord("ß")] = 19
    return t


def _grams(texts: list[str]) -> np.ndarray:
    """Codes of the 4-grams of folded characters, boundaries run together."""
    cps, _ = code_points(texts)
    c = fold_table()[cps]
    c = c[(c > 0) | np.append(True, c[:-1] > 0)].astype(np.int64)
    c = np.concatenate([[0, 0, 0], c])
    return ((c[:-3] * ALPHABET + c[1:-2]) * ALPHABET + c[2:-1]) * ALPHABET + c[3:]


@lean


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ALPHABET**4, np.int64)
    for b in batches:
        text = [t or "" for t in b.column(0).to_pylist()]
        for i, j in slices(text):
            total += np.bincount(_grams(text[i:j]), minlength=ALPHABET**4)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["gram", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """-log P(character | three before) from the 4-grams of every document. At most 27^4 counts reach the driver."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ALPHABET**4)
    for r in rows:
        counts[r[0]] = r[1]
    return model_of(counts)


def model_of(counts: np.ndarray) -> np.ndarray:
    """Witten-Bell style interpolation of the orders 1 to 4."""
    c4 = counts.reshape([ALPHABET] * 4)
    p = np.full(ALPHABET, 1 / ALPHABET)
    for c in (c4.sum((0, 1, 2)), c4.sum((0, 1)), c4.sum(0), c4):
        types = (c > 0).sum(-1, keepdims=True)
        p = (c + (types + 1) * p) / (c.sum(-1, keepdims=True) + types + 1)
    return -np.log(p).astype(np.float32).reshape(-1)


# -------------------------------------------------------------------- decoding


def lattice(s: str) -> list[list[tuple[int, float]]]:
    """For each character the (symbol, cost) it may stand for; symbol -1: nothing."""
    fold = fold_table()
    out = []
    before = None
    for i, ch in enumerate(s):
        code = int(fold[ord(ch)])
        if code:
            opts = [(code, KEEP_REPEAT if code == before else 0.0)]
            if code == before:
                opts.append((-1, DROP_REPEAT))
            before = code
        elif ch in LEET:
            codes = [ord(x) - 96 for x in LEET[ch]]
            opts = [(k, SUBSTITUTE) for k in codes] + [(0, 0.0)]
            if before in codes:
                opts.append((-1, DROP_REPEAT))
            before = codes[0]
        else:
            opts = [(0, 0.0)]
            if ch in SEPARATORS:
                opts.append((-1, DROP_SEPARATOR))
        out.append(opts)
    return out


def restore(s: str, lm: np.ndarray) -> str:
    """The best path of the lattice of ``s`` under the character model, boundaries as spaces. Ties go to the option listed first."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # last three symbols -> cost, path
    cube = ALPHABET**3
    for opts in [*lattice(s), [(0, 0.0)]]:
        nxt: dict[int, tuple[float, tuple | None]] = {}
        for st, (cost, path) in states.items():
            for sym, price in opts:
                if sym < 0 or (sym == 0 and st % ALPHABET == 0):
                    to, c, p = st, cost + price, path
                else:
                    g = st * ALPHABET + sym
                    to, c, p = g % cube, cost + price + float(lm[g]), (path, sym)
                if to not in nxt or c < nxt[to][0]:
                    nxt[to] = (c, p)
        states = nxt
    path = min(states.values(), key=lambda x: x[0])[1]
    out = []
    while path is not None:
        path, sym = path
        out.append(chr(sym + 96) if sym else " ")
    return "".join(reversed(out)).strip()


@functools.cache
def skeleton_table() -> np.ndarray:
    """Code point -> 0 always a boundary, 1..26 a letter or sign, letters that one sign may stand for alike, 27 a separator."""
    alike = np.arange(ALPHABET, dtype=np.uint8)
    for codes in LEET.values():
        own = [alike[ord(x) - 96] for x in codes]
        alike[np.isin(alike, own)] = min(own)
    t = alike[fold_table()]
    for ch, codes in LEET.items():
        t[ord(ch)] = alike[ord(codes[0]) - 96]
    for ch in SEPARATORS:
        t[ord(ch)] = ALPHABET
    return t


class Gate:
    """Finds where the lattice may hold lexicon entries: without separators, with repeats as one letter, and with letters that one sign may stand for alike, an entry is there."""

    def __init__(self, weights: Iterable[str]):
        by: dict[str, list[tuple[str, bool]]] = defaultdict(list)
        for w in weights:
            stem = _fold(w.rstrip("*"))
            if stem and all("a" <= c <= "z" for c in stem):
                k = skeleton_table()[[ord(c) for c in stem]]
                by["".join(chr(c + 96) for c in k[np.append(True, k[1:] != k[:-1])])].append((w, w.endswith("*")))
        self.auto = ahocorasick.Automaton()
        for key, own in by.items():
            self.auto.add_word(key, (len(key), own))
        self.empty = not by
        if by:
            self.auto.make_automaton()

    def stretches(self, texts: list[str], known: list[set[str]] | None = None) -> list[tuple[int, str]]:
        """(text, stretch) of what must be decoded: the words around each place; entries that are ``known`` in a text aren't sought in it.

        Letters set apart are one stretch, with all next to them that are apart too.
        """
        if self.empty:
            return []
        cps, at = code_points(texts)
        k = skeleton_table()[cps]
        place = np.flatnonzero(k != ALPHABET)
        v = k[place]
        head = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (v[1:] == 0)))
        first, last = place[head], place[np.append(head[1:], len(place)) - 1]
        # Before an entry, and after a whole word, something must be able to be a boundary.
        other = np.append(0, np.cumsum(fold_table()[cps] == 0))
        line = (v[head] + 96).tobytes().decode("latin-1")
        spans = set()
        for e, (size, own) in self.auto.iter(line):
            b = e - size + 1
            if b and other[last[b] + 1] == other[first[b - 1]]:
                continue
            whole = other[first[e + 1] + 1] > other[first[e]]
            if not any(begins or whole for _, begins in own):
                continue
            t = int(np.searchsorted(at, first[b], "right")) - 1
            if known is None or any((begins or whole) and w not in known[t] for w, begins in own):
                # The entry may begin and end at any repeat of its edge letters.
                spans |= {(t, x, y) for x in {int(first[b]), int(last[b])} for y in {int(first[e]), int(last[e])} if x <= y}
        if not spans:
            return []
        text, begin, end = np.array(sorted(spans)).T
        begin, end = _around(cps, begin, end)
        return [(t, _RUN.sub(lambda m: m[1] + (m[2] + m[1]) * (MOST_RUN - 1), texts[t][b:e])) for t, b, e in sorted(set(zip(text.tolist(), (begin - at[text]).tolist(), (end - at[text]).tolist())))]


@functools.cache
def _blank() -> np.ndarray:
    """Code point -> white space, or 0."""
    t = np.zeros(0x110000, bool)
    for i in range(0x3001):
        t[i] = i == 0 or chr(i).isspace()
    return t


def _around(cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words from that at ``begin`` to that at ``end``; a word of one character brings all those beside it."""
    blank = _blank()[cps]
    edge = np.flatnonzero(np.diff(~blank, prepend=False, append=False))
    b, e = edge[0::2], edge[1::2]
    lone = e - b == 1
    line = np.append(0, np.cumsum(blank & (cps != 32)))
    link = np.zeros(len(b) + 1, bool)
    link[1:-1] = lone[1:] & lone[:-1] & (line[b[1:]] == line[e[:-1]])
    n = np.arange(len(b))
    left = np.maximum.accumulate(np.where(link[:-1], 0, n))
    right = np.minimum.accumulate(np.where(link[1:], len(b), n)[::-1])[::-1]
    return b[left[np.searchsorted(b, begin, "right") - 1]], e[right[np.searchsorted(b, end, "right") - 1]]


# --------------------------------------------------------------------- scoring


@dataclass
class Model:
    """Toxic words and word beginnings (marked by a trailing *) with weights; calibration; the character model."""

    weights: dict[str, float]
    slope: float
    offset: float
    threshold: float
    lm: np.ndarray = field(repr=False)


def _fold(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w.replace("ß", "s")) if not unicodedata.combining(c))


class Matcher:
    """Finds lexicon entries in lower-cased text."""

    def __init__(self, weights: dict[str, float], folded: bool = False):
        self.words: dict[str, tuple[str, bool]] = {}
        for w in weights:
            stem = w.rstrip("*")
            self.words[_fold(stem) if folded else stem] = (w, w.endswith("*"))
        self.auto = ahocorasick.Automaton()
        for s, (w, begins) in self.words.items():
            self.auto.add_word(s, (len(s), w, begins))
        if self.words:
            self.auto.make_automaton()

    def find(self, text: str) -> set[str]:
        if not self.words:
            return set()
        out, n = set(), len(text)
        for e, (size, w, begins) in self.auto.iter(text):
            b = e - size
            if (b < 0 or not text[b].isalnum()) and (begins or e + 1 >= n or not text[e + 1].isalnum()):
                out.add(w)
        return out


def _contexts(rows: list[tuple[int, str]]) -> tuple[dict, dict, dict, int]:
    """In how many toxic texts, or after how many words if fewer, each word is, and in how many clean ones; the words with each beginning; the clean texts.

    A toxic text half of whose word pairs earlier ones had is a copy and doesn't count.
    """
    word = re.compile(r"[^\W\d_]+")
    after: dict[str, set] = defaultdict(set)
    texts: dict[str, int] = defaultdict(int)
    clean: dict[str, int] = defaultdict(int)
    stems: dict[str, set] = defaultdict(set)
    pairs: set = set()
    n = 0
    for y, t in rows:
        ws = word.findall(t.lower())
        own = set(ws)
        if y:
            two = set(zip(["", *ws], ws))
            if 2 * len(two & pairs) > len(two):
                continue
            pairs |= two
            for p, w in two:
                after[w].add(p)
            for w in own:
                texts[w] += 1
        else:
            n += 1
            for w in own:
                clean[w] += 1
            for s in {w[:k] for w in own for k in (4, 5, 6) if len(w) >= k}:
                clean[s + "*"] += 1
    seen = {w: min(c, len(after[w])) for w, c in texts.items()}
    for w in seen:
        if not clean.get(w):
            for k in (4, 5, 6):
                if len(w) > k:
                    stems[w[:k]].add(w)
    return seen, clean, stems, n


def lexicon(rows: list[tuple[int, str]], least: int = 3, ratio: float = 20.0) -> dict[str, float]:
    """Weights (log odds) of words that toxic texts have far more often than clean ones.

    A word counts once for each word it follows, and copies of a text not at all,
    so that copying can't make its words toxic. A word beginning counts if at
    least three times ``least`` words that no clean text has begin with it.
    """
    seen, clean, stems, n = _contexts(rows)
    tox = max(1, sum(1 for y, _ in rows if y))
    n = max(1, n)
    out = {}
    for w, c in seen.items():
        if c >= least and len(w) > 2:
            odds = math.log((c + 0.5) / (tox + 1)) - math.log((clean.get(w, 0) + 0.5) / (n + 1))
            if odds >= math.log(ratio):
                out[w] = odds
    for s, ws in stems.items():
        c = sum(seen[w] for w in ws)
        if len(ws) >= 3 * least and c >= 12 * least and not clean.get(s + "*"):
            if any(len(s) > k and s[:k] + "*" in out for k in (4, 5)):
                continue
            odds = math.log((c + 0.5) / (tox + 1)) - math.log(0.5 / (n + 1))
            if odds >= math.log(ratio):
                out[s + "*"] = odds
    return out


def fit(rows: list[tuple[int, str]], lm: np.ndarray) -> Model:
    """A model from (toxic 0 or 1, text) rows: three of four give the lexicon, the others calibrate the score. Without both classes nothing is toxic."""
    from polystrata.llm.quality import _logistic

    rows = [(y, t) for y, t in rows if t]
    if len({y for y, _ in rows}) < 2:
        return Model({}, 0.0, -30.0, 0.5, lm)
    tox, clean = ([r for r in rows if r[0] == y] for y in (1, 0))
    weights = lexicon([r for k, r in enumerate(tox) if k % 4] + [r for k, r in enumerate(clean) if k % 4])
    m = Matcher(weights)
    held = tox[0::4] + clean[0::4]
    x = np.array([sum(weights[w] for w in m.find(t.lower())) for _, t in held])
    y = np.array([y for y, _ in held])
    a, b = _logistic(x, y)
    return Model(weights, float(a), float(b), 0.5, lm)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The character model from all of ``docs``; lexicon and calibration from about ``rows`` labelled texts of each class."""
    got = sorted(((r[0], r[1], r[2] or "") for r in labelled(docs, labels, "toxic", rows).collect()), key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFF, r[2]))
    return fit([(y, t) for _, y, t in got], language_model(docs))


class Scorer:
    def __init__(self, m: Model):
        self.m, self.plain, self.folded, self.gate, self.memo = m, Matcher(m.weights), Matcher(m.weights, True), Gate(m.weights), {}

    def _restored(self, s: str) -> frozenset:
        if (got := self.memo.get(s)) is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            # Other accents alone hide nothing.
            got = frozenset(self.folded.find(restore(s, self.m.lm)) - self.folded.find(_fold(s.lower())))
            if len(s) <= MOST_MEMO:
                self.memo[s] = got
        return got

    def score(self, texts: list[str]) -> list[tuple[float, list[str], list[str]]]:
        """(probability, entries in the text as written, further entries in what was restored) of each text."""
        plain = [self.plain.find(t.lower()) for t in texts]
        more: list[set] = [set() for _ in texts]
        for t, s in self.gate.stretches(texts, plain):
            more[t] |= self._restored(s) - plain[t]
        out = []
        for p, r in zip(plain, more):
            x = sum(self.m.weights[w] for w in p | r)
            z = max(-30.0, min(30.0, self.m.slope * x + self.m.offset))
            out.append((1 / (1 + math.exp(-z)) if p or r else 0.0, sorted(p), sorted(r)))
        return out


SCHEMA = "doc_id long, score double, words array<string>, restored array<string>"


def toxic_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, words, restored) of the documents whose score reaches the threshold: lexicon entries found as written, and those found only once restored.

    ``docs`` needs doc_id and text. A null, empty or clean text gives no row.
    Equal texts score alike, repeated rows give a row each; a score at the
    threshold is toxic. The whole of a long text counts. Other columns are
    ignored. An empty table gives no rows.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 27^4 floats and the lexicon, whatever the data's size

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        for b in batches:
            doc, text = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            rows = []
            for i, j in slices(text):
                rows += [(d, *r) for d, r in zip(doc[i:j], scorer.score(text[i:j])) if r[0] >= m.threshold]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())))], ["doc_id", "score", "words", "restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
