"""Compression quality classifier: zstandard dictionaries built from good and from
bad labelled text; the normalised difference of the compressed sizes becomes a
calibrated score.

A text is compressed in blocks, so that the dictionary counts as much for the
end of a long text as for a short one; every block of the whole text counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystrata.llm.common import labelled, lean, tune

BLOCK = 2048  #: bytes compressed at once
DICT_BYTES = 1 << 18
PIECE = 64  #: bytes, about, of a piece of a long text in a dictionary
LEVEL = 6
PRIOR_BYTES = 100  #: a text counts as having so many bytes more, of the good texts' median difference: a few words show little
TRAIN_ROWS = 3000  #: labelled rows of each class, about, that dictionaries and calibration are fitted on
KEEP_GOOD = 0.995  #: share of held-out good rows that the threshold keeps


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    prior: float
    slope: float
    offset: float
    threshold: float


class Compressor:
    """Compressed sizes of texts under both dictionaries of a model."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._dict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in (good, bad)]

    @staticmethod
    def _dict(data: bytes) -> zstandard.ZstdCompressionDict:
        d = zstandard.ZstdCompressionDict(data or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return d

    def sizes(self, text: str) -> tuple[int, int]:
        """By how many bytes the bad dictionary compresses worse than the good one, and the bytes of the text."""
        raw = text.encode("utf-8", "surrogatepass")
        more = 0
        g, b = self.by
        for i in range(0, len(raw), BLOCK):
            part = raw[i : i + BLOCK]
            more += len(b(part)) - len(g(part))
        return more, len(raw)


def normalised(more: float, size: float, prior: float) -> float:
    """The difference a byte, drawn towards ``prior`` by PRIOR_BYTES."""
    return (more + PRIOR_BYTES * prior) / (size + PRIOR_BYTES)


def _share(sizes: list[int]) -> int:
    """The most bytes of each text with which all fit in DICT_BYTES."""
    left = DICT_BYTES
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return max(1, left // (len(sizes) - k))
        left -= n
    return DICT_BYTES


def _dictionary(texts: list[str]) -> bytes:
    """Raw content from all distinct texts, an even share of DICT_BYTES each: a whole text, or pieces of about PIECE bytes from equal parts of all of it, at hashed places."""
    raw = list(dict.fromkeys(t.encode("utf-8", "surrogatepass") for t in texts))
    share = _share([len(t) for t in raw])
    parts = []
    for t in raw:
        if len(t) <= share:
            parts.append(t)
            continue
        m = max(1, share // PIECE)
        for j in range(m):
            size = share * (j + 1) // m - share * j // m
            begin, end = len(t) * j // m, len(t) * (j + 1) // m
            at = min(begin + xxhash.xxh64_intdigest(t, j) % max(1, end - begin - size + 1), len(t) - size)  # a text hardly longer than its share has parts of less than a piece
            parts.append(t[at : at + size])
    return b"".join(reversed(parts))[-DICT_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt scaling by Newton steps, with Platt's smoothed targets; classes weigh alike."""
    pos, neg = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.where(y > 0, 0.5 / pos, 0.5 / neg) * len(y)
    s = float(x.std()) or 1.0
    z = x / s
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(w * (p - t) * z).sum() + 1e-3 * a, (w * (p - t)).sum()])
        h = w * p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        d = np.linalg.solve(m, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-9:
            break
    return a / s, b


def fit(rows: list[tuple[int, str]]) -> Model:
    """A model from (quality 0 or 1, text) rows: half make the dictionaries, the other half calibrate the score and set the threshold.

    With a class missing, every text is kept.
    """
    by = {q: [t for k, t in rows if k == q and t] for q in (0, 1)}
    if min(len(by[0]), len(by[1])) < 4:
        return Model(b"", b"", 0.0, 0.0, 0.0, 0.0)
    good, bad = _dictionary(by[1][0::2]), _dictionary(by[0][0::2])
    c = Compressor(good, bad)
    more, size = np.array([c.sizes(t) for q in (0, 1) for t in by[q][1::2]], float).T
    y = np.array([q for q in (0, 1) for _ in by[q][1::2]])
    prior = float(np.median(more[y > 0] / size[y > 0]))
    x = normalised(more, size, prior)
    a, b = _logistic(x, y)
    score = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
    threshold = min(0.5, float(np.quantile(score[y > 0], 1 - KEEP_GOOD)))
    return Model(good, bad, prior, float(a), float(b), threshold)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits on about ``rows`` labelled texts of each class, whatever the table's size."""
    got = [(r[0], r[1], r[2] or "") for r in labelled(docs, labels, "quality", rows).collect()]
    return fit([(q, t) for _, q, t in sorted(got, key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFF, r[2]))])


def _scorer(model: Model):
    made: list[Compressor] = []

    def score(text: str | None) -> tuple[float, float]:
        if not made:
            made.append(Compressor(model.good, model.bad))
        d = normalised(*made[0].sizes(text or ""), model.prior)
        return d, float(1 / (1 + np.exp(-np.clip(model.slope * d + model.offset, -30, 30))))

    return score


SCHEMA = "doc_id long, difference double, score double, keep boolean"


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``: the normalised difference, the calibrated probability of good quality, and whether it reaches the threshold.

    ``docs`` needs doc_id and text. A null or empty text has difference and score
    0 and isn't kept. Equal texts get equal scores, repeated rows a row each, and
    a score at the threshold is kept. The whole of a long text counts. Other
    columns are ignored. An empty table gives no rows.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICT_BYTES

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        score = _scorer(m)
        for b in batches:
            text = b.column(1).to_pylist()
            got = [score(t) if t else (0.0, 0.0) for t in text]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got]), pa.array([bool(t) and g[1] >= m.threshold for t, g in zip(text, got)], pa.bool_())], ["doc_id", "difference", "score", "keep"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that classify() keeps, with all their columns."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        score = _scorer(m)
        for b in batches:
            yield b.filter(pa.array([bool(t) and score(t)[1] >= m.threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
