"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type vocabulary gives every pair of pieces whose concatenation is a
piece, and the piece's score is the merge's priority. An agenda merges the best
pair, the leftmost of equal ones, until none is left; a candidate whose keyed
hash of (seed, document, where its two parts begin and end) is below the dropout
rate is skipped for good. The hash makes a segmentation depend on nothing but
the seed, the document and the place in its text.

No piece has a word mark inside, so that the agenda of each word is its own.
Words of equal length are merged together, one merge of each word at a time, as
rows of a matrix; very long words use a heap.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystrata.llm.common import code_points, lean, mix, slices, tune

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 11
_NONE = np.int32(2**31 - 1)
_MARK = 0x2581
_LONG = 192  #: symbols from which a word is merged with a heap


class Vocabulary:
    """The pieces of a SentencePiece model with merges and byte fallback, as arrays."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        plain = {}
        self.byte0 = -1
        chunks = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                if p == "<0x00>":
                    self.byte0 = i
                chunks.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                chunks.append(b"")
            else:
                plain[p] = i
                chunks.append(p.replace("▁", " ").encode())
        if self.byte0 < 0:
            raise ValueError(f"{path} has no byte fallback")
        self.lens = np.array([len(c) for c in chunks], np.int64)
        self.at = np.append(0, np.cumsum(self.lens))[:-1]
        self.bytes = np.frombuffer(b"".join(chunks), np.uint8)
        self.char = np.zeros(0x110000, np.int32) - np.arange(1, 0x110001, dtype=np.int32)  # -(code point + 1): not a piece
        for p, i in plain.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[_MARK] = -(_MARK + 1)  # a mark in a text isn't a space: it goes through bytes
        self.mark = plain["▁"]
        # Priority of a merge: rank of its piece by score, best first, then by id.
        order = sorted(plain.values(), key=lambda i: (-sp.get_score(i), i))
        rank = np.full(n, _NONE, np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.of_rank = np.array(order, np.int32)
        keys, vals = [], []
        for p, i in plain.items():
            if "▁" in p.lstrip("▁"):
                raise ValueError(f"piece {p!r} has a word mark inside")
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    vals.append(rank[i])
        k, v = np.array(keys, np.uint64), np.array(vals, np.int32)
        bits = max(8, int(len(k) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.key = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.val = np.full(1 << bits, _NONE, np.int32)
        self.probes = 0
        left = np.arange(len(k))
        while len(left):
            slot = (self._slot(k[left]) + np.uint64(self.probes)) & self.mask
            _, one = np.unique(slot, return_index=True)
            one = one[self.val[slot[one]] == _NONE]
            self.key[slot[one]], self.val[slot[one]] = k[left[one]], v[left[one]]
            left = np.delete(left, one)
            self.probes += 1

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return (k * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of pieces, or none."""
        k = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(k)
        found = self.key[slot]
        out = np.where(found == k, self.val[slot], _NONE)
        rest = np.flatnonzero((found != k) & (self.val[slot] != _NONE))
        for p in range(1, self.probes):
            if not len(rest):
                break
            s = (slot[rest] + np.uint64(p)) & self.mask
            f = self.key[s]
            hit = f == k[rest]
            out[rest[hit]] = self.val[s[hit]]
            rest = rest[~hit & (self.val[s] != _NONE)]
        return out


@functools.cache
def vocabulary(path: str = MODEL) -> Vocabulary:
    return Vocabulary(path)


def doc_keys(ids: list, seed: int) -> np.ndarray:
    """What a document's dropout hash starts from; a null doc_id is as 0."""
    k = np.array([(i or 0) & (2**64 - 1) for i in ids], np.uint64)
    return mix(mix(k + np.uint64(1)) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def _kept(key, begin, middle, end, limit: np.uint64):
    """Whether candidate merges survive dropout. Places count from the word's begin, which is part of the key."""
    h = (key + begin.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (middle.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) ^ (end.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) >= limit


def _heap(v: Vocabulary, sym: np.ndarray, key: np.uint64, limit: np.uint64) -> np.ndarray:
    """Agenda of one long word."""
    n = len(sym)
    ids = sym.tolist()
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    drop = int(limit) > 0

    def ranks(left: list[int]) -> list[int]:
        a = np.array(left)
        b = np.array([nxt[i] for i in left])
        r = v.merges(np.array([ids[i] for i in a]), np.array([ids[i] for i in b]))
        if drop:
            r = np.where(_kept(np.full(len(a), key), a, b, np.array([end[i] for i in b]), limit), r, _NONE)
        return r.tolist()

    first = list(range(n - 1))
    heap = [(r, i, i + 1, i + 2) for i, r in zip(first, ranks(first)) if r != _NONE] if first else []
    heapq.heapify(heap)
    dead = bytearray(n)
    while heap:
        r, i, j, e = heapq.heappop(heap)
        if dead[i] or nxt[i] != j or j >= n or dead[j] or end[j] != e:
            continue
        ids[i] = int(v.of_rank[r])
        dead[j] = 1
        end[i] = e
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        near = [x for x in (prv[i], i) if x >= 0 and nxt[x] < n]
        if near:
            for x, rr in zip(near, ranks(near)):
                if rr != _NONE:
                    heapq.heappush(heap, (rr, x, nxt[x], end[nxt[x]]))
    return np.array([x for x, d in zip(ids, dead) if not d], np.int32)


def _merge(v: Vocabulary, ids: np.ndarray, key: np.ndarray, limit: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merges words of equal length, the rows of ``ids``; gives (rows, their pieces) as they end."""
    n, m = ids.shape
    row = np.arange(n)
    at = np.broadcast_to(np.arange(m + 1, dtype=np.int32), (n, m + 1))
    drop = int(limit) > 0

    def ranks(left, right, k, b, mid, e):
        r = v.merges(left, right)
        if drop:
            has = np.flatnonzero(r != _NONE)
            bad = has[~_kept(k[has], b[has], mid[has], e[has], limit)]
            r[bad] = _NONE
        return r

    if m > 1:
        k2 = np.repeat(key, m - 1)
        R = ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel(), k2, at[:, :-2].ravel(), at[:, 1:-1].ravel(), at[:, 2:].ravel()).reshape(n, m - 1)
    while m > 1 and len(row):
        j = R.argmin(1)
        best = np.take_along_axis(R, j[:, None], 1)[:, 0]
        go = best != _NONE
        if not go.all():
            yield row[~go], ids[~go]
            row, ids, at, R, key, j, best = row[go], ids[go], at[go], R[go], key[go], j[go], best[go]
            if not len(row):
                return
        n = len(row)
        me = np.arange(n)
        c = np.arange(m - 1)
        past = c[None, :] > j[:, None]
        ids = np.where(past, ids[:, 1:], ids[:, :-1])
        ids[me, j] = v.of_rank[best]
        at = np.where(np.arange(m)[None, :] > j[:, None], at[:, 1:], at[:, :-1])
        m -= 1
        if m == 1:
            break
        R = np.where(past[:, : m - 1], R[:, 1:], R[:, :-1])
        for d in (-1, 0):  # the pairs before and after the merged piece are new
            w = np.flatnonzero(j + d >= 0) if d else np.flatnonzero(j < m - 1)
            q = j[w] + d
            R[w, q] = ranks(ids[w, q], ids[w, q + 1], key[w], at[w, q], at[w, q + 1], at[w, q + 2])
    if len(row):
        yield row, ids


def encode_batch(v: Vocabulary, texts: list[str], keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after another, and the offset of each text (one more at the end). An empty text has no pieces."""
    limit = np.uint64(min(2**64 - 1, int(dropout * 2**64))) if dropout > 0 else np.uint64(0)
    # A mark takes the place of the separator before each text.
    cps, at = code_points(["", *texts])
    cps, at = cps[:-1], at[1:]
    sym = v.char[cps]
    sym[cps == 32] = v.mark
    sym[at - 1] = v.mark
    size = np.diff(np.append(at, len(cps) + 1)) - 1
    for i in np.flatnonzero(size == 0):
        sym[at[i] - 1] = _NONE  # nothing of an empty text
    mark = sym == v.mark
    start = mark.copy()
    start[1:] &= ~mark[:-1]
    start[at - 1] = True
    begin = np.flatnonzero(start)
    length = np.diff(np.append(begin, len(sym)))
    doc = np.searchsorted(at - 1, begin, "right") - 1
    key = mix(keys[doc] + begin.astype(np.uint64) - (at[doc] - 1).astype(np.uint64)) if limit else np.zeros(len(begin), np.uint64)
    count = np.zeros(len(begin), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.diff(length[order], prepend=-1))
    for i, j in zip(cut, np.append(cut[1:], len(order))):
        w = order[i:j]
        m = int(length[w[0]])
        if m > _LONG:
            for x in w:
                out = _heap(v, sym[begin[x] : begin[x] + m], key[x], limit)
                count[x] = len(out)
                done.append((np.array([x]), out[None, :]))
            continue
        step = max(1, (1 << 18) // m)
        for s in range(0, len(w), step):
            part = w[s : s + step]
            for r, ids in _merge(v, sym[begin[part][:, None] + np.arange(m)], key[part], limit):
                count[part[r]] = ids.shape[1]
                done.append((part[r], ids))
    count[sym[begin] == _NONE] = 0
    off = np.append(0, np.cumsum(count))
    flat = np.empty(off[-1], np.int32)
    for w, ids in done:
        w2 = count[w] > 0
        if w2.any():
            flat[off[w[w2]][:, None] + np.arange(ids.shape[1])] = ids[w2]
    ends = off[np.searchsorted(begin, np.append(at - 1, len(sym)))]
    # Characters that are no piece become their UTF-8 bytes.
    odd = np.flatnonzero(flat < 0)
    if len(odd):
        cp = -flat[odd].astype(np.int64) - 1
        raw = "".join(map(chr, cp.tolist())).encode("utf-8", "surrogatepass")
        k = np.where(cp < 0x80, 1, np.where(cp < 0x800, 2, np.where(cp < 0x10000, 3, 4)))
        rep = np.ones(len(flat), np.int64)
        rep[odd] = k
        at2 = np.append(0, np.cumsum(rep))
        new = np.repeat(flat, rep)
        new[new < 0] = np.frombuffer(raw, np.uint8).astype(np.int32) + v.byte0
        return new, at2[ends]
    return flat, ends


def decode_bytes(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of a run of piece ids, word marks as spaces."""
    n = v.lens[ids]
    at = np.cumsum(n) - n
    return v.bytes[np.arange(int(n.sum())) + np.repeat(v.at[ids] - at, n)]


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text that was encoded: the first piece's mark isn't part of it."""
    return decode_bytes(v, np.array(ids, np.int64)).tobytes().decode("utf-8", "surrogatepass")[1:] if len(ids) else ""


SCHEMA = "doc_id long, ids array<int>, pieces int, lossless boolean"


def encode(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, pieces, lossless) for each row of ``docs``; lossless says that decoding gave the text again.

    ``docs`` needs doc_id and text. A null text has null ids and lossless true
    (there is nothing to lose), an empty one no ids. Rows with equal doc_id and
    text get equal ids; another seed or doc_id another segmentation. Ties between
    merges go to the leftmost. Very long texts and words are encoded whole. Other
    columns are ignored. An empty table gives no rows.
    """
    tune(docs.sparkSession, 500)

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            ident, text = b.column(0).to_pylist(), b.column(1).to_pylist()
            null = np.array([t is None for t in text], bool)
            text = [t or "" for t in text]
            for i, j in slices(text, 1 << 20):
                part = text[i:j]
                ids, off = encode_batch(v, part, doc_keys(ident[i:j], seed), dropout)
                want = "".join(" " + t if t else "" for t in part).encode("utf-8", "surrogatepass")
                got = decode_bytes(v, ids)
                if len(got) == len(want) and (got == np.frombuffer(want, np.uint8)).all():
                    fine = [True] * len(part)
                else:
                    fine = [decode(v, ids[a:e].tolist()) == t for a, e, t in zip(off[:-1], off[1:], part)]
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null[i:j]))
                yield pa.RecordBatch.from_arrays([pa.array(ident[i:j], pa.int64()), lists, pa.array(np.diff(off), pa.int32()), pa.array(fine, pa.bool_())], ["doc_id", "ids", "pieces", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decoded(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of a table that encode() gave; null ids give a null text."""
    tune(encoded.sparkSession, 500)

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            text = [None if x is None else decode(v, x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def brute_encode(v: Vocabulary, text: str, key: np.uint64, dropout: float) -> list[int]:
    """The same segmentation of one text by a plain scan for the best pair of its whole symbol list, for tests."""
    if not text:
        return []
    limit = np.uint64(min(2**64 - 1, int(dropout * 2**64)))
    sym = [v.mark] + [v.mark if c == " " else int(v.char[ord(c)]) for c in text]
    begin = [0]
    for i in range(1, len(sym)):
        begin.append(i if sym[i] == v.mark and sym[i - 1] != v.mark else begin[-1])
    parts = [(s, i, i + 1) for i, s in enumerate(sym)]
    while True:
        best = None
        for x, ((a, b0, b1), (c, _, c1)) in enumerate(zip(parts, parts[1:])):
            if begin[b0] != begin[c1 - 1]:
                continue
            r = int(v.merges(np.array([a]), np.array([c]))[0])
            if r == int(_NONE) or (best and r >= best[0]):
                continue
            o = begin[b0]
            k = mix(np.array([key + np.uint64(o)]))
            if int(limit) and not _kept(k, np.array([b0 - o]), np.array([b1 - o]), np.array([c1 - o]), limit)[0]:
                continue
            best = (r, x)
        if best is None:
            break
        r, x = best
        parts[x : x + 2] = [(int(v.of_rank[r]), parts[x][1], parts[x + 1][2])]
    out = []
    for s, _, _ in parts:
        out += [s] if s >= 0 else [v.byte0 + y for y in chr(-s - 1).encode("utf-8", "surrogatepass")]
    return out
