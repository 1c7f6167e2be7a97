"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

Equal texts are one class, for which its least doc_id stands. The incidence
matrix (representatives x word n-grams) is cut into column blocks by n-gram
hash. A column block finds each n-gram's document frequency and drops those in a
single document. A row then knows how many of its n-grams any other can share;
rows that can't reach the bound are discarded, and the rest keep a prefix of
their rarest shared n-grams, one of which both documents of a pair must have.

Columns of few rows give candidate pairs, whose counts of shared prefix columns
are added up; what can't reach the bound that the sizes set is discarded before
any full row is read. Rows of columns with many are put in blocks, each with
those that share a column with the same least row, and two blocks are multiplied
if they meet in a column, but only their rows that do. Candidates aren't closed
transitively, so chains of documents cost no more than their links. Products
give each row's number of links and what they connect it with, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polystrata.llm.common import BROADCAST_LIMIT, connected_components, free_shuffles, lean, materialize, ngram_hashes, packed, partitions, slices, tune

N, THRESHOLD = 3, 0.5
COLD = 24  #: rows of a prefix column up to which its pairs are candidates
BLOCK_ROWS, BLOCK_GRAMS = 512, 1 << 20  #: of a row block, about
COLUMN_GRAMS = 1 << 22  #: n-grams wanted in a column block, about
ROW_BYTES = 128  #: of a row of two keys, once broadcast
_HOT = 255  #: document frequencies are told apart up to here; order beyond is by hash
_MARK = np.uint64(0xFFFF)
_LOW = np.uint64(16)
_PACKED = "dest int, batch long, kind int, data binary"
_SCHEMA = pa.schema([("dest", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _planes(a: np.ndarray) -> bytes:
    """Byte planes of 64-bit keys: sorted keys share their high bytes, which then compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _keys(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def _incidence(n: int, blocks: int, most: int):
    """Map side: packs (n-gram, row) keys, sorted, by column block. A key is 48 bits of hash and 16 of row number in its batch."""

    def pack(number: int, ids: list[int], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        count = np.bincount((k & _MARK).astype(np.int64), minlength=len(ids))[: len(ids)]
        doc = np.array(ids, np.int64).tobytes() + count.astype(np.int64).tobytes()
        rows = [(number % blocks, number, 1, doc)]
        if len(k):
            h = k >> _LOW
            begin = np.flatnonzero(np.diff(h, prepend=h[0] ^ np.uint64(1)))
            runs = np.diff(np.append(begin, len(k)))
            if (runs >= _HOT).any():  # known to be frequent: its rows needn't travel, one mark does
                hot = np.repeat(runs >= _HOT, runs)
                rows.append((number % blocks, number, 2, _planes(k[hot])))
                k = np.sort(np.concatenate([k[~hot], (h[begin[runs >= _HOT]] << _LOW) | _MARK]))
            block = ((k >> _LOW) * np.uint64(blocks)) >> np.uint64(48)
            cut = np.flatnonzero(np.diff(block, prepend=block[0] + np.uint64(1)))
            for i, j in zip(cut, np.append(cut[1:], len(k))):
                rows.append((int(block[i]), number, 0, _planes(k[i:j])))
        for i in range(0, len(rows), 64):
            yield _batch(rows[i : i + 64])

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, keys, size = TaskContext.get().partitionId() << 14, [], [], 0
        for b in batches:
            doc, text = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices(text):
                if ids and (size >= most or len(ids) + j - i >= 0xFFFE):
                    yield from pack(number, ids, keys)
                    number, ids, keys, size = number + 1, [], [], 0
                h, d = ngram_hashes(text[i:j], n)
                keys.append(np.unique((h & ~_MARK) | (d + len(ids)).astype(np.uint64)))
                ids += doc[i:j]
                size += len(keys[-1])
        if ids:
            yield from pack(number, ids, keys)

    return run


@lean


def _columns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column block: document frequency of each n-gram; those of one document go, the others return to their row's batch."""
    keys, number = [], []
    for b in batches:
        for batch, kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if kind:
                yield _batch([(0, batch, kind, data)])
            else:
                keys.append(_keys(data))
                number.append(batch)
    if not keys:
        return
    src = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    k = np.concatenate(keys)
    keys.clear()
    order = np.argsort(k)
    k, src = k[order], src[order]
    h = k >> _LOW
    begin = np.flatnonzero(np.diff(h, prepend=h[0] ^ np.uint64(1)))
    runs = np.diff(np.append(begin, len(k)))
    df = np.minimum(runs, _HOT)
    mark = (k & _MARK) == _MARK
    df[np.add.reduceat(mark, begin, dtype=np.int64) > 0] = _HOT
    df = np.repeat(df, runs)
    keep = (df > 1) & ~mark
    k, src, df = k[keep], src[keep], df[keep].astype(np.uint8)
    order = np.argsort(src, kind="stable")
    k, src, df = k[order], src[order], df[order]
    cut = np.flatnonzero(np.diff(src, prepend=-1))
    for i, j in zip(cut, np.append(cut[1:], len(k))):
        yield _batch([(0, number[src[i]], 3, np.int64(j - i).tobytes() + _planes(k[i:j]) + df[i:j].tobytes())])


def _rows(threshold: float):
    """Row block: discards rows that can't reach the bound; the rest give the rarest of their shared n-grams as prefix, and the last of them in that order."""
    schema = pa.schema([("r", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("prefix", pa.list_(pa.int64())), ("grams", pa.binary())])

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: dict[int, bytes] = {}
        parts: dict[int, list] = {}
        for b in batches:
            for batch, kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if kind == 1:
                    doc[batch] = data
                elif kind == 2:
                    k = _keys(data)
                    parts.setdefault(batch, []).append((k, np.full(len(k), _HOT, np.uint8)))
                else:
                    m = int(np.frombuffer(data, np.int64, 1)[0])
                    parts.setdefault(batch, []).append((_keys(data[8 : 8 + 8 * m]), np.frombuffer(data, np.uint8, m, 8 + 8 * m)))
        for batch, raw in doc.items():
            ids, size = np.frombuffer(raw, np.int64).reshape(2, -1)
            if batch not in parts:
                continue
            k, df = (np.concatenate(x) for x in zip(*parts.pop(batch)))
            row = (k & _MARK).astype(np.int64)
            shared = np.bincount(row, minlength=len(ids))
            prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1 - (size - shared)
            keep = prefix[row] > 0
            k, df, row = k[keep], df[keep], row[keep]
            if not len(k):
                continue
            order = np.lexsort((k, df, row))
            h, row, df = (k[order] >> _LOW).astype(np.int64), row[order], df[order].astype(np.int64)
            begin = np.flatnonzero(np.diff(row, prepend=-1))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for i, j in zip(begin, np.append(begin[1:], len(h))):
                r = row[i]
                e = i + min(j - i, prefix[r])
                for c, x in zip(out, ((batch << 16) + int(r), ids[r], size[r], (df[e - 1] << 48) + h[e - 1], h[i:e], np.sort(h[i:j]).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())):
                    c.append(x)
                if len(out[0]) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)
                    out = ([], [], [], [], [], [])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return run


def needed(t: float, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The least overlap of sets of ``na`` and ``nb`` with a similarity of ``t``."""
    return np.ceil(t / (1 + t) * (na + nb) - 1e-9).astype(np.int64)


def _meet(t: float):
    """Pairs of rows in each column whose sizes allow the threshold, and how many prefix columns they must share.

    Of a pair, all that both have and that isn't in both prefixes is after the
    prefix that ends first in the common order.
    """

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0)
            off = rows.offsets.to_numpy()
            flat = rows.flatten()
            r, n, last = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("r", "n", "last"))
            end = np.repeat(off[1:] - off[0], np.diff(off))
            at = np.arange(len(r))
            after = np.ceil(t * n - 1e-9).astype(np.int64) - 1
            for k in range(1, int(np.diff(off).max(initial=0))):
                i = np.flatnonzero(at + k < end)
                j = i + k
                ok = np.minimum(n[i], n[j]) >= t * np.maximum(n[i], n[j]) - 1e-9
                i, j = i[ok], j[ok]
                need = needed(t, n[i], n[j]) - np.where(last[i] <= last[j], after[i], after[j])
                for x in range(0, len(i), 200_000):
                    p, q = r[i[x : x + 200_000]], r[j[x : x + 200_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(need[x : x + 200_000].astype(np.int32))], ["a", "b", "need"])

    return run


def _grams(x: bytes) -> np.ndarray:
    a = np.zeros((len(x) // 6, 8), np.uint8)
    a[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return a.view("<i8").ravel()


def _similar(o: np.ndarray, na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    return o / np.maximum(na + nb - o, 1) >= t - 1e-12


def _verify(t: float):
    """The candidate pairs that reach the threshold. Columns: two rows, two sizes, their n-grams."""

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, na, nb = (b.column(k).to_numpy() for k in range(4))
            o = np.zeros(len(a), np.int64)
            for k, (x, y) in enumerate(zip(b.column(4), b.column(5))):
                z = np.sort(np.concatenate([_grams(x.as_py()), _grams(y.as_py())]), kind="stable")
                o[k] = np.count_nonzero(z[1:] == z[:-1])
            ok = _similar(o, na, nb, t)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], ["a", "b"])

    return run


def overlaps(rows: list[np.ndarray], dense_from: int = 32) -> np.ndarray:
    """Rows x rows counts of shared columns: frequent columns by dense slabs, the others by shifts within a column."""
    m = len(rows)
    r = np.repeat(np.arange(m), [len(x) for x in rows])
    c = np.concatenate(rows)
    order = np.argsort(c, kind="stable")
    c, r = c[order], r[order]
    begin = np.flatnonzero(np.diff(c, prepend=c[0] - 1)) if len(c) else np.zeros(0, np.int64)
    runs = np.diff(np.append(begin, len(c)))
    acc = np.zeros((m, m), np.float32)
    heavy = np.flatnonzero(runs > dense_from)
    for s in range(0, len(heavy), 2048):
        part = heavy[s : s + 2048]
        x = np.zeros((m, len(part)), np.float32)
        for q, i in enumerate(part):
            x[r[begin[i] : begin[i] + runs[i]], q] = 1
        acc += x @ x.T
    acc = np.rint(acc).astype(np.int64)
    light = np.repeat((runs > 1) & (runs <= dense_from), runs)
    r, c = r[light], c[light]
    found = []
    for k in range(1, dense_from):
        same = np.flatnonzero(c[k:] == c[:-k]) if k < len(c) else ()
        if not len(same):
            break
        found.append(r[same] * m + r[same + k])
    if found:
        acc += np.bincount(np.concatenate(found), minlength=m * m).reshape(m, m)
    return np.triu(np.maximum(acc, acc.T), 1)


def _roots(near: np.ndarray) -> np.ndarray:
    """The least row that each row is connected with."""
    root = np.arange(len(near))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(near)).min(1))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _multiply(threshold: float):
    """Multiplies row blocks: rows come sorted by block pair. Columns: b1, b2, row, n, weight, the row's own block, n-grams. Gives (row, weight of the rows linked with it, a row that links connect it with)."""

    def product(key: tuple, got: list[tuple]) -> Iterator[pa.RecordBatch]:
        r, n, weight, own = (np.array(x, np.int64) for x in zip(*[g[:4] for g in got]))
        o = overlaps([_grams(g[4]) for g in got])
        o = o + o.T
        near = _similar(o, n[:, None], n[None, :], threshold) & (o > 0)
        if key[0] != key[1]:
            near &= own[:, None] != own[None, :]
        links = near @ weight
        ok = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (r, links, r[_roots(near)])], ["r", "links", "peer"])

    @lean

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, got = None, []
        for b in batches:
            for b1, b2, *rest in zip(*(c.to_pylist() for c in b.columns)):
                if (b1, b2) != key:
                    if len(got) > 1:
                        yield from product(key, got)
                    key, got = (b1, b2), []
                got.append(tuple(rest))
        if len(got) > 1:
            yield from product(key, got)

    return run


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_LIMIT else df


def _classes(src: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Texts and what stands for them: (ident, text) of one document of each different text; (ident, size) of the texts
    that several documents have; (ident, doc_id) of all documents whose ident isn't their own doc_id or of which there
    are several; the characters of the texts.

    ``src`` is (doc_id, text, m), m a digest of the text. The ident is the text's
    least doc_id, or a number of its own where that doc_id has other texts too.
    Texts are moved only for rows that repeat what stands for them, unless there
    are too many other members to broadcast.
    """
    rows = materialize(src.groupBy("m", "doc_id").agg(F.count("*").alias("c"), F.max(F.length("text")).alias("chars")), "texts")
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("odd"))
    odd = materialize(odd, "odd")
    by = rows.groupBy("m").agg(F.min("doc_id").alias("rep"), F.sum("c").alias("all"), F.count("*").alias("size"), F.max("chars").alias("chars"))
    chars = by.agg(F.sum("chars")).first()[0] or 0
    name = F.when(F.col("odd").isNull(), F.col("rep")).otherwise(-1 - F.pmod(F.xxhash64("rep", "m"), F.lit(1 << 62)))
    by = by.join(_few(odd), F.col("rep") == F.col("odd"), "left").withColumn("ident", name).where("all > 1 OR odd IS NOT NULL")
    many = materialize(rows.join(by.select("m", "rep", "ident", "size"), "m").select("m", "doc_id", "rep", "ident", "size", "c"), "copies")

    stands = F.col("doc_id") == F.col("rep")
    left = many.where(~stands | (F.col("c") > 1) | (F.col("ident") != F.col("rep"))).select("m", "doc_id")
    few = _few(left)
    single = src.join(few, ["m", "doc_id"], "left_anti")
    if few is left:
        single = single.sortWithinPartitions("m", "doc_id")  # a task that is run again must give the same batches
    again = many.where(stands & ((F.col("c") > 1) | (F.col("ident") != F.col("rep")))).select("m", "doc_id", "ident")
    repeated = src.join(_few(again), ["m", "doc_id"]).groupBy("ident", "m").agg(F.first("text").alias("text")).sortWithinPartitions("m", "ident")
    texts = single.select(F.col("doc_id").alias("ident"), "text").unionByName(repeated.select("ident", "text"))
    return texts, many.where("size > 1").select("ident", "size").distinct(), many.select("ident", "doc_id"), chars


def _blocks(hot: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(r, n, block): rows that share a column with the same least row, and are of like size, in blocks of about ``block_rows`` rows or BLOCK_GRAMS n-grams."""
    near = hot.groupBy("r", "n").agg(F.min("least").alias("key"))
    like = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(threshold))) if threshold < 1 else F.col("n")
    near = materialize(near.withColumn("like", like), "near")
    parts = near.groupBy("key", "like").agg(F.ceil(F.greatest(F.count("*") / block_rows, F.sum("n") / BLOCK_GRAMS)).alias("parts"))
    return near.join(parts, ["key", "like"]).select("r", "n", F.xxhash64("key", "like", F.pmod(F.xxhash64("r"), F.col("parts"))).alias("block"))


def near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, batch_grams: int = 1 << 20, block_rows: int = BLOCK_ROWS, cold: int = COLD) -> DataFrame:
    """(doc_id, class_id, links) of every document that has a link: with how many others its word n-gram set has a Jaccard similarity of at least ``threshold``, and the least doc_id of those that links connect it with.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their
    names. Documents of equal text are compared once for all, and each of them is
    a link of the others. Words are runs of letters and digits in lower case; a
    text of 1 to n - 1 words has one n-gram, of all of them; all of a very long
    text counts. Rows with a null doc_id, a null text or no word have no links; a
    similarity at the threshold is one. Rows that repeat a doc_id and its text
    are one document; each other text of a doc_id is a document of its own, and
    the row of the doc_id has the sum of their links. An empty table gives no
    rows.

    N-grams are 48 bits of a hash. Where two of them collide a document
    frequency is too large, which costs time and no link; two documents would
    have to hold a colliding pair between them for their overlap to change.
    """
    spark = docs.sparkSession
    tune(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    src = src.where(F.col("text").rlike(r"[\p{L}\p{N}]")).withColumn("m", F.unhex(F.md5("text")))
    texts, sizes, held, chars = _classes(src)
    blocks = max(partitions(spark), -(-chars // (6 * COLUMN_GRAMS)))
    parted = texts.mapInArrow(_incidence(n, blocks, batch_grams), _PACKED)
    cols = parted.repartitionById(blocks, F.col("dest")).mapInArrow(_columns, _PACKED)
    rows = materialize(cols.repartition(blocks, "batch").mapInArrow(_rows(threshold), "r long, doc_id long, n long, last long, prefix array<long>, grams binary"), "rows")
    del parted, cols
    free_shuffles(spark)
    sizes = materialize(sizes, "sizes")
    ident = rows.select("r", F.col("doc_id").alias("ident")).join(_few(sizes), "ident", "left").select("r", "ident", F.coalesce("size", F.lit(1)).cast("long").alias("weight"))
    ident = materialize(ident, "idents")

    post = rows.select("r", "n", "last", F.explode("prefix").alias("h"))
    by = post.groupBy("h").agg(F.count("*").alias("m"), F.min("r").alias("least")).where("m > 1")
    met = post.join(by, "h")
    side = rows.select("r", "n", "grams")

    # Columns of few rows: candidates by shared prefix columns, then exactly.
    listed = met.where(F.col("m") <= cold).groupBy("h").agg(F.collect_list(F.struct("r", "n", "last")).alias("rows")).select("rows")
    cand = listed.mapInArrow(_meet(threshold), "a long, b long, need int").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")
    pair = cand.join(side.toDF("a", "na", "ga"), "a").join(side.toDF("b", "nb", "gb"), "b").select("a", "b", "na", "nb", "ga", "gb")
    few = materialize(pair.mapInArrow(_verify(threshold), "a long, b long"), "few")
    free_shuffles(spark)

    # Columns of many: row blocks, each with itself, and each two that meet in a column with their rows that do.
    hot = materialize(met.where(F.col("m") > cold).select("h", "r", "n", "least"), "hot")
    block = materialize(_blocks(hot, threshold, block_rows), "blocks")
    own = block.select(F.col("block").alias("b1"), F.col("block").alias("b2"), "r", "block")
    at = hot.select("h", "r").join(block, "r")
    there = at.groupBy("h", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"))
    there = there.join(there.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "h", "left_semi").withColumnRenamed("block", "other")
    cross = at.join(there, "h").where(f"block <> other AND n1 >= n * {threshold!r} - 1e-9 AND n >= n0 * {threshold!r} - 1e-9")
    cross = materialize(cross.select(F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "r", "block").distinct(), "cross")
    work = own.unionByName(cross).join(side.join(ident.select("r", "weight"), "r"), "r").select("b1", "b2", "r", "n", "weight", "block", "grams")
    work = work.repartition("b1", "b2").sortWithinPartitions("b1", "b2")
    many = materialize(work.mapInArrow(_multiply(threshold), "r long, links long, peer long"), "many")
    free_shuffles(spark)

    # Pairs that products have counted already aren't counted again.
    placed = few.join(block.select(F.col("r").alias("a"), F.col("block").alias("x")), "a", "left").join(block.select(F.col("r").alias("b"), F.col("block").alias("y")), "b", "left")
    placed = placed.where("x IS NULL OR y IS NULL OR x <> y").withColumns({"b1": F.least("x", "y"), "b2": F.greatest("x", "y")})
    for c in ("a", "b"):
        placed = placed.join(cross.select("b1", "b2", F.col("r").alias(c), F.lit(True).alias(f"has_{c}")), ["b1", "b2", c], "left")
    placed = placed.where("has_a IS NULL OR has_b IS NULL").select("a", "b")
    two = F.explode(F.array(F.struct(F.col("a").alias("r"), F.col("b").alias("o")), F.struct(F.col("b").alias("r"), F.col("a").alias("o")))).alias("x")
    one = placed.select(two).select("x.r", "x.o").join(ident.select(F.col("r").alias("o"), F.col("weight").alias("links")), "o").select("r", "links")
    near = many.select("r", "links").unionByName(one).groupBy("r").agg(F.sum("links").alias("links"))
    near = near.join(ident, "r").groupBy("ident").agg(F.sum("links").alias("links"))

    name = ident.select("r", "ident")
    edges = few.unionByName(many.select(F.col("r").alias("a"), F.col("peer").alias("b")))
    edges = edges.join(name.toDF("a", "u"), "a").join(name.toDF("b", "v"), "b").select("u", "v")
    texts_of = held.join(held.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("ident").alias("v")).where("k > 1"), "doc_id")
    comp = connected_components(edges.unionByName(texts_of.select(F.col("ident").alias("u"), "v")))
    out = near.join(sizes, "ident", "full").select("ident", (F.coalesce("links", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("links")).where("links > 0")
    out = out.join(comp.withColumnRenamed("node", "ident"), "ident", "left").join(held, "ident", "left")
    out = materialize(out.select(F.coalesce("doc_id", "ident").alias("doc_id"), F.coalesce("component", "ident").alias("component"), "links"), "linked")
    named = out.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return out.join(named, "component").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document, that of the least doc_id, of each group that near copies connect, with all columns, whatever their names.

    Rows with a null doc_id or text stay, as do those without a word, and rows
    that repeat a doc_id stay or go together; all of a very long text counts. An
    empty table gives no rows. The doc_ids to drop are broadcast only while they
    are few enough (common.BROADCAST_LIMIT); beyond that the rows are joined on
    doc_id.
    """
    drop = materialize(near_copies(docs, n, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias("drop")), "drop")
    row, columns = packed(docs)
    d = docs.select(F.col("doc_id").cast("long").alias("id"), row)
    return d.join(_few(drop), F.col("id") == F.col("drop"), "left_anti").select(*columns)


def brute_pairs(rows: list[tuple], n: int = N, threshold: float = THRESHOLD) -> set[tuple[int, int]]:
    """All pairs, with those between copies, from plain Python sets, for tests."""
    sets = []
    for k, t in rows:
        if k is None or not t:
            continue
        words = "".join(c.lower() if c.isalnum() else " " for c in t).split()
        if words:
            m = min(n, len(words))
            sets.append((k, {tuple(words[i : i + m]) for i in range(len(words) - m + 1)}))
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a != b and (o := len(x & y)) / (len(x) + len(y) - o) >= threshold - 1e-12:
                out.add((min(a, b), max(a, b)))
    return out
