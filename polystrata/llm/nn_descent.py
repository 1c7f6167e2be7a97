"""Near-duplicate embeddings by NN-descent.

Vectors within half the threshold's angle of one vector are near duplicates of
each other, so they become a ball around it, and balls are searched in place of
their vectors. A neighbour graph of the balls' centres begins with the neighbours
that random hyperplanes put in one bucket, and is refined by joining neighbours
of neighbours: at each centre all that point to it or that it points to are
compared, if one of the two is new in a list. Neighbours beyond twice the
threshold's angle are in no list: whatever two near vectors are both near to is
within that of either. A centre whose list is full of
neighbours near enough to matter is saturated; its list is enlarged to all that
rounds of comparing the lists of a common neighbour bring. Recall is audited
against exact search for a sample of vectors, and rounds are added until it is
reached; where rounds no longer help, exact search of the centres follows. Of two
balls that the triangle inequality neither links nor parts as a whole, the
vectors are compared.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polystrata.llm.common import BROADCAST_LIMIT, connected_components, free_shuffles, materialize, partitions, release, tune

K = 10  #: neighbours in a list before it is enlarged
THRESHOLD = 0.9  #: cosine of near duplicates
TREES = 6  #: hyperplane tables of a round
LEAF = 96  #: vectors wanted in a bucket
COVERS = 6  #: rounds of putting vectors in balls, at most; each but the first is by other hyperplanes
LEAST_COVER = 0.005  #: of the vectors, put in balls by a round, for another to follow
MARGIN = 1e-3  #: radians by which rounding may change an angle
SAMPLE = 400  #: vectors, about, whose recall is audited
RECALL = 0.98  #: below it another round follows
ROUNDS = 4  #: after so many, more follow only while they add to the recall; else exact search
LEAST_GAIN = 0.01  #: of recall, by a round after ROUNDS
CHANGED = 0.01  #: share of the list entries; descent goes on while a join changes more
GROWN = 0.001  #: share of the edges; lists are enlarged while a round adds more
MOST_GROWTH = 20  #: rounds of enlarging, which the audit judges
LEAST_PARTNERS = 100  #: vectors with partners that an audit rests on, if there are so many
MOST_SAMPLE = 1 << 14  #: vectors audited, or searched exactly, at once
BLOCK = 1024  #: rows multiplied at once
BALL_BYTES = 128  #: of a row of ids, once broadcast

_EDGE = "id long, nbr long, sim float, fresh boolean"
_EDGES = pa.schema([("id", pa.int64()), ("nbr", pa.int64()), ("sim", pa.float32()), ("fresh", pa.bool_())])


def _edges(i: np.ndarray, j: np.ndarray, s: np.ndarray, fresh: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    fresh = np.ones(len(i), bool) if fresh is None else fresh
    for k in range(0, len(i), 100_000):
        e = k + 100_000
        yield pa.RecordBatch.from_arrays([pa.array(i[k:e], pa.int64()), pa.array(j[k:e], pa.int64()), pa.array(s[k:e].astype(np.float32)), pa.array(fresh[k:e])], schema=_EDGES)


def _matrix(col) -> np.ndarray:
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1) if raw else np.zeros((0, 1), np.float32)


def _angle(s):
    return np.arccos(np.clip(s, -1, 1))


def _nearness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of centres, whose rows end in the radius of their ball: of the angle that is left between two balls."""
    s = x[:, :-1] @ y[:, :-1].T
    i, j = np.flatnonzero(x[:, -1]), np.flatnonzero(y[:, -1])
    wide = np.zeros(s.shape, bool)
    wide[i], wide[:, j] = True, True
    if wide.any():
        a, b = np.nonzero(wide)
        s[a, b] = np.cos(np.maximum(_angle(s[a, b]) - x[a, -1] - y[b, -1], 0))
    return s


def unit_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): one row an id, v the unit vector as bytes of floats. Nulls, zero vectors and vectors with a null or a number that isn't finite are left out; of several vectors of an id the greatest stays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.array(x, np.float64) if x and None not in x else np.zeros(1)
                n = np.linalg.norm(a) if np.isfinite(a).all() else 0.0
                if 0 < n < np.inf:
                    ids.append(i)
                    out.append((a / n).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])

    src = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    return src.groupBy("id").agg(F.max("x").alias("x")).mapInArrow(run, "id long, v binary")


def _codes(x: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    """The side of each hyperplane that each vector is on, as one number a table."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], tables * bits)).astype(np.float32)
    return (x @ planes > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _buckets(tables: int, bits: int, seed: int, tail: int = 0):
    """One row for each vector and table, with its code as bucket before its columns, of which the last is the vector, but for ``tail`` numbers at its end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(b.num_columns - 1))
            if len(x):
                code = _codes(x[:, : x.shape[1] - tail], tables, bits, seed)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(code[:, t] * tables + t, pa.int64()), *b.columns], ["bucket", *b.schema.names])

    return run


# ------------------------------------------------------------------------ balls


def _greedy(x: np.ndarray, rho: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(index of each row's centre, radius of each row's ball): rows in order take all later ones whose balls stay within ``radius`` of them."""
    n = len(x)
    reach = _angle(x @ x.T) + rho[None, :]
    near = reach <= radius
    near[np.arange(n), np.arange(n)] = True
    to, rho = np.arange(n), rho.copy()
    free = np.ones(n, bool)
    for i in np.flatnonzero(near.sum(1) > 1):
        if free[i]:
            own = np.flatnonzero(near[i] & free)
            own = own[own != i]
            free[own] = False
            free[i] = False
            to[own] = i
            if len(own):
                rho[i] = max(rho[i], reach[i, own].max())
    return to, rho


def _cover(radius: float, bits: int | None):
    """Balls within runs of BLOCK rows of one Arrow batch, ordered by their codes if ``bits`` is given. Columns end in id, rho, v; gives (id, centre, rho, v), v only for centres."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rho, v = b.columns[-3:]
            ids, rho, x = ids.to_numpy(), rho.to_numpy().astype(np.float64), _matrix(v)
            if not len(x):
                continue
            order = np.argsort(_codes(x, 1, bits, 99)[:, 0], kind="stable") if bits else np.arange(len(x))
            centre, new = ids.copy(), rho.copy()
            for k in range(0, len(order), BLOCK):
                o = order[k : k + BLOCK]
                to, r = _greedy(x[o], rho[o], radius)
                centre[o], new[o] = ids[o][to], r
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(centre), pa.array(new), pa.array([a if c == i else None for a, c, i in zip(v.to_pylist(), centre, ids)], pa.binary())], ["id", "centre", "rho", "v"])

    return run


def balls(vec: DataFrame, n: int, radius: float) -> tuple[DataFrame, DataFrame]:
    """((id, rho, v) of the centres, (id, centre) of the other vectors). No bucket is held in one task: runs of BLOCK rows are covered by themselves, and their centres in the next round."""
    parts = partitions(vec.sparkSession)
    at = vec.select("id", F.lit(0.0).alias("rho"), "v")
    out: DataFrame | None = None
    left = n
    for turn in range(COVERS):
        bits = max(1, min(40, round(math.log2(max(2, left / LEAF)))))
        src = at if not turn else at.mapInArrow(_buckets(1, bits, 500 + turn), "bucket long, id long, rho double, v binary").repartition(parts, "bucket").sortWithinPartitions("bucket", "id")
        got = materialize(src.mapInArrow(_cover(radius, None if turn else 10), "id long, centre long, rho double, v binary"), "balls")
        at = got.where("id = centre").select("id", "rho", "v")
        taken = got.where("id <> centre").select("id", "centre")
        now = at.count()
        if out is not None:
            then = taken.toDF("x", "y")
            then = F.broadcast(then) if (left - now) * BALL_BYTES <= BROADCAST_LIMIT else then
            taken = out.join(then, F.col("centre") == F.col("x"), "left").select("id", F.coalesce("y", "centre").alias("centre")).unionByName(taken)
        out = materialize(taken, "members")
        few, left = left - now < LEAST_COVER * left, now
        if few and turn:
            break
    return at, out


def _with_radius(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centres (id, rho, v) as (id, v), v ending in rho."""
    for b in batches:
        tail = b.column(1).to_numpy().astype(np.float32)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v + r.tobytes() for v, r in zip(b.column(2).to_pylist(), tail)], pa.binary())], ["id", "v"])


# ---------------------------------------------------------------------- descent


def _grouped(batches: Iterable[pa.RecordBatch], most: float = math.inf) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive rows with an equal first column, as lists of slices; a list ends too once it has ``most`` rows."""
    key, got, n = None, [], 0
    for b in batches:
        c = b.column(0).to_numpy(zero_copy_only=False)
        if not len(c):
            continue
        cut = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
        for i, j in zip(cut, np.append(cut[1:], len(c))):
            if c[i] != key or n >= most:
                if got:
                    yield key, got
                key, got, n = c[i], [], 0
            got.append(b.slice(i, j - i))
            n += j - i
    if got:
        yield key, got


def _top(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest others of each row of ``x`` within it."""
    n = len(ids)
    s = _nearness(x, x)
    np.fill_diagonal(s, -2)
    k = min(k, n - 1)
    part = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-s, axis=1)[:, :k]
    row = np.repeat(np.arange(n), k)
    part = part.ravel()
    return ids[row], ids[part], s[row, part]


def _leaves(k: int, floor: float):
    """Nearest neighbours of at least ``floor`` in each bucket, in runs of at most 2 * BLOCK vectors. Columns: bucket, id, v."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK))
        for _, parts in _grouped(sliced, BLOCK):
            ids, x = np.concatenate([p.column(1).to_numpy() for p in parts]), np.concatenate([_matrix(p.column(2)) for p in parts])
            if len(ids) > 1:
                i, j, s = _top(ids, x, k)
                yield from _edges(i[s >= floor], j[s >= floor], s[s >= floor])

    return run


def _best(k: int, least: float):
    """The distinct neighbours of each id of at least ``least``, and the best k; rows of an id are together in a partition. Ties go to the lower neighbour; an entry is fresh only if none of its rows is old."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j, s, f = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool)
        held: list[tuple] = []
        size = 0

        def squeeze() -> None:
            nonlocal i, j, s, f
            i, j, s, f = (np.concatenate([a, *[h[c] for h in held]]) for c, a in enumerate((i, j, s, f)))
            held.clear()
            o = np.lexsort((f, j, i))
            i, j, s, f = i[o], j[o], s[o], f[o]
            keep = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[: len(i)]
            i, j, s, f = i[keep], j[keep], s[keep], f[keep]
            o = np.lexsort((j, -s, i))
            i, j, s, f = i[o], j[o], s[o], f[o]
            first = np.flatnonzero(np.diff(i, prepend=i[0] - 1)) if len(i) else np.zeros(0, np.int64)
            keep = (np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k) | (s >= least)
            i, j, s, f = i[keep], j[keep], s[keep], f[keep]

        for b in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            size += b.num_rows
            if size > max(1 << 20, len(i)):
                squeeze()
                size = 0
        squeeze()
        yield from _edges(i, j, s, f)

    return run


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the members at each vector of which one is fresh; gives the pairs better than the worst of either list. Columns: at, id, fresh, worst, v."""
    for _, parts in _grouped(batches):
        ids, fresh, worst = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in (1, 2, 3))
        if len(ids) < 2 or not fresh.any():
            continue
        x = np.concatenate([_matrix(p.column(4)) for p in parts])
        for a in range(0, len(ids), BLOCK):
            for c in range(a, len(ids), BLOCK):
                s = _nearness(x[a : a + BLOCK], x[c : c + BLOCK])
                if a == c:
                    s[np.tril_indices(len(s))] = -2
                i, j = np.nonzero((s > np.minimum(worst[a : a + BLOCK, None], worst[None, c : c + BLOCK])) & (fresh[a : a + BLOCK, None] | fresh[None, c : c + BLOCK]))
                v = s[i, j]
                i, j = i + a, j + c
                up, down = v > worst[i], v > worst[j]
                yield from _edges(np.concatenate([ids[i[up]], ids[j[down]]]), np.concatenate([ids[j[up]], ids[i[down]]]), np.concatenate([v[up], v[down]]))


def _descend(vec: DataFrame, graph: DataFrame, k: int, least: float, floor: float) -> DataFrame:
    """Joins neighbours of neighbours until few list entries change. Only the k best entries of a list take part, so no vector has more than k on its side; one that very many point to has its other side split by a hash."""
    parts = partitions(vec.sparkSession)
    while True:
        rank = F.row_number().over(_by("id", F.desc("sim"), "nbr"))
        lists = graph.withColumn("rank", rank).where(F.col("rank") <= k)
        worst = lists.groupBy("id").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(floor)).cast("float").alias("worst"))
        known = vec.select("id", "v").join(worst, "id", "left").select("id", F.coalesce("worst", F.lit(floor).cast("float")).alias("worst"), "v")
        point = lists.select(F.col("nbr").alias("at"), "id", "fresh").unionByName(lists.select(F.col("id").alias("at"), F.col("nbr").alias("id"), "fresh"))
        point = point.groupBy("at", "id").agg(F.max("fresh").alias("fresh"))
        live = point.groupBy("at").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).where("any AND n > 1").select("at", F.ceil(F.col("n") / BLOCK).alias("cut"))
        point = point.join(live, "at").select(F.when(F.col("cut") > 1, F.xxhash64("at", F.pmod(F.xxhash64("id"), F.col("cut")))).otherwise(F.col("at")).alias("at"), "id", "fresh")
        rows = point.join(known, "id").select("at", "id", "fresh", "worst", "v")
        found = rows.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(_join, _EDGE)
        old = graph.select("id", "nbr", "sim", F.lit(False).alias("fresh"))
        new = materialize(old.unionByName(found).repartition(parts, "id").mapInArrow(_best(k, least), _EDGE), "graph")
        release(graph)
        graph = new
        free_shuffles(vec.sparkSession)
        entries, fresh = graph.agg(F.count("*"), F.count_if("fresh")).first()
        if fresh <= CHANGED * entries:
            return graph


def _by(key: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


# ------------------------------------------------------------------- comparing


def _within(threshold: float):
    """All pairs of a block pair. Columns: key, side, id, v; side 0 and 1 are the two blocks, 2 a block with itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _grouped(batches):
            side, ids = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (1, 2))
            x = np.concatenate([_matrix(p.column(3)) for p in parts])
            if (side == 2).all():
                s = _nearness(x, x)
                s[np.tril_indices(len(s))] = -2
                i, j = np.nonzero(s >= threshold)
                yield from _edges(np.concatenate([ids[i], ids[j]]), np.concatenate([ids[j], ids[i]]), np.tile(s[i, j], 2))
            else:
                p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                s = _nearness(x[p], x[q])
                i, j = np.nonzero(s >= threshold)
                yield from _edges(np.concatenate([ids[p[i]], ids[q[j]]]), np.concatenate([ids[q[j]], ids[p[i]]]), np.tile(s[i, j], 2))

    return run


def _in_blocks(member: DataFrame) -> DataFrame:
    """(key, side, id) of the block pairs that compare all members (key, id) of a key with one another, a block of about BLOCK ids."""
    size = member.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("cut"), F.count("*").alias("n")).where("n > 1").drop("n")
    m = member.join(size, "key").withColumn("at", F.pmod(F.xxhash64("id"), F.col("cut")))
    m = m.select("key", "id", "at", F.explode(F.expr("sequence(0L, cut - 1)")).alias("other"))
    lo, hi = F.least("at", "other"), F.greatest("at", "other")
    side = F.when(F.col("at") == F.col("other"), 2).when(F.col("at") < F.col("other"), 0).otherwise(1)
    return m.select(F.xxhash64("key", lo, hi).alias("key"), side.cast("int").alias("side"), "id")


def _enlarge(vec: DataFrame, graph: DataFrame, k: int, least: float) -> DataFrame:
    """``graph`` with the lists of saturated vectors enlarged: each vector near one brings its list to that neighbour of it whose keyed hash is least, and all that meet there are compared; other hashes follow while enough edges are new."""
    parts = partitions(vec.sparkSession)
    n = graph.where(F.col("sim") >= least).count()
    for turn in range(MOST_GROWTH):
        near = graph.where(F.col("sim") >= least).select("id", "nbr")
        full = near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("id")
        held = near.join(full, "id", "left_semi")
        both = held.unionByName(held.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))).unionByName(full.select("id", F.col("id").alias("nbr")))
        member = both.groupBy("id").agg(F.min_by("nbr", F.xxhash64("nbr", F.lit(turn))).alias("key"))
        member = materialize(member, "hubs")
        if not turn and member.isEmpty():
            break
        rows = _in_blocks(member).join(vec.select("id", "v"), "id").select("key", "side", "id", "v")
        found = rows.repartition(parts, "key").sortWithinPartitions("key", "side").mapInArrow(_within(least), _EDGE)
        new = materialize(graph.unionByName(found).repartition(parts, "id").mapInArrow(_best(k, least), _EDGE), "graph")
        release(graph)
        release(member)
        graph = new
        now = graph.where(F.col("sim") >= least).count()
        if now <= n * (1 + GROWN):
            break
        n = now
    return graph


def _near(vec: DataFrame, ids: np.ndarray, x: np.ndarray, threshold: float) -> tuple[DataFrame, Broadcast]:
    """Exact pairs of the centres given with all of ``vec``, by blocks of BLOCK rows, and the broadcast that they need."""
    shared = vec.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for b in batches:
            y = _matrix(b.column(1))
            if len(y):
                other = b.column(0).to_numpy()
                for a in range(0, len(ids), BLOCK):
                    s = _nearness(x[a : a + BLOCK], y)
                    i, j = np.nonzero((s >= threshold) & (ids[a : a + BLOCK, None] != other[None, :]))
                    yield from _edges(ids[a + i], other[j], s[i, j])

    return vec.select("id", "v").mapInArrow(run, _EDGE), shared


def _counted(vec: DataFrame, ids: np.ndarray, x: np.ndarray, threshold: float) -> tuple[DataFrame, Broadcast]:
    """(id, n): how many of ``vec`` are near each of the vectors given, counted where they are."""
    shared = vec.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        n = np.zeros(len(ids), np.int64)
        for b in batches:
            y = _matrix(b.column(1))
            if len(y):
                other = b.column(0).to_numpy()
                for a in range(0, len(ids), BLOCK):
                    n[a : a + BLOCK] += ((x[a : a + BLOCK] @ y.T >= threshold) & (ids[a : a + BLOCK, None] != other[None, :])).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], ["id", "n"])

    return vec.select("id", "v").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")), shared


def _rows(got: list) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([r[0] for r in got], np.int64)
    return ids, np.frombuffer(b"".join(bytes(r[1]) for r in got), np.float32).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), np.float32)


def audit(vec: DataFrame, links: DataFrame, threshold: float, sample: int = SAMPLE) -> float | None:
    """The lesser of the share of all links, and the mean share of a vector's, that ``links`` (id, links) has of those that exact search finds for a sample of vectors, chosen by a hash of their id.

    The sample, about ``sample`` vectors at first, grows until LEAST_PARTNERS of
    it have a link, is all vectors, or MOST_SAMPLE. None if it is only part of
    the vectors and too few of it have one then; 1 if all vectors have none.
    """
    total = max(1, vec.count())
    while True:
        every = total <= sample
        part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / total)) + 1
        want, shared = _counted(vec, *_rows(vec.where(part).select("id", "v").collect()), threshold)
        share = F.least(F.coalesce("links", F.lit(0)) / F.col("n"), F.lit(1.0))
        n, pairs, all_, mean = want.join(links.select("id", "links"), "id", "left").agg(F.count("*"), F.sum(share * F.col("n")), F.sum("n"), F.avg(share)).first()
        shared.unpersist()
        if every or n >= LEAST_PARTNERS:
            return min(pairs / all_, mean) if n else 1.0
        if sample >= MOST_SAMPLE:
            return None
        sample = min(MOST_SAMPLE, 8 * sample)


def exact(vec: DataFrame, threshold: float) -> DataFrame:
    """All edges (id, nbr, sim), id < nbr, of centres, by blocks of MOST_SAMPLE of them against all; the work is quadratic, nothing is shuffled."""
    rows = vec.select("id", "v").toLocalIterator()
    out = vec.sparkSession.createDataFrame([], _EDGE)
    while got := list(itertools.islice(rows, MOST_SAMPLE)):
        pairs, shared = _near(vec, *_rows(got), threshold)
        pairs = materialize(pairs.where("id < nbr"), "exact")
        shared.unpersist()
        out = out.unionByName(pairs)
    return out


def _between(threshold: float):
    """How many of the other side each vector of two blocks is near. Columns: key, side, id, a, b, v; gives (a, b, id, n)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _grouped(batches):
            side, ids, a, b = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (1, 2, 3, 4))
            x = np.concatenate([_matrix(p.column(5)) for p in parts])
            p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            s = x[p] @ x[q].T >= threshold
            n = np.zeros(len(ids), np.int64)
            n[p], n[q] = s.sum(1), s.sum(0)
            k = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(y[k]) for y in (a, b, ids, n)], ["a", "b", "id", "n"])

    return run


def _links(vec: DataFrame, centres: DataFrame, members: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(id, class_id, links) of every vector, from the edges (id, nbr, sim) of the centres, whose sim is of the angle left between their balls."""
    theta = math.acos(threshold)
    ball = members.groupBy("centre").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    ball = centres.join(ball, centres.id == ball.centre, "left").select("id", "rho", (F.coalesce("n", F.lit(0)) + 1).alias("size"), F.least("id", F.coalesce("least", "id")).alias("least"))
    ball = materialize(ball, "sizes")
    e = edges.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    e = e.join(ball.select(F.col("id").alias("a"), F.col("rho").alias("ra"), F.col("size").alias("na")), "a").join(ball.select(F.col("id").alias("b"), F.col("rho").alias("rb"), F.col("size").alias("nb")), "b")
    e = e.withColumns({"angle": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sim").cast("double")))), "r": F.col("ra") + F.col("rb"), "one": (F.col("na") == 1) & (F.col("nb") == 1)})
    whole = F.when(F.col("one"), F.col("sim") >= F.lit(threshold).cast("float")).otherwise(F.col("angle") + 2 * F.col("r") <= theta - MARGIN)
    e = e.where(F.when(F.col("one"), F.col("sim") >= F.lit(threshold).cast("float")).otherwise(F.col("angle") <= theta + MARGIN)).withColumn("whole", whole)
    e = materialize(e.select("a", "b", "na", "nb", "whole"), "pairs")

    own = centres.select("id", F.col("id").alias("centre")).unionByName(members)
    part = e.where("NOT whole").withColumns({"ca": F.ceil(F.col("na") / BLOCK), "cb": F.ceil(F.col("nb") / BLOCK)})
    one = part.select("a", "b", F.col("a").alias("centre"), F.lit(0).alias("side"), F.col("ca").alias("cut"), F.col("cb").alias("cuts"))
    two = part.select("a", "b", F.col("b").alias("centre"), F.lit(1).alias("side"), F.col("cb").alias("cut"), F.col("ca").alias("cuts"))
    rows = one.unionByName(two).join(own, "centre").withColumn("at", F.pmod(F.xxhash64("id"), F.col("cut"))).withColumn("other", F.explode(F.expr("sequence(0L, cuts - 1)")))
    key = F.when(F.col("side") == 0, F.xxhash64("a", "b", "at", "other")).otherwise(F.xxhash64("a", "b", "other", "at"))
    rows = rows.select(key.alias("key"), "side", "id", "a", "b").join(vec.select("id", "v"), "id").select("key", "side", "id", "a", "b", "v")
    met = rows.repartition(partitions(vec.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_between(threshold), "a long, b long, id long, n long")
    met = materialize(met, "met")

    more = e.where("whole").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("nb").alias("n")), F.struct(F.col("b").alias("id"), F.col("na").alias("n")))).alias("x")).groupBy("x.id").agg(F.sum("x.n").alias("n"))
    comp = connected_components(e.where("whole").select("a", "b").unionByName(met.select("a", "b").distinct()))
    ball = ball.join(more, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    ball = ball.select("id", F.coalesce("component", "id").alias("component"), "least", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("links"))
    ball = materialize(ball, "linked")
    name = ball.groupBy("component").agg(F.min("least").alias("class_id"))
    ball = ball.join(name, "component").select(F.col("id").alias("centre"), "class_id", "links")
    extra = met.groupBy("id").agg(F.sum("n").alias("extra"))
    out = own.join(ball, "centre").join(extra, "id", "left")
    return out.select("id", "class_id", (F.col("links") + F.coalesce("extra", F.lit(0))).alias("links"))


def _search(vec: DataFrame, threshold: float, k: int, recall: float) -> DataFrame:
    """(id, class_id, links) of vectors of one length."""
    parts = partitions(vec.sparkSession)
    theta = math.acos(threshold)
    centres, members = balls(vec, vec.count(), theta / 2 - MARGIN)
    n = centres.count()
    wide = centres.mapInArrow(_with_radius, "id long, v binary")
    least, floor = math.cos(theta + MARGIN), math.cos(min(math.pi, 2 * theta))
    bits = max(1, min(40, round(math.log2(max(2, n / LEAF)))))
    graph, reached = None, 0.0
    for turn in itertools.count():
        start = wide.mapInArrow(_buckets(TREES, bits, 1000 + turn, 1), "bucket long, id long, v binary").repartition(parts, "bucket").sortWithinPartitions("bucket", "id")
        start = start.mapInArrow(_leaves(k, floor), _EDGE)
        start = start if graph is None else graph.withColumn("fresh", F.lit(False)).unionByName(start)
        graph = materialize(start.repartition(parts, "id").mapInArrow(_best(k, least), _EDGE), "graph")
        graph = _enlarge(wide, _descend(wide, graph, k, least, floor), k, least)
        out = materialize(_links(vec, centres, members, graph.where(F.col("sim") >= least), threshold), "links")
        share = audit(vec, out, threshold)
        if share is not None and share >= recall:
            return out
        if turn + 1 >= ROUNDS and (share is None or share < reached + LEAST_GAIN):
            return materialize(_links(vec, centres, members, exact(wide, least), threshold), "links")
        reached = max(reached, share or 0.0)


def neighbours(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, recall: float = RECALL, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, class_id, links) of every vector that has a link: how many others have a cosine of at least ``threshold`` to it, and the least id of those that links connect it with.

    Null ids, null or zero vectors, and those with a null or a number that isn't
    finite give no row; an id in several rows is one vector, the greatest. Only
    vectors of one length are compared. The search is approximate; rounds with
    other hyperplanes follow until the audited recall is at least ``recall``;
    where they don't reach it, or too few links are found to audit, the search is
    exact in the end. Cosines are of single precision, equal vectors are linked,
    and a cosine at the threshold is a link. Very long vectors are compared
    whole. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    tune(spark, 5000)
    vec = materialize(unit_vectors(vectors, ident, vector), "vectors")
    sizes = [r[0] for r in vec.select(F.length("v").alias("size")).distinct().orderBy("size").collect()]
    out = spark.createDataFrame([], "id long, class_id long, links long")
    for size in sizes:
        out = out.unionByName(_search(vec.where(F.length("v") == size), threshold, k, recall))
    return out.where("links > 0").withColumnRenamed("id", "vec_id")
