"""Sharding by best-fit-decreasing bin packing.

Groups that must not be split go, largest first, into the bin with the least
room that still holds them, found through a balanced tree; a group that fits
nowhere opens a bin. Groups of equal size are alike, and bins of equal room are
alike, so the packing needs no more than how many groups there are of each size:
the driver packs size classes, whole runs of groups into whole runs of bins at a
time, and groups find their bin by their rank in their class. Result and number
of bins are those of packing the groups one by one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polystrata.llm.common import materialize, packed

CAPACITY = 262_144  #: tokens in a shard
_LANES = 64  #: parts, at least, in which a size class is ranked, so that none is ranked in one task
_LANE_ROWS = 1 << 17  #: groups wanted in a lane, if all were of one size
_SPAN = 1 << 16  #: ranks of a size class that meet their runs at once


class RoomTree:
    """Balanced binary tree over room 0..capacity: which rooms some bin has, and the least of at least s."""

    def __init__(self, capacity: int):
        self.base = 1 << max(1, (capacity + 1).bit_length())
        self.tree = bytearray(2 * self.base)

    def set(self, room: int, there: bool) -> None:
        i = room + self.base
        self.tree[i] = there
        while i > 1:
            i //= 2
            now = self.tree[2 * i] | self.tree[2 * i + 1]
            if self.tree[i] == now and there == now:
                return
            self.tree[i] = now

    def least_from(self, size: int) -> int | None:
        t, i = self.tree, size + self.base
        if i >= 2 * self.base:
            return None
        if not t[i]:
            while i > 1 and not (i % 2 == 0 and t[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
        while i < self.base:
            i = 2 * i if t[2 * i] else 2 * i + 1
        return i - self.base


@dataclass(frozen=True)
class Run:
    """Groups of ``size`` with ranks first .. first + each * bins - 1, ``each`` to a bin from ``bin`` on (the last bin may have fewer)."""

    size: int
    first: int
    count: int
    each: int
    bin: int


def pack(classes: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Packs ``classes`` (size -> number of groups); gives runs and the number of bins. A group larger than a bin has one of its own. Of bins with equal room the first is used."""
    runs: list[Run] = []
    tree = RoomTree(capacity)
    bins: dict[int, list[tuple[int, int]]] = {}  # room -> heap of (first bin, how many)
    opened = 0

    def give(room: int, first: int, n: int) -> None:
        if n and room >= 0:
            if not bins.get(room):
                bins[room] = []
                tree.set(room, True)
            heapq.heappush(bins[room], (first, n))

    for size in sorted(classes, reverse=True):
        left, rank = classes[size], 0
        if size > capacity:
            runs.append(Run(size, 0, left, 1, opened))
            opened += left
            continue
        while left:
            room = tree.least_from(size)
            if room is None:
                each = capacity // size if size else left
                n, room, first = -(-left // each), capacity, opened
                opened += n
            else:
                each = room // size if size else left
                first, n = heapq.heappop(bins[room])
                if not bins[room]:
                    tree.set(room, False)
            full = min(n, left // each)
            part = left - full * each if full < n else 0
            give(room - each * size, first, full)
            if part:
                give(room - part * size, first + full, 1)
            give(room, first + full + (part > 0), n - full - (part > 0))
            runs.append(Run(size, rank, full * each + part, each, first))
            left -= full * each + part
            rank += full * each + part
    return runs, opened


def shard(docs: DataFrame, group: list, size, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with shard (from 0) and group_size; ``group`` are the columns that make rows indivisible, ``size`` a column of whole sizes.

    Nulls in ``group`` are a value like any other; a null size counts as 0 and
    must not be negative. A group larger than ``capacity`` has a shard of its
    own; groups of size 0 are together in the shard with the least room. Equal
    groups of rows stay together, repeated rows too; ties in size are ordered by
    a hash of the group, then the group. Columns of ``docs`` may have any names
    but shard and group_size. An empty table gives no rows. Texts aren't read,
    so a very long one is a row like any other.

    The driver holds one number a distinct size, at most capacity + the larger
    ones, and the runs. Groups meet their runs by size and span of ranks: each
    takes the last run that begins at its rank or before.
    """
    spark = docs.sparkSession
    row, columns = packed(docs)
    keyed = docs.select(row, F.md5(F.to_json(F.struct(*group), {"ignoreNullFields": "false"})).alias("g"), F.coalesce(size.cast("long"), F.lit(0)).alias("s"))
    groups = materialize(keyed.groupBy("g").agg(F.sum("s").alias("size")), "groups")
    by = groups.groupBy("size").agg(F.count("*").alias("n")).toArrow()
    classes = dict(zip(by.column("size").to_pylist(), by.column("n").to_pylist()))
    runs, _ = pack(classes, capacity)

    n_lanes = max(_LANES, sum(classes.values()) // _LANE_ROWS)
    groups = groups.withColumn("lane", F.pmod(F.xxhash64("g"), F.lit(n_lanes)))
    lanes = groups.groupBy("size", "lane").agg(F.count("*").alias("n"))
    lanes = lanes.select("size", "lane", (F.sum("n").over(Window.partitionBy("size").orderBy("lane")) - F.col("n")).alias("before"))
    ranked = groups.withColumn("rn", F.row_number().over(Window.partitionBy("size", "lane").orderBy("g"))).join(lanes, ["size", "lane"])
    ranked = ranked.select("size", "g", (F.col("before") + F.col("rn") - 1).alias("rank"))

    table = spark.createDataFrame(pa.table({c: pa.array([getattr(r, c) for r in runs], pa.int64()) for c in ("size", "first", "count", "each", "bin")}))
    own = F.struct("first", "each", "bin").alias("run")
    table = table.select("size", own, F.explode(F.expr(f"sequence(first div {_SPAN}, (first + count - 1) div {_SPAN})")).alias("span"), "first")
    starts = table.select("size", "span", F.greatest("first", F.col("span") * _SPAN).alias("rank"), F.lit(None).cast("string").alias("g"), "run")
    both = ranked.select("size", F.expr(f"rank div {_SPAN}").alias("span"), "rank", "g", F.lit(None).cast(starts.schema["run"].dataType).alias("run")).unionByName(starts)
    last = F.last("run", ignorenulls=True).over(Window.partitionBy("size", "span").orderBy("rank", F.col("g").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("run", last).where("g IS NOT NULL").select("g", F.col("size").alias("group_size"), F.expr("run.bin + (rank - run.first) div run.each").alias("shard"))
    return keyed.join(placed, "g").select(*columns, "shard", "group_size")


def brute_pack(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each group, packed one by one, for tests; ``sizes`` in descending order."""
    room: list[int] = []
    out = []
    for s in sizes:
        if s > capacity:
            room.append(-1)
            out.append(len(room) - 1)
            continue
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            i = min(fits)[1]
        else:
            room.append(capacity)
            i = len(room) - 1
        room[i] -= s
        out.append(i)
    return out
