"""HTML extraction by union-free regular-expression inference.

A page is a stream of tags and texts. Runs of equal groups in a stream become
repeated groups; the distinct streams of a host are then aligned, two at a time
and in a tree, and what one side lacks becomes an optional group, what one side
repeats a repeated one. A wrapper takes no more streams once its columns would be
more than WIDTH times its longest stream, or where too little of the two sides
matches; such layouts have wrappers of their own. Texts that are the same in
every page of a wrapper belong to the template; the others are slots. A wrapper
is a regular expression without alternatives, and every page's texts are given
by the slot that they fill.

Wrappers are inferred from distinct streams, not from pages: a host with very
many pages of a few layouts costs no more than its layouts. A task merges at most
about FAN wrappers, whatever the host, and where a stream's slots lie is followed
through the rounds, so that no row grows with the number of streams.
"""

from __future__ import annotations

import html
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polystrata.llm.common import BROADCAST_LIMIT, materialize, partitions, tune

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z][^>]*>|<![^>]*>", re.S | re.I)
_NAME = re.compile(r"<(/?[a-zA-Z][\w:-]*)")
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([\w-]+)""", re.I)
#: Tags that hold others; a text belongs to the innermost of them that is open.
CONTAINERS = {"html", "head", "title", "body", "nav", "header", "footer", "main", "article", "section", "aside", "div", "ul", "ol", "table", "td", "th", "form", "figure", "blockquote", "pre"}
#: Parts of a page, and containers that only give text a form.
PARTS = {"article", "main", "nav", "header", "footer", "aside"}
FORMS = {"ul", "ol", "table", "td", "th", "figure", "blockquote", "pre"}
TEXT = "#"
FAN = 16  #: wrappers, about, that a task merges
WIDTH = 4  #: columns of a wrapper, at most, in lengths of its longest stream
ALIKE = 0.25  #: of the shorter side's columns, the least share that must match
TABLE_CELLS = 1 << 22  #: of an alignment table; beyond it the sides are split


def tokens(page: str) -> list[tuple[str, str]]:
    """(token, text) of a page: a tag is its name and first class, a text the token #. Comments, scripts and styles are left out; blank texts too."""
    out, at = [], 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            t = page[at : m.start()].strip()
            if t:
                out.append((TEXT, t))
        at = m.end()
        raw = m.group()
        if m.group(1) or raw.startswith("<!"):
            continue
        name = _NAME.match(raw).group(1).lower()
        c = _CLASS.search(raw)
        out.append((f"{name}.{c.group(1)}" if c else name, ""))
    t = page[at:].strip()
    if t:
        out.append((TEXT, t))
    return out


Item = tuple  # (key, number of slots, [(slot, text index)]); a key is a token or ("+", keys)


def _repeated(items: list[Item], period: int) -> Item:
    slots, off = [], 0
    for k in range(period):
        slots.append(off)
        off += items[k][1]
    return (("+", tuple(i[0] for i in items[:period])), off, [(slots[q % period] + s, t) for q, i in enumerate(items) for s, t in i[2]])


def collapse(stream: list[str]) -> list[Item]:
    """The stream with adjacent equal groups as repeated groups, shortest first, until there are none."""
    items: list[Item] = [(t, 1, [(0, n)]) if t == TEXT else (t, 0, []) for n, t in enumerate(stream)]
    changed = True
    while changed:
        changed = False
        keys = [i[0] for i in items]
        n = len(items)
        where: dict = defaultdict(list)
        for i in range(n - 1, -1, -1):
            where[keys[i]].append(i)
        out, i = [], 0
        while i < n:
            later = where[keys[i]]
            while later and later[-1] <= i:
                later.pop()
            for j in (j for j in reversed(later) if 2 * j - i <= n):
                p = j - i
                if keys[i + p - 1] == keys[j + p - 1] and keys[i:j] == keys[j : j + p]:
                    r = 2
                    while keys[i + r * p : i + (r + 1) * p] == keys[i:j]:
                        r += 1
                    out.append(_repeated(items[i : i + r * p], p))
                    i += r * p
                    changed = True
                    break
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _as_key(x):
    return x if isinstance(x, str) else ("+", tuple(_as_key(k) for k in x[1]))


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``x`` and each beginning of ``y``."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        nxt = row.copy()
        np.maximum(row[1:], row[:-1] + (y == v), out=nxt[1:])
        row = np.maximum.accumulate(nxt)
    return row


def _matched(x: np.ndarray, y: np.ndarray, i0: int, j0: int) -> list[tuple[int, int]]:
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    out = [(i0 + k, j0 + k) for k in range(lo)]
    a, b = x[lo : len(x) - hi], y[lo : len(y) - hi]
    if len(a) and len(b):
        if len(a) * len(b) > TABLE_CELLS and len(a) > 1:
            mid = len(a) // 2
            cut = int((_row(a[:mid], b) + _row(a[mid:][::-1], b[::-1])[::-1]).argmax())
            out += _matched(a[:mid], b[:cut], i0 + lo, j0 + lo) + _matched(a[mid:], b[cut:], i0 + lo + mid, j0 + lo + cut)
        else:
            best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
            for i in range(len(a) - 1, -1, -1):  # of what follows
                row = np.maximum(best[i + 1][:-1], best[i + 1][1:] + (b == a[i]))
                best[i][:-1] = np.maximum.accumulate(row[::-1])[::-1]
            i = j = 0
            while i < len(a) and j < len(b):
                if a[i] == b[j]:
                    out.append((i0 + lo + i, j0 + lo + j))
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
    return out + [(i0 + len(x) - hi + k, j0 + len(y) - hi + k) for k in range(hi)]


def _align(a: list, b: list) -> list[tuple[int, int]]:
    """Longest common subsequence of two key lists, as index pairs. Memory is bounded by TABLE_CELLS."""
    number: dict = {}
    x, y = (np.array([number.setdefault(k, len(number)) for k in s], np.int64) for s in (a, b))
    return _matched(x, y, 0, 0)


class Wrapper:
    """Columns of aligned streams: their keys, and of each the sum of hashes of the streams that have it, ``total`` if all do."""

    def __init__(self, keys: list, has: list[int], total: int, longest: int, ids: list[int]):
        self.keys, self.has, self.total, self.longest, self.ids = keys, has, total, longest, ids

    def expression(self, fixed: dict[int, str] | None = None) -> str:
        """The wrapper as a regular expression: (..)? is optional, (..)+ repeated, {n} the slot n."""
        out, c, slot = [], 0, 0
        while c < len(self.keys):
            e, body = c, ""
            while e < len(self.keys) and self.has[e] == self.has[c]:
                body += _written(self.keys[e], slot, fixed or {})
                slot += slots_of(self.keys[e])
                e += 1
            out.append(body if self.has[c] == self.total else f"({body})?")
            c = e
        return "".join(out)


_MASK = (1 << 64) - 1


def _opened(w: Wrapper, repeats: dict) -> tuple[list, list[int], list[int]]:
    """(keys, who has them, new slot of each slot) of ``w`` with single groups that are repeated elsewhere as repeated groups."""
    out, i = [], 0
    groups = sorted(repeats, key=lambda g: (-len(g), repr(g)))
    while i < len(w.keys):
        for g in groups:
            if tuple(w.keys[i : i + len(g)]) == g and len(set(w.has[i : i + len(g)])) == 1:
                out.append((repeats[g], w.has[i]))
                i += len(g)
                break
        else:
            out.append((w.keys[i], w.has[i]))
            i += 1
    # A repeated group beside single ones of the same group is one run.
    merged: list = []
    slots: list[int] = []
    n = 0
    for k, h in out:
        m = slots_of(k)
        if merged and not isinstance(k, str) and merged[-1] == (k, h):
            slots += list(range(n - m, n))
        else:
            merged.append((k, h))
            slots += list(range(n, n + m))
            n += m
    return [k for k, _ in merged], [h for _, h in merged], slots


def merge(a: Wrapper, b: Wrapper) -> tuple[Wrapper, list[int], list[int]] | None:
    """Both as one wrapper, and where the slots of each lie in it; None if they aren't alike enough."""
    repeats = {k[1]: k for w in (a, b) for k in w.keys if not isinstance(k, str)}
    (ka, ha, sa), (kb, hb, sb) = (_opened(w, repeats) for w in (a, b))
    match = _align(ka, kb)
    longest = max(a.longest, b.longest)
    if len(match) < ALIKE * min(len(ka), len(kb)) or len(ka) + len(kb) - len(match) > max(WIDTH * longest, 8):
        return None
    keys, has, to_a, to_b, n = [], [], [], [], 0
    ia = ib = 0
    for x, y in [*match, (len(ka), len(kb))]:
        for side, i, e, k, h, to in ((0, ia, x, ka, ha, to_a), (1, ib, y, kb, hb, to_b)):
            for c in range(i, e):
                keys.append(k[c])
                has.append(h[c])
                m = slots_of(k[c])
                to += range(n, n + m)
                n += m
        ia, ib = x, y
        if x < len(ka):
            keys.append(ka[x])
            has.append((ha[x] + hb[y]) & _MASK)
            m = slots_of(ka[x])
            to_a += range(n, n + m)
            to_b += range(n, n + m)
            n += m
            ia, ib = x + 1, y + 1
    return Wrapper(keys, has, (a.total + b.total) & _MASK, longest, a.ids + b.ids), [to_a[q] for q in sa], [to_b[q] for q in sb]


def slots_of(key) -> int:
    return int(key == TEXT) if isinstance(key, str) else sum(slots_of(k) for k in key[1])


def _written(key, slot: int, fixed: dict[int, str]) -> str:
    if isinstance(key, str):
        return (fixed.get(slot) or f"{{{slot}}}") if key == TEXT else f"<{key}>"
    out = []
    for k in key[1]:
        out.append(_written(k, slot, fixed))
        slot += slots_of(k)
    return f"({''.join(out)})+"


def _containers(keys: list) -> list[tuple[str, ...]]:
    """For each slot of a key list the containers that are open, outermost first."""
    out, stack = [], ["html"]

    def walk(k) -> None:
        if not isinstance(k, str):
            for x in k[1]:
                walk(x)
        elif k == TEXT:
            out.append(tuple(stack))
        else:
            name = k.lstrip("/").split(".")[0]
            if name in CONTAINERS:
                if not k.startswith("/"):
                    stack.append(k)
                else:
                    for d in range(len(stack) - 1, 0, -1):
                        if stack[d].split(".")[0] == name:
                            del stack[d:]
                            break

    for k in keys:
        walk(k)
    return out


def _anchor(path: tuple[str, ...]) -> str:
    """The container that a text counts for: the innermost part of a page, else the innermost that isn't only a form of text."""
    names = [c.split(".")[0] for c in path]
    for kind in (PARTS, CONTAINERS - FORMS):
        for c, name in zip(reversed(path), reversed(names)):
            if name in kind:
                return c
    return path[0]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty if there is none or the URL is null."""
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


class _Streams:
    """Collapsed streams, kept by token sequence: pages of a layout share them."""

    def __init__(self):
        self.memo: dict[tuple, tuple[list, str]] = {}

    def of(self, page: str) -> tuple[list[Item], str, list[str]]:
        toks = tokens(page)
        seq = tuple(t for t, _ in toks)
        if (got := self.memo.get(seq)) is None:
            if len(self.memo) >= 20_000:
                self.memo.clear()
            items = collapse(list(seq))
            got = self.memo[seq] = (items, json.dumps([i[0] for i in items]))
        return got[0], got[1], [t for _, t in toks]


def _page_slots(items: list[Item], texts: list[str]) -> list[list[str]]:
    out = []
    for _, n, leaves in items:
        own: list[list[str]] = [[] for _ in range(n)]
        for s, i in leaves:
            own[s].append(texts[i])
        out += own
    return out


_PARTIAL = "host string, sid long, stream string, pages long, hashes array<long>, same array<boolean>, chars array<long>"


def _sid(host: str, stream: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{stream}") - (1 << 63)


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and stream in a partition: pages, and of each slot, and last of the page, a hash of its text and whether it is always that; the slots' characters."""
    streams, acc = _Streams(), {}
    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            items, name, texts = streams.of(page or "")
            slots = _page_slots(items, texts)
            h = [xxhash.xxh64_intdigest("\0".join(s)) - (1 << 63) for s in [*slots, texts]]
            _add(acc, (host, name), 1, h, [True] * len(h), [sum(map(len, s)) for s in slots])
        if len(acc) >= 20_000:
            yield from _partial(acc)
            acc = {}
    yield from _partial(acc)


def _add(acc: dict, key: tuple, pages: int, h: list, same: list, size: list) -> None:
    if (a := acc.get(key)) is None:
        acc[key] = [pages, h, same, size]
    else:
        a[0] += pages
        a[2] = [x and y and p == q for x, y, p, q in zip(a[2], same, a[1], h)]
        a[3] = [x + y for x, y in zip(a[3], size)]


def _partial(acc: dict) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()))
    rows = [(h, _sid(h, s), s, *a) for (h, s), a in acc.items()]
    for i in range(0, len(rows), 500):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 500]), types)], ["host", "sid", "stream", "pages", "hashes", "same", "chars"])


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each stream, which come together, as one."""
    acc: dict = {}
    for b in batches:
        for host, _, stream, *rest in zip(*(c.to_pylist() for c in b.columns)):
            if len(acc) >= 500 and (host, stream) not in acc:
                yield from _partial(acc)
                acc = {}
            _add(acc, (host, stream), *rest)
    yield from _partial(acc)


# ------------------------------------------------------------------ the tree

_WRAPPERS = "host string, wid long, keys string, has array<long>, total long, longest long"
_ROUND = "old long, slots array<int>, host string, wid long, keys string, has array<long>, total long, longest long, kin long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _kin(keys: list) -> int:
    """A min-hash of the tokens, which wrappers with most tokens in common mostly share."""
    flat: set = set()

    def walk(k) -> None:
        if isinstance(k, str):
            flat.add(k)
        else:
            for x in k[1]:
                walk(x)

    for k in keys:
        walk(k)
    return min((xxhash.xxh64_intdigest(k) for k in flat), default=0) >> 1


def _leaf(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for host, sid, stream in zip(*(c.to_pylist() for c in b.columns)):
            keys = [_as_key(k) for k in json.loads(stream)]
            yield _written_rows([(sid, list(range(sum(map(slots_of, keys)))), host, sid, stream, [sid] * len(keys), sid, len(keys), _kin(keys))])


def _written_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["old", "slots", "host", "wid", "keys", "has", "total", "longest", "kin"])


def _merge_group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the wrappers of a group, which come together: each, longest first, with the first that is alike. A row for each old wrapper; that of the least id also has the new one's columns."""

    def merged(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        have: list[Wrapper] = []
        place: list[dict[int, list[int]]] = []
        host = rows[0][0]
        for _, wid, keys, has, total, longest in sorted(rows, key=lambda r: (-len(r[3]), r[2], r[1])):
            w = Wrapper([_as_key(k) for k in json.loads(keys)], [h & _MASK for h in has], total & _MASK, longest, [wid])
            n = sum(map(slots_of, w.keys))
            for k, other in enumerate(have):
                if (got := merge(other, w)) is not None:
                    have[k], to_a, to_b = got
                    place[k] = {i: [to_a[q] for q in m] for i, m in place[k].items()}
                    place[k][wid] = to_b
                    break
            else:
                have.append(w)
                place.append({wid: list(range(n))})
        for w, m in zip(have, place):
            wid = min(m)
            text, kin = json.dumps(w.keys), _kin(w.keys)
            has = [_signed(h) for h in w.has]
            yield _written_rows([(i, slots, host, wid, *((text, has) if i == wid else (None, None)), _signed(w.total), w.longest, kin) for i, slots in m.items()])

    key, got = None, []
    for b in batches:
        for g, *rest in zip(*(c.to_pylist() for c in b.columns)):
            if g != key:
                if got:
                    yield from merged(got)
                key, got = g, []
            got.append(tuple(rest))
    if got:
        yield from merged(got)


def _tree(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the wrappers, (sid, wid, slots) of every stream: its wrapper, and where its slots lie in it).

    Wrappers that share a min-hash are merged first, about FAN in a task, until
    none can be; then any of a host. Streams of a host end in one wrapper if they
    are alike.
    """
    parts = partitions(streams.sparkSession)
    first = materialize(streams.select("host", "sid", "stream").mapInArrow(_leaf, _ROUND), "leaves")
    now = first.select("host", "wid", "keys", "has", "total", "longest", "kin")
    place = first.select(F.col("old").alias("sid"), "wid", "slots")
    left = now.count()
    most = lambda by: now.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    for by in (["host", "kin"], ["host"]):
        turn = 0
        while (n := most(by)) > 1 and (by == ["host"] or most(["host"]) > FAN):
            sizes = now.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
            task = now.join(sizes, by).withColumn("g", F.xxhash64(*by, F.pmod(F.xxhash64("wid", F.lit(turn)), F.ceil(F.col("n") / FAN))))
            done = task.select("g", "host", "wid", "keys", "has", "total", "longest").repartition(parts, "g").sortWithinPartitions("g", "wid")
            done = materialize(done.mapInArrow(_merge_group, _ROUND), "round")
            alone = now.join(sizes, by, "left_anti")
            new = materialize(alone.unionByName(done.where("keys IS NOT NULL").select(*now.columns)), "wrappers")
            moved = done.where("old <> wid OR keys IS NOT NULL").select(F.col("old").alias("wid"), F.col("wid").alias("new"), F.col("slots").alias("to"))
            place = place.join(moved, "wid", "left").select("sid", F.coalesce("new", "wid").alias("wid"), F.expr("IF(to IS NULL, slots, transform(slots, q -> to[q]))").alias("slots"))
            place = materialize(place, "places")
            before, left = left, new.count()
            now, turn = new, turn + 1
            if n <= FAN or left == before:
                break
    return now, place


# ------------------------------------------------------- template and content


def _masses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stream the characters of its slots outside the template by the container that they count for. Columns: sid, wid, stream, slots, chars, template."""
    for b in batches:
        rows = []
        for sid, wid, stream, slots, chars, template in zip(*(c.to_pylist() for c in b.columns)):
            known = set(template or ())
            paths = _containers([_as_key(k) for k in json.loads(stream)])
            mass: dict[str, int] = defaultdict(int)
            for q, slot in enumerate(slots):
                if slot not in known:
                    mass[_anchor(paths[q])] += chars[q]
            layout = json.dumps(sorted(mass))
            rows += [(sid, wid, layout, c, m) for c, m in mass.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["sid", "wid", "layout", "anchor", "chars"])


def _content(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stream (sid, stream, slots, template, main) which of its own slots are outside the template, and which are content."""
    for b in batches:
        rows = []
        for sid, stream, slots, template, main in zip(*(c.to_pylist() for c in b.columns)):
            known = set(template or ())
            paths = _containers([_as_key(k) for k in json.loads(stream)])
            field = [slot not in known for slot in slots]
            rows.append((sid, slots, field, [f and main in p for f, p in zip(field, paths)]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.bool_())))], ["sid", "slots", "field", "main"])


def infer(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((host, wid, keys, has, total, template) of the wrappers, (sid, slots, field, main) of every stream: where its slots lie in its wrapper, which are outside the template, and which are content)."""
    spark = pages.sparkSession
    tune(spark, 500)
    parts = partitions(spark)
    src = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    part = src.mapInArrow(_gather, _PARTIAL)
    streams = materialize(part.repartition(parts, "sid").sortWithinPartitions("sid").mapInArrow(_whole, _PARTIAL), "streams")
    tree, place = _tree(streams)
    own = streams.join(place, "sid")

    # A text is template if it is one and the same in every page with text, of at least two different pages.
    text = own.where(F.size("slots") > 0)
    every = text.groupBy("wid").agg(F.sum("pages").alias("whole"), ((F.count("*") > 1) | F.min(~F.element_at("same", -1))).alias("several"))
    slot = text.select("wid", "sid", "pages", F.posexplode("slots").alias("q", "slot"), "hashes", "same")
    slot = slot.select("wid", "sid", "pages", "slot", F.expr("IF(same[q], hashes[q], NULL)").alias("h"))
    slot = slot.groupBy("wid", "slot", "sid", "pages").agg(F.min("h").alias("h0"), F.max("h").alias("h1"), F.max(F.isnull("h")).alias("varies"))
    slot = slot.groupBy("wid", "slot").agg(F.min("h0").alias("h0"), F.max("h1").alias("h1"), F.max("varies").alias("varies"), F.sum("pages").alias("seen"))
    template = slot.join(every, "wid").where("several AND NOT varies AND h0 = h1 AND seen = whole").groupBy("wid").agg(F.array_sort(F.collect_list("slot")).alias("template"))
    template = materialize(template, "template")
    own = own.join(template, "wid", "left")

    # Streams with the same containers of varying text are a layout; its content is in the container with most of it.
    mass = materialize(own.select("sid", "wid", "stream", "slots", "chars", "template").mapInArrow(_masses, "sid long, wid long, layout string, anchor string, chars long"), "masses")
    most = mass.groupBy("wid", "layout", "anchor").agg(F.sum("chars").alias("n")).groupBy("wid", "layout").agg(F.min_by("anchor", F.struct(-F.col("n"), "anchor")).alias("main"))
    main = mass.select("sid", "wid", "layout").distinct().join(most, ["wid", "layout"]).select("sid", "main")
    rows = own.join(main, "sid", "left").select("sid", "stream", "slots", "template", "main")
    rows = materialize(rows.mapInArrow(_content, "sid long, slots array<int>, field array<boolean>, main array<boolean>"), "slots")
    return tree.join(template, "wid", "left").select("host", "wid", "keys", "has", "total", "template"), rows


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, template) of every wrapper: its regular expression, and the slots of its template.

    ``pages`` needs url and html. All pages of a host take part. Where one side
    has one of a group that the other repeats, both are the repeated group.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [Wrapper([_as_key(k) for k in json.loads(keys)], has, total, 0, []).expression() for keys, has, total in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), b.column(5)], ["host", "wrapper", "template"])

    return infer(pages)[0].mapInArrow(run, "host string, wrapper string, template array<int>")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, host, sid, at, texts): each page's texts in order, and the slot of its stream that each fills."""
    streams = _Streams()
    types = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
    for b in batches:
        rows = []
        for page_id, host, page in zip(*(c.to_pylist() for c in b.columns)):
            if page is None:
                rows.append((page_id, host, None, None, None))
                continue
            items, name, texts = streams.of(page)
            at, q = {}, 0
            for _, n, leaves in items:
                for s, i in leaves:
                    at[i] = q + s
                q += n
            rows.append((page_id, host, _sid(host, name), [at[i] for i in sorted(at)], [html.unescape(texts[i]) for i in sorted(at)]))
        for i in range(0, len(rows), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 200]), types)], ["page_id", "host", "sid", "at", "texts"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, fields, content) for each row of ``pages``: the texts by slot of their wrapper, in order, and those of its layout's content container and all within it, a line each.

    ``pages`` needs page_id, url and html. Template texts (the same in every page
    with text of a wrapper with several distinct ones) aren't given; a wrapper of
    one page, or of copies of one, has none. A null html has no field and a null
    content, an empty one no field and an empty content. A null url or one
    without a host belongs to the host named by the empty string. All of a very
    long page counts. Repeated rows give a row each; of containers with equal
    text the first by name is content. Other columns are ignored. An empty table
    gives no rows. Each page meets only its own stream's slots, which are
    broadcast only while all of them are small, else joined by stream.
    """
    spark = pages.sparkSession
    tune(spark, 500)
    slots = infer(pages)[1]
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    read = src.mapInArrow(_read, "page_id long, host string, sid long, at array<int>, texts array<string>")
    size = slots.agg(F.sum(F.size("slots") * 8 + 64)).first()[0] or 0
    got = read.join(F.broadcast(slots) if size <= BROADCAST_LIMIT else slots, "sid", "left")
    fields = F.expr("transform(filter(sequence(0, size(at) - 1), i -> field[at[i]]), i -> named_struct('slot', slots[at[i]], 'text', texts[i]))")
    content = F.expr("array_join(transform(filter(sequence(0, size(at) - 1), i -> main[at[i]]), i -> texts[i]), '\n')")
    none = F.array().cast("array<struct<slot:int,text:string>>")
    few = F.col("at").isNull() | (F.size("at") == 0)
    return got.select("page_id", "host", F.when(few, none).otherwise(fields).alias("fields"), F.when(F.col("at").isNull(), F.lit(None).cast("string")).when(few, F.lit("")).otherwise(content).alias("content"))
