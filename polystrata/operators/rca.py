"""Root causes: pairs of events that follow one another, their support and confidence, and what they imply."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def followers(events: DataFrame, seconds: int) -> DataFrame:
    """(a, b, gap): every event with every later one, or one of the same time and a later id, at most ``seconds`` after.

    A range join by buckets of ``seconds``: the right side lies in two buckets, so
    the join is on an equal key and no two buckets are compared twice.
    """
    e = events.select("id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = seconds * 1_000_000
    left = e.select(F.col("id").alias("id_a"), F.col("key").alias("a"), F.col("us").alias("us_a"), F.floor(F.col("us") / w).alias("bucket"))
    right = e.select(F.col("id").alias("id_b"), F.col("key").alias("b"), F.col("us").alias("us_b"), F.explode(F.array(F.floor(F.col("us") / w), F.floor(F.col("us") / w) - 1)).alias("bucket"))
    later = (F.col("us_b") > F.col("us_a")) | ((F.col("us_b") == F.col("us_a")) & (F.col("id_b") > F.col("id_a")))
    return left.join(right, "bucket").where(later & (F.col("us_b") - F.col("us_a") <= w)).select("id_a", "a", "id_b", "b", ((F.col("us_b") - F.col("us_a")) / 1e6).alias("gap"))


def _by_window(events: DataFrame, seconds: int, count: Callable[..., Iterator[tuple]]) -> DataFrame:
    """(a, b, n, s, us): what ``count`` makes of the window of each event, summed by both keys.

    As in followers(), but no pair is made: a task has a bucket's events and those
    of the next one in order, and works out where each event's window begins and
    ends in it. ``count`` gives (code of a, code of b, n, sums of the gaps' seconds
    and microseconds, which are apart so that none grows too large) from the times, the codes of the keys, the places of the bucket's
    own events and the begin and end of their windows; it may go over the rows once
    for each key.
    """
    w = seconds * 1_000_000

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("us", "ascending"), ("id", "ascending")], null_placement="at_start")).combine_chunks()
        us, ids = t["us"].to_numpy(), t["id"]
        d = pc.dictionary_encode(t["key"], null_encoding="encode").combine_chunks()
        names, code = d.dictionary, d.indices.to_numpy()
        new = np.ones(len(us), bool)
        new[1:] = (us[1:] != us[:-1]) | pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy()
        begin = np.append(np.flatnonzero(new), len(us))[np.cumsum(new)]  # after all rows of one time and id
        begin = np.where(pc.is_null(ids).to_numpy(), np.searchsorted(us, us, "right"), begin)  # nothing comes after a null id at its time
        at = np.flatnonzero(t["own"].to_numpy())
        got = [x for x in count(us, code, at, begin[at], np.searchsorted(us, us[at] + w, "right")) if len(x[0])]
        x, y, *sums = (np.concatenate(c) for c in zip(*got)) if got else (np.zeros(0, np.int64),) * 5
        return pa.table({"a": names.take(pa.array(x)), "b": names.take(pa.array(y)), **{c: pa.array(v, pa.int64()) for c, v in zip(("n", "s", "us"), sums)}})

    e = events.select("id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where("us IS NOT NULL")
    at = F.floor(F.col("us") / w)
    e = e.select("*", F.inline(F.array(F.struct(at.alias("bucket"), F.lit(True).alias("own")), F.struct((at - 1).alias("bucket"), F.lit(False).alias("own")))))
    return e.groupBy("bucket").applyInArrow(run, "a string, b string, n long, s long, us long").groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "s", "us")))


def _sums(of: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct numbers of ``of``, and sums of each of ``values`` by them."""
    if not len(of):
        return [of, *values]
    o = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.diff(of[o], prepend=of[o[0]] - 1))
    return [of[o][first], *(np.add.reduceat(v[o], first) for v in values)]


def _all_pairs(us, code, at, begin, end) -> Iterator[tuple]:
    """Every event of a window: differences of running counts and sums of each key."""
    rel = us - us[0]
    for b in np.unique(code):
        n, s = np.append(0, np.cumsum(code == b)), np.append(0, np.cumsum(np.where(code == b, rel, 0)))
        c = n[end] - n[begin]
        a, c, *gaps = _sums(code[at], c, *divmod(s[end] - s[begin] - rel[at] * c, 1_000_000))
        yield a[c > 0], np.full((c > 0).sum(), b, a.dtype), c[c > 0], *(g[c > 0] for g in gaps)


def _first_of_others(us, code, at, begin, end) -> Iterator[tuple]:
    """Of each other key the first event of a window."""
    for b in np.unique(code):
        of = np.flatnonzero(code == b)
        nxt = np.append(of, len(us))[np.searchsorted(of, begin)]
        hit = (nxt < end) & (code[at] != b)
        a, *sums = _sums(code[at[hit]], np.ones(hit.sum(), np.int64), *divmod(us[nxt[hit]] - us[at[hit]], 1_000_000))
        yield a, np.full(len(a), b, a.dtype), *sums


def _mean_gap() -> Column:
    return F.round((F.col("s") * 1e6 + F.col("us")) / F.col("n") / 1e6, 6).alias("mean_gap")


def co_occurrences(events: DataFrame, seconds: int) -> DataFrame:
    """(a, b, n, mean_gap): how often b follows a within the window."""
    return _by_window(events, seconds, _all_pairs).select("a", "b", "n", _mean_gap())


def patterns(events: DataFrame, seconds: int, support: float, confidence: float, least: int = 2) -> DataFrame:
    """(a, b, n, support, confidence, mean_gap): anchors of key a that any b follows in time, over the number of windows and of a's."""
    n = _by_window(events.where("key IS NOT NULL"), seconds, _first_of_others).select("a", "b", "n", _mean_gap())
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    whole = events.agg(F.greatest(F.floor((F.max(us) - F.min(us)) / (seconds * 1_000_000)), F.lit(1)).alias("windows"))
    of = events.groupBy(F.col("key").alias("a")).agg(F.count("*").alias("of_a"))
    g = n.join(of, "a").crossJoin(F.broadcast(whole))  # one row
    g = g.select("a", "b", "n", F.round(F.col("n") / F.col("windows"), 6).alias("support"), F.round(F.col("n") / F.col("of_a"), 6).alias("confidence"), "mean_gap")
    return g.where((F.col("n") >= least) & (F.col("support") >= support) & (F.col("confidence") >= confidence))


def causal_links(found: DataFrame) -> DataFrame:
    """Cause and effect with the greatest confidence of any pattern that has them."""
    return found.groupBy(F.col("a").alias("cause"), F.col("b").alias("effect")).agg(F.max("confidence").alias("confidence"))


def roots(found: DataFrame, confidence: float, least: int) -> DataFrame:
    """Keys that begin a pattern of more than that confidence and at least so many occurrences."""
    return found.where((F.col("confidence") > confidence) & (F.col("n") >= least)).select(F.col("a").alias("root")).distinct()


def impact(found: DataFrame, root: DataFrame) -> DataFrame:
    """Each root's co-members, in order."""
    m = found.join(root.withColumnRenamed("root", "a"), "a", "left_semi")
    return m.groupBy(F.col("a").alias("root")).agg(F.sort_array(F.collect_set("b")).alias("affects"))


def correlation(found: DataFrame, root: DataFrame) -> DataFrame:
    """Root by root: confidence of the pattern between them, 1 on the diagonal, 0 where there is none."""
    every = root.agg(F.collect_set("root").alias("r"))  # a key a root: as few as there are kinds of event
    p = every.select(F.explode("r").alias("a"), "r").select("a", F.explode("r").alias("b"))
    return p.join(found.select("a", "b", "confidence"), ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


ADVICE = ("Monitor this event and alert on it", "Look for the cause before its effects", "Add a guard against the cascade", "Review changes made before it", "Keep its effects apart from it")  #: what is suggested, by place


def recommendations(found: DataFrame) -> DataFrame:
    """Roots by their greatest confidence; the first three are HIGH, others MEDIUM; suggestions go round."""
    r = found.groupBy(F.col("a").alias("root")).agg(F.max("confidence").alias("confidence"))
    n = F.row_number().over(Window.orderBy(F.desc("confidence"), "root"))  # one row a key
    advice = F.array(*(F.lit(x) for x in ADVICE))
    return r.withColumn("place", n).withColumn("priority", F.when(F.col("place") <= 3, "HIGH").otherwise("MEDIUM")).withColumn("advice", F.get(advice, F.pmod(F.col("place") - 1, F.lit(len(ADVICE)))))


def whole_windows(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """(n): how many events there are, of any key, from which all of ``keys`` occur within the window: at its time or later, in the order of time and id.

    Events fall in buckets of the window's length, and only the next time of each
    wanted key is looked up, in the event's bucket and the one after it.
    """
    w = seconds * 1_000_000
    e = events.select("id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    at = F.floor(F.col("us") / w)
    wanted = e.where(F.col("key").isin(keys)).select(F.explode(F.array(at, at - 1)).alias("bucket"), "us", "id", "key")
    both = e.select(at.alias("bucket"), "us", "id", F.lit(None).cast("string").alias("key"), F.lit(True).alias("anchor")).unionByName(wanted.withColumn("anchor", F.lit(False)))
    # Backwards, so that the frame only grows: one with no end is worked out anew for each row. An anchor sees itself: of rows of one time and id it comes last.
    ahead = Window.partitionBy("bucket").orderBy(F.desc("us"), F.desc("id"), "anchor").rowsBetween(Window.unboundedPreceding, 0)
    nexts = [F.last(F.when(F.col("key") == k, F.col("us")), ignorenulls=True).over(ahead).alias(f"n{i}") for i, k in enumerate(keys)]
    seen = both.select("anchor", "us", *nexts).where("anchor")
    fits = F.lit(True)
    for i in range(len(keys)):
        fits = fits & (F.col(f"n{i}") - F.col("us") <= w)
    return seen.agg(F.count_if(F.coalesce(fits, F.lit(False))).alias("n"))


def by_frequency(events: DataFrame, keys: list[str]) -> DataFrame:
    """(place, key, n): the members of a pattern by how often they occur in all, the rarest first, ties by key."""
    n = events.where(F.col("key").isin(keys)).groupBy("key").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy("n", "key")))  # one row a member


def chains(links: DataFrame, least: float = 0.0) -> list[list[str]]:
    """Causal chains, one pass over the links (a row a pair of keys, few) by falling confidence: each goes on the first chain that ends in its cause and lacks its effect, else begins one."""
    rows = links.where(F.col("confidence") >= least).select("cause", "effect", "confidence").collect()
    out: list[list[str]] = []
    for r in sorted(rows, key=lambda r: (-r["confidence"], r["cause"], r["effect"])):
        for c in out:
            if c[-1] == r["cause"] and r["effect"] not in c:
                c.append(r["effect"])
                break
        else:
            out.append([r["cause"], r["effect"]])
    return out


def report(found: DataFrame, confidence: float, least: int) -> DataFrame:
    """(roots, patterns, links, affected, strongest): a row that sums up what was found."""
    r = roots(found, confidence, least).agg(F.array_sort(F.collect_list("root")).alias("roots"))
    p = found.agg(F.count("*").alias("patterns"), F.countDistinct("a", "b").alias("links"), F.countDistinct("b").alias("affected"), F.max(F.struct("confidence", F.concat_ws(" -> ", "a", "b").alias("p")))["p"].alias("strongest"))
    return r.crossJoin(F.broadcast(p))  # one row each
