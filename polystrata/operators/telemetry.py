"""Telemetry: typed time series with keys, sources and primary/secondary links.

A telemetry table has id, ts, key, source, kind (float, int, string, json, ...),
value (its number, null if it has none), text (its text form), is_primary,
primary_id and metadata.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def from_events(events: DataFrame) -> DataFrame:
    """The telemetry form of an events table. The first event of a user is primary; later ones link to it."""
    first = Window.partitionBy("user_id")
    t = events.withColumn("__primary", F.min(F.struct("ts", "event_id")).over(first)["event_id"])
    return t.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("key"), F.concat(F.lit("user_"), F.col("user_id")).alias("source"), F.lit("float").alias("kind"), "value", F.col("value").cast("string").alias("text"),
        (F.col("event_id") == F.col("__primary")).alias("is_primary"), F.when(F.col("event_id") != F.col("__primary"), F.col("__primary")).alias("primary_id"), F.col("props").alias("metadata"),
    )


def plain(events: DataFrame) -> DataFrame:
    """As from_events(), without links: a projection that needs no shuffle."""
    return events.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("key"), F.concat(F.lit("user_"), F.col("user_id")).alias("source"), F.lit("float").alias("kind"), "value", F.col("props").alias("metadata"))


def _any_in(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def search(t: DataFrame, start=None, end=None, keys: Sequence[str] = (), sources: Sequence[str] = (), primary: bool | None = None, primary_id=None, kind: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """All given predicates hold: inclusive times, any substring of keys, any of sources, primary or secondary, link, kind. Newest first, ties by id, when a limit is given."""
    if start is not None:
        t = t.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        t = t.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if keys:
        t = t.where(_any_in(F.col("key"), keys))
    if sources:
        t = t.where(_any_in(F.col("source"), sources))
    if primary is not None:
        t = t.where(F.col("is_primary") == primary)
    if primary_id is not None:
        t = t.where(F.col("primary_id") == primary_id)
    if kind is not None:
        t = t.where(F.col("kind") == kind)
    if limit is not None or offset:
        t = t.orderBy(F.desc("ts"), "id")
        t = t.offset(offset) if offset else t
        t = t.limit(limit) if limit is not None else t
    return t


def bounds(t: DataFrame) -> DataFrame:
    """First and last time; nulls for an empty table."""
    return t.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def buckets(t: DataFrame, unit: str = "minute", by: Sequence[str] = ()) -> DataFrame:
    """Count of rows and sum, mean, least and most of the numbers of each time bucket."""
    return t.groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket"), *by).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def bucket_stats(t: DataFrame) -> DataFrame:
    """Statistics by minute label: the mean is 0 where nothing is numeric, the sum null unless positive."""
    g = t.groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("bucket")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.sum("value").alias("s"), F.min("value").alias("least"), F.max("value").alias("most"))
    return g.select("bucket", "n", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean"), F.when(F.col("s") > 0, F.round("s", 6)).alias("total"), "least", "most")


def hourly_patterns(t: DataFrame, score: Column) -> DataFrame:
    """By hour: count, and mean, most and least of a similarity; the most is at least 0, the least at most 1."""
    return t.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.greatest(F.lit(0.0), F.max(score)), 6).alias("most"), F.round(F.least(F.lit(1.0), F.min(score)), 6).alias("least")
    )


def downsample(t: DataFrame, minutes: int = 5) -> DataFrame:
    """Mean of each key in windows of some minutes."""
    w = F.window("ts", f"{minutes} minutes")
    return t.groupBy("key", w).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select("key", F.col("window.start").cast("timestamp_ntz").alias("bucket"), "n", "mean")


def minute_window(t: DataFrame) -> DataFrame:
    """The minute of each row and its neighbours."""
    m = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    return t.select("id", m.alias("minute"), (m - F.expr("INTERVAL 1 MINUTE")).alias("before"), (m + F.expr("INTERVAL 1 MINUTE")).alias("after"))


def secondaries(t: DataFrame) -> DataFrame:
    """The secondary rows of each primary."""
    s = t.where("NOT is_primary").select(F.col("id").alias("secondary_id"), F.col("primary_id").alias("id"), F.col("ts").alias("secondary_ts"))
    return t.where("is_primary").select("id", "key").join(s, "id")


def primary_of(t: DataFrame) -> DataFrame:
    """Each secondary with its primary's key and time."""
    p = t.where("is_primary").select(F.col("id").alias("primary_id"), F.col("key").alias("primary_key"), F.col("ts").alias("primary_ts"))
    return t.where("NOT is_primary").select("id", "primary_id").join(p, "primary_id")


def latest(t: DataFrame, n: int, by: Sequence[str] = ("key",)) -> DataFrame:
    """The newest n rows of each group, newest first, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("id"))
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def smoothed(t: DataFrame, n: int = 3, by: Sequence[str] = ("key",), seconds: int = 3600) -> DataFrame:
    """Moving average of the last n values of each series, partial at its start.

    A series is cut into slices of time, and each slice gets the n - 1 last rows
    before it, so that no task sorts a whole series.
    """
    d = t.withColumn("__at", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds))
    tail = Window.partitionBy(*by, "__at").orderBy(F.desc("ts"), F.desc("id"))
    last = d.select(*by, "__at", "ts", "id", "value", F.row_number().over(tail).alias("__r")).where(F.col("__r") < n)
    ends = last.groupBy(*by, "__at").agg(F.collect_list(F.struct("ts", "id", "value")).alias("__end"))
    # The n - 1 rows before a slice are among the ends of the n - 1 slices before it; there is a row a slice.
    before = Window.partitionBy(*by).orderBy("__at").rowsBetween(1 - n, -1)
    halo = ends.select(*by, "__at", F.flatten(F.collect_list("__end").over(before)).alias("__ends"))
    halo = halo.select(*by, "__at", F.explode(F.slice(F.reverse(F.array_sort("__ends")), 1, n - 1)).alias("__h"))
    halo = halo.select(*by, "__at", "__h.ts", "__h.id", "__h.value", F.lit(True).alias("__halo"))
    both = d.withColumn("__halo", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy(*by, "__at").orderBy("ts", "id").rowsBetween(1 - n, 0)
    return both.withColumn("smooth", F.round(F.avg("value").over(w), 6)).where("NOT __halo").drop("__at", "__halo")


def normalised(t: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """Min-max scale of each series; a constant one stays as it is. The bounds, one row a series, are aggregated and joined."""
    bounds_ = t.groupBy(*by).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    d = t.join(bounds_.toDF(*(f"__b{i}" for i in range(len(by))), "__lo", "__hi"), reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(by)))).drop(*(f"__b{i}" for i in range(len(by))))
    lo, hi = F.col("__lo"), F.col("__hi")
    return d.withColumn("scaled", F.round(F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.col("value")), 6)).drop("__lo", "__hi")


def occurrences(t: DataFrame, seconds: float) -> DataFrame:
    """Running number, from 0, of each row among those of its source and key, and the key before it in its source if at most ``seconds`` before."""
    w = Window.partitionBy("source").orderBy("ts", "id")
    own = Window.partitionBy("source", "key").orderBy("ts", "id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")
    return t.select("id", "source", "key", (F.row_number().over(own) - 1).alias("occurrence"), F.when(gap <= seconds, F.lag("key").over(w)).alias("previous"))


def means(t: DataFrame, by: Sequence[str] = ("key",), weight: Column | None = None) -> DataFrame:
    """Arithmetic, geometric and harmonic means, plain and weighted, over positive values for the last two."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    v = F.col("value")
    pos = F.when(v > 0, v)
    return t.groupBy(*by).agg(
        F.count("value").alias("n"), F.round(F.avg(v), 6).alias("arithmetic"), F.round(F.exp(F.avg(F.ln(pos))), 6).alias("geometric"), F.round(F.count(pos) / F.sum(1 / pos), 6).alias("harmonic"),
        F.round(F.sum(v * w) / F.sum(w), 6).alias("arithmetic_weighted"), F.round(F.exp(F.sum(F.ln(pos) * w) / F.sum(F.when(v > 0, w))), 6).alias("geometric_weighted"), F.round(F.sum(F.when(v > 0, w)) / F.sum(w / pos), 6).alias("harmonic_weighted"),
    )


def harmonic_spread(t: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """Harmonic mean h and its spread: the standard error of the mean of reciprocals, carried to h as h^2 s."""
    x = 1 / F.when(F.col("value") > 0, F.col("value"))
    h = 1 / F.avg(x)
    return t.groupBy(*by).agg(F.round(h, 6).alias("harmonic"), F.round(h * h * F.sqrt(F.var_pop(x) / F.count(x)), 6).alias("spread"))


def percentiles(t: DataFrame, by: Sequence[str] = ("key",), shares: Sequence[float] = (0.5, 0.95, 0.99), cells: int = 4096) -> DataFrame:
    """Interpolated percentiles of each group, exactly.

    Values are counted in ``cells`` cells between a group's least and greatest, and
    only the cells that hold a wanted rank are looked into, value by value; so no
    task holds the values of a group. Groups without a number have nulls.
    """
    keys = [F.col(c) for c in by]
    v = t.select(*keys, F.col("value").cast("double").alias("__v"))
    span = v.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count("__v").alias("__n"))
    named = span.toDF(*(f"__b{i}" for i in range(len(by))), "__lo", "__hi", "__n")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate(by)))
    cell = F.least(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * cells), F.lit(cells - 1))
    placed = v.where("__v IS NOT NULL").join(named, same).select(*(f"__b{i}" for i in range(len(by))), "__v", "__n", F.when(F.col("__hi") > F.col("__lo"), cell).otherwise(0).alias("__c"))
    ids = [f"__b{i}" for i in range(len(by))]
    part = Window.partitionBy(*ids)
    counts = placed.groupBy(*ids, "__c").agg(F.count("*").alias("__k"), F.first("__n").alias("__n"))
    counts = counts.withColumn("__before", F.sum("__k").over(part.orderBy("__c")) - F.col("__k"))
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(shares)))
    rank = counts.select(*ids, "__c", "__k", "__before", "__n", F.explode(at).alias("x")).withColumn("__pos", F.col("x.p") * (F.col("__n") - 1))
    rank = rank.select(*ids, "__c", "__before", "__k", F.col("x.i").alias("i"), F.explode(F.array(F.struct(F.floor("__pos").alias("r"), (1 - F.col("__pos") + F.floor("__pos")).alias("w")), F.struct((F.floor("__pos") + 1).alias("r"), (F.col("__pos") - F.floor("__pos")).alias("w")))).alias("y"))
    rank = rank.where("y.w > 0 AND y.r >= __before AND y.r < __before + __k").select(*ids, "__c", "__before", "i", "y.r", "y.w")
    values = placed.join(rank.select(*ids, "__c").distinct(), _safe(placed, rank, [*ids, "__c"]), "left_semi").groupBy(*ids, "__c", "__v").agg(F.count("*").alias("__k"))
    values = values.withColumn("__first", F.sum("__k").over(Window.partitionBy(*ids, "__c").orderBy("__v")) - F.col("__k"))
    r = rank.toDF(*(f"r{c}" for c in ids), "rc", "before", "i", "r", "w")
    on = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"r{c}")) for c in ids)) & (F.col("__c") == F.col("rc")) & (F.col("r") - F.col("before") >= F.col("__first")) & (F.col("r") - F.col("before") < F.col("__first") + F.col("__k"))
    got = values.join(r, on).groupBy(*ids, "i").agg(F.sum(F.col("__v") * F.col("w")).alias("q"))
    wide = got.groupBy(*ids).agg(*(F.max(F.when(F.col("i") == i, F.round("q", 6))).alias(f"p{round(p * 100)}") for i, p in enumerate(shares)))
    return span.select(*keys).join(wide, same, "left").drop(*ids)


def _safe(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, (a[c].eqNullSafe(b[c]) for c in columns))


def distinct_by_fingerprint(t: DataFrame) -> DataFrame:
    """The first row of each key, source and value, and how many repeat it; times don't matter."""
    return t.groupBy("key", "source", "value").agg(F.min(F.struct("ts", "id")).alias("f"), F.count("*").alias("n")).select("key", "source", "value", F.col("f.id").alias("id"), (F.col("n") - 1).alias("repeats"))


def frequent_keys(t: DataFrame, least: int) -> DataFrame:
    """Keys of at least so many rows."""
    return t.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def window_count(t: DataFrame, seconds: float) -> DataFrame:
    """How many windows of some seconds the rows span; at least 1."""
    e = F.col("ts").cast("timestamp").cast("double")
    return t.agg(F.greatest(F.floor((F.max(e) - F.min(e)) / seconds), F.lit(1)).cast("long").alias("windows"))


def coerced(c: Column) -> list[Column]:
    """A text as float, as int (truncated), as bool and as text, null where it isn't one."""
    f = c.try_cast("double")
    return [f.alias("as_float"), (F.signum(f) * F.floor(F.abs(f))).cast("long").alias("as_int"), c.try_cast("boolean").alias("as_bool"), c.alias("as_text")]


def time_label(ts: Column, every: int, unit: str, offset_minutes: int = 0) -> Column:
    """Label of the bucket of some minutes, hours, days, weeks or months that a time is in, at an offset from UTC."""
    t = ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(offset_minutes)) if offset_minutes else ts
    if unit == "minutes":
        m = (F.floor(F.minute(t) / every) * every).cast("int")
        return F.concat(F.date_format(t, "yyyy-MM-dd HH:"), F.lpad(m.cast("string"), 2, "0"))
    if unit == "hours":
        return F.concat(F.date_format(t, "yyyy-MM-dd "), F.lpad((F.floor(F.hour(t) / every) * every).cast("string"), 2, "0"))
    if unit == "days":
        return F.concat(F.date_format(t, "yyyy-MM-"), F.lpad((F.floor(F.dayofmonth(t) / every) * every).cast("string"), 2, "0"))
    if unit == "weeks":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad((F.floor(F.weekofyear(t) / every) * every).cast("string"), 2, "0"))
    if unit == "months":
        return F.concat(F.date_format(t, "yyyy-"), F.lpad((F.floor((F.month(t) - 1) / every) * every + 1).cast("string"), 2, "0"))
    raise ValueError(f"no such unit: {unit}")


# ------------------------------------------------------------------------ writes


def written(t: DataFrame, path: str) -> DataFrame:
    """Writes telemetry in folders by its day, and reads it back; a filter on bucket reads only its folders. A day is written by one task, or by several where it is large."""
    t.withColumn("bucket", F.date_format("ts", "yyyyMMdd")).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return t.sparkSession.read.schema(t.withColumn("bucket", F.lit("")).schema).parquet(path)


def in_range(stored: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of an inclusive range of time from what written() gives: buckets outside of it are pruned."""
    lo, hi = (F.date_format(F.lit(x).cast("timestamp_ntz"), "yyyyMMdd") for x in (start, end))
    return stored.where(F.col("bucket").between(lo, hi) & F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def since(as_of: str, unit: str) -> Column:
    """The beginning of the last hour, day, week or month (30 days) before a time."""
    return F.lit(as_of).cast("timestamp_ntz") - F.expr({"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 30 DAYS"}[unit])


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, in UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def linked(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links (primary_id, secondary_id) after writing more: each once, none of a row with itself."""
    return links.unionByName(new).where("primary_id <> secondary_id").distinct()


def bucket_records(t: DataFrame, newest: int | None = None) -> DataFrame:
    """(bucket, n, ids) by minute label, ids oldest first; only of the ``newest`` rows, if given."""
    if newest is not None:
        t = t.orderBy(F.desc("ts"), F.desc("id")).limit(newest)
    g = t.groupBy(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("bucket"))
    return g.agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"]).alias("ids"))


def hour_index(t: DataFrame, most: int = 10_000) -> DataFrame:
    """(hour, n, ids): the first ``most`` ids of each hour, in order of time; how many there are."""
    w = Window.partitionBy("hour").orderBy("ts", "id")
    h = t.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "id").withColumn("r", F.row_number().over(w))
    return h.groupBy("hour").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "id")))), lambda x: x["id"]).alias("ids"))


def telemetry_id(t: DataFrame, *columns: str) -> Column:
    """An id that only what a row holds decides: equal rows have equal ids on any run."""
    return F.concat(F.lit("telemetry_"), F.substring(F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256), 1, 16))
