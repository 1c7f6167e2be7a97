"""Series statistics: seasonal outliers, outlying series, break points, and time-warped distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _normal_quantile(p: float) -> float:
    """Of the standard normal, by bisection of its error function."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return (lo + hi) / 2


def student_quantile(p: float, df: float) -> float:
    """Of Student's t, by bisection of its distribution, which is summed by Simpson's rule."""
    if df > 400:
        z = _normal_quantile(p)
        return z + (z**3 + z) / (4 * df)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def cdf(t: float) -> float:
        # With t = sqrt(df) tan(a) the density is c sqrt(df) cos(a)^(df - 1) over a bounded range.
        x = np.linspace(0, math.atan(t / math.sqrt(df)), 2001)
        y = np.cos(x) ** (df - 1)
        return 0.5 + c * math.sqrt(df) * float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3)

    lo, hi = 0.0, 1e6
    for _ in range(120):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def seasonal_outliers(x: np.ndarray, period: int, share: float = 0.1, alpha: float = 0.05) -> list[int]:
    """Seasonal hybrid ESD: residuals from the median and the median of each phase; the most extreme by median and absolute deviation is taken out, time after time, at most a share of all; what counts is up to the last one beyond its critical value of the generalised ESD test at level ``alpha``."""
    x = np.asarray(x, float)
    n = len(x)
    phase = np.arange(n) % period
    season = np.array([np.median(x[phase == p]) if (phase == p).any() else 0.0 for p in range(period)])
    r = x - season[phase] if n >= 2 * period else x - np.median(x) if n else x
    left, out, last = np.arange(n), [], 0
    for i in range(1, int(n * share) + 1):
        if n - i - 1 < 1:
            break
        v = r[left]
        m = np.median(v)
        d = np.median(np.abs(v - m)) * 1.4826
        if d == 0:
            break
        k = int(np.argmax(np.abs(v - m)))
        t = student_quantile(1 - alpha / (2 * (n - i + 1)), n - i - 1)
        out.append(int(left[k]))
        if abs(v[k] - m) / d > (n - i) * t / math.sqrt((n - i - 1 + t * t) * (n - i + 1)):
            last = i
        left = np.delete(left, k)
    return sorted(out[:last])


def outlier_intervals(x: np.ndarray, bound: float = 3.0) -> list[tuple[int, int]]:
    """Runs of values further than ``bound`` absolute deviations from the median, as [from, to)."""
    x = np.asarray(x, float)
    if not len(x):
        return []
    m = np.median(x)
    d = np.median(np.abs(x - m)) * 1.4826
    far = np.abs(x - m) > bound * d if d else np.abs(x - m) > 0
    e = np.flatnonzero(np.diff(np.concatenate([[False], far, [False]]).astype(np.int8)))
    return list(zip(e[0::2].tolist(), e[1::2].tolist()))


def breakouts(x: np.ndarray, least: int = 24, beta: float = 0.008, degree: int = 2, exponent: float = 1.0) -> list[int]:
    """E-divisive by medians with several breakouts: the segmentation that maximises, over all breaks, the energy between the two segments at each less a penalty beta * their number to the power ``degree`` - 1, by dynamic programming over the last break.

    Values are scaled to 0..1. The energy between two segments is
    2 E|A - B|^e - E|A - A'|^e - E|B - B'|^e, weighed by the segments' sizes, from
    within-segment sums that are kept for each pair of ends.
    """
    x = np.asarray(x, float)
    n = len(x)
    if n < 2 * least or x.max() == x.min():
        return []
    z = (x - x.min()) / (x.max() - x.min())
    d = np.abs(z[:, None] - z[None, :]) ** exponent
    c = np.zeros((n + 1, n + 1))
    c[1:, 1:] = d.cumsum(0).cumsum(1)
    area = lambda a, b, e, f: c[b, f] - c[a, f] - c[b, e] + c[a, e]  # noqa: E731  sum of d over [a, b) x [e, f)
    best, prev, count = np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for s in range(2 * least, n + 1):
        t = np.arange(least, s - least + 1)
        u = prev[t]  # the segment before the break begins here
        a, b = t - u, s - t
        gain = 2 * area(u, t, t, s) / (a * b) - area(u, t, u, t) / (a * a) - area(t, s, t, s) / (b * b)
        value = best[t] + gain * a * b / (a + b) / n - beta * (count[t] + 1) ** (degree - 1)
        k = int(value.argmax())
        if value[k] > best[s]:
            best[s], prev[s], count[s] = value[k], t[k], count[t[k]] + 1
    out, s = [], n
    while prev[s]:
        out.append(int(prev[s]))
        s = prev[s]
    return sorted(out)


def dbscan(dist: np.ndarray, reach: float, least: int = 2) -> list[int]:
    """The cluster of each row of a distance matrix, from 0; -1 for noise. A row is a core if ``least`` rows, itself one, are within ``reach``."""
    near = dist <= reach
    core = near.sum(1) >= least
    label = [-1] * len(dist)
    n = 0
    for i in range(len(dist)):
        if not core[i] or label[i] >= 0:
            continue
        todo = [i]
        label[i] = n
        while todo:
            k = todo.pop()
            if core[k]:
                for j in np.flatnonzero(near[k]):
                    if label[j] < 0:
                        label[j] = n
                        todo.append(int(j))
        n += 1
    return label


def outlying(series: list[np.ndarray], how: str = "mad", bound: float = 3.0) -> list[list[tuple[int, int]]]:
    """Of several series of one length, at which places each lies apart from the others, as [from, to): by median and absolute deviation of the values there, or by DBSCAN, with ``bound`` as reach, as noise."""
    x = np.array(series, float)
    if how == "mad":
        m = np.median(x, 0)
        d = np.median(np.abs(x - m), 0) * 1.4826
        far = np.where(d > 0, np.abs(x - m) > bound * np.where(d > 0, d, 1), np.abs(x - m) > 0)
    else:
        far = np.array([[v < 0 for v in dbscan(np.abs(x[:, [k]] - x[:, k]), bound)] for k in range(x.shape[1])], bool).reshape(x.shape[1], len(x)).T
    out = []
    for f in far:
        e = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
        out.append(list(zip(e[0::2].tolist(), e[1::2].tolist())))
    return out


def clusters(series: list[np.ndarray], reach: float, least: int = 2) -> list[int]:
    """DBSCAN of series by their time-warped distance."""
    n = len(series)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            d[i, j] = d[j, i] = dtw(series[i], series[j])
    return dbscan(d, reach, least)


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping distance, by absolute differences."""
    d = np.full(len(b) + 1, np.inf)
    d[0] = 0
    for x in a:
        new = np.full(len(b) + 1, np.inf)
        for j, y in enumerate(b, 1):
            new[j] = abs(x - y) + min(d[j], new[j - 1], d[j - 1])
        d = new
    return float(d[-1])


#: Of a time slice: the most points that a worker looks at at once.
SLICE = 2048


def per_series(t: DataFrame, what: str, by: str = "key", hours: float = 24 * 7, **options) -> DataFrame:
    """(by, slice, position): break points or seasonal outliers of every series of a telemetry table, slice of time by slice, position counted in the slice.

    A slice is ``hours`` long; its rows are first averaged to at most SLICE points
    of equal time where it has more, so that a worker holds no more than that,
    however long and dense the series.
    """
    found = {"breakouts": breakouts, "seasonal": seasonal_outliers}[what]
    width = hours * 3600
    us = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    d = t.select(by, F.floor(us / width).alias("slice"), us.alias("at"), "id", F.col("value").cast("double").alias("value")).where("value IS NOT NULL")
    n = d.groupBy(by, "slice").agg(F.count("*").alias("n"))
    d = d.join(n, [by, "slice"]).withColumn("cell", F.when(F.col("n") > SLICE, F.floor((F.col("at") - F.col("slice") * width) / width * SLICE)))
    dense = d.where("n > " + str(SLICE)).groupBy(by, "slice", "cell").agg(F.avg("value").alias("value"), F.min("at").alias("at")).select(by, "slice", "at", F.lit(0).cast("long").alias("id"), "value")
    d = d.where("n <= " + str(SLICE)).select(by, "slice", "at", F.col("id").cast("long").alias("id"), "value").unionByName(dense)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["at", "id"])
        at = found(p["value"].to_numpy(), **options)
        return pd.DataFrame({by: pd.Series([p[by].iloc[0]] * len(at), dtype=object), "slice": pd.Series([p["slice"].iloc[0]] * len(at), dtype="int64"), "position": pd.Series(at, dtype="int64")})

    return d.groupBy(by, "slice").applyInPandas(run, f"{by} string, slice long, position long")


def hourly(t: DataFrame, by: str = "key") -> DataFrame:
    """(hour, values): the mean of each series in each hour, by series, as a map: what outlying() and clusters() compare."""
    g = t.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), by).agg(F.avg("value").alias("v"))
    return g.groupBy("hour").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "v")))).alias("values"))
