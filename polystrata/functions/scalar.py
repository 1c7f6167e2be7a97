"""Scalar functions: mathematics, series, text distances and matching, paths, encodings, generated values."""

from __future__ import annotations

import re
import textwrap
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType

from polystrata.operators.blobs import glob
from polystrata.operators.text import stem, words

# -------------------------------------------------------------------- mathematics


def cosecant(x: Column) -> Column:
    """Null where the sine is 0."""
    s = F.sin(x)
    return F.when(s != 0, 1 / s)


def factorial(n: Column) -> Column:
    """As a double: exact up to 20, by products beyond."""
    return F.when(n < 0, F.lit(None)).when(n < 2, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(1.0), lambda a, i: a * i))


def nth_root(x: Column, n: Column) -> Column:
    """Real root; of a negative number only an odd one."""
    r = F.pow(F.abs(x), 1 / n)
    return F.when(x >= 0, r).when(n % 2 == 1, -r)


def power(base: Column, exponent: Column) -> Column:
    return F.pow(base, exponent)


def perimeter(a: Column, b: Column) -> Column:
    """Of a rectangle."""
    return 2 * (a + b)


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """Linear between the points (xs sorted); the ends' values beyond them."""
    n = F.size(xs)
    i = F.size(F.filter(xs, lambda p: p <= x))
    at = lambda a, k: F.get(a, k)
    x0, x1, y0, y1 = at(xs, i - 1), at(xs, i), at(ys, i - 1), at(ys, i)
    return F.when(i == 0, at(ys, F.lit(0))).when(i >= n, at(ys, n - 1)).otherwise(y0 + (x - x0) * (y1 - y0) / (x1 - x0))


def series(spark: SparkSession, start: float, step: float, n: int = 128):
    """A table of n values from ``start``."""
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("x"))


def nan_min(c: Column) -> Column:
    """Least number of a group, without NaN; NaN where there is none."""
    return F.coalesce(F.min(F.when(~F.isnan(c), c)), F.lit(float("nan")))


def nan_max(c: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(c), c)), F.lit(float("nan")))


# ------------------------------------------------------------------------- texts


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; null for unequal lengths."""
    i = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    return F.when(F.length(a) == F.length(b), F.size(F.filter(i, lambda k: a.substr(k, F.lit(1)) != b.substr(k, F.lit(1)))))


def _sift(a: str, b: str, reach: int = 5) -> float:
    i = j = common = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            common += 1
        else:
            for k in range(1, reach):
                if i + k < len(a) and a[i + k] == b[j]:
                    i += k
                    common += 1
                    break
                if j + k < len(b) and a[i] == b[j + k]:
                    j += k
                    common += 1
                    break
        i, j = i + 1, j + 1
    return (len(a) + len(b)) / 2 - common


@F.pandas_udf(DoubleType())
def sift3(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Mean length less the characters found in common within reach of 5."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else _sift(x, y) for x, y in zip(a, b)], dtype="float64")


def _skim(text: str, pattern: str) -> int:
    """Subsequence score: 16 a character, 8 at the start of a word, 4 next to the last one, less 1 for each skipped one; the best place of each is the earliest."""
    score, at, last = 0, 0, None
    for c in pattern.lower():
        k = text.lower().find(c, at)
        if k < 0:
            return 0
        score += 16 + (8 if k == 0 or not text[k - 1].isalnum() else 0) + (4 if last is not None and k == last + 1 else 0) - (0 if last is None else min(8, k - last - 1))
        last, at = k, k + 1
    return score


@F.pandas_udf(LongType())
def fuzzymatch(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else _skim(x, y) for x, y in zip(a, b)], dtype="Int64")


def wildcard(c: Column, pattern: str) -> Column:
    return glob(c, pattern, single=True)


def matches(c: Column, regex: str) -> Column:
    """All matches of a regular expression."""
    return F.regexp_extract_all(c, F.lit(regex), F.lit(0))


def unique_words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(words(c)))


def stemmed_words(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(words(c), stem)))


def lines(c: Column) -> Column:
    return F.split(c, "\\r?\\n")


_PLAIN = str.maketrans({"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "ł": "l", "Ł": "L", "đ": "d", "ð": "d", "þ": "th", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."})


def _ascii(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", t.translate(_PLAIN)) if ord(c) < 128)


@F.pandas_udf(StringType())
def deunicode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Plain ASCII: accents go, ligatures are written out, what has no Latin form goes."""
    for p in parts:
        yield p.map(_ascii, na_action="ignore")


def wrapped(width: int):
    """Column function that breaks lines at a width, at hyphens too."""

    @F.pandas_udf(StringType())
    def wrap(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda t: "\n".join(textwrap.wrap(t, width)), na_action="ignore")

    return wrap


def expression(c: Column, query: str) -> Column:
    """A boolean text expression of quoted or bare words with and, or, not and brackets: each word must occur, in any case."""
    toks = re.findall(r'"[^"]*"|\(|\)|[^\s()]+', query)
    low = F.lower(c)
    at = 0

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(toks) and toks[at].lower() == "or":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = one()
        while at < len(toks) and toks[at].lower() not in ("or", ")"):
            if toks[at].lower() == "and":
                at += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal at
        if at >= len(toks):
            raise ValueError(f"the expression ends too soon: {query}")
        t = toks[at]
        at += 1
        if t.lower() == "not":
            return ~one()
        if t == "(":
            out = either()
            if at >= len(toks) or toks[at] != ")":
                raise ValueError(f"a bracket isn't closed: {query}")
            at += 1
            return out
        return low.contains(t.strip('"').lower())

    got = either()
    if at != len(toks):
        raise ValueError(f"what follows makes no sense: {' '.join(toks[at:])}")
    return got


def template(text: str, values: dict[str, Column]) -> Column:
    """A text with {name} replaced by the columns of those names; an unknown name stays."""
    parts = [F.coalesce(values[p[1:-1]].cast("string"), F.lit("")) if p.startswith("{") and p[1:-1] in values else F.lit(p) for p in re.split(r"(\{\w+\})", text) if p]
    return F.concat(*parts) if parts else F.lit("")


# ------------------------------------------------------------ paths and encodings


def path_split(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda p: p != "")


def filename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def base64(c: Column) -> Column:
    return F.replace(F.base64(c.cast("binary")), F.lit("\r\n"), F.lit(""))


def unbase64(c: Column) -> Column:
    return F.unbase64(c).cast("string")


def compressed(level: int = 6):
    """zlib of binary values."""
    import zlib

    @F.pandas_udf(BinaryType())
    def deflate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda b: zlib.compress(bytes(b), level), na_action="ignore")

    return deflate


@F.pandas_udf(BinaryType())
def decompressed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import zlib

    for p in parts:
        yield p.map(lambda b: zlib.decompress(bytes(b)), na_action="ignore")


# ------------------------------------------------------------------- made values


def random_ipv4(seed: int) -> Column:
    return F.concat_ws(".", *(F.floor(F.rand(seed + i) * 256).cast("int") for i in range(4)))


def random_int(low: int, high: int, seed: int) -> Column:
    """From ``low`` to ``high``, both possible."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def random_password(n: int, seed: int) -> Column:
    abc = F.lit("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789")
    return F.concat(*(abc.substr((F.floor(F.rand(seed + i) * 56) + 1).cast("int"), F.lit(1)) for i in range(n)))


def ulid(ts: Column, seed: int) -> Column:
    """48 bits of milliseconds and 80 random bits, in Crockford's base 32."""
    abc = F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ")
    ms = F.unix_millis(ts.cast("timestamp"))
    time = [abc.substr((F.shiftright(ms, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(9, -1, -1)]
    rest = [abc.substr((F.floor(F.rand(seed + i) * 32) + 1).cast("int"), F.lit(1)) for i in range(16)]
    return F.concat(*time, *rest)


