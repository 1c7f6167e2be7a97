"""JSON documents: canonical text, paths, and similarity by fingerprints of whole documents and fields."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from polystrata.operators import vectors


def path(c: Column, dotted: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null if absent."""
    return F.get_json_object(c, "$." + dotted)


def canonical_text(value, depth: int = 0) -> str:
    """Sorted keys, k: v; lists in brackets; texts in lower case and trimmed; [MAX_DEPTH] past five levels."""
    if depth > 5:
        return "[MAX_DEPTH]"
    if isinstance(value, dict):
        return ", ".join(f"{k}: {canonical_text(value[k], depth + 1)}" for k in sorted(value))
    if isinstance(value, list):
        return "[" + ", ".join(canonical_text(v, depth + 1) for v in value) + "]"
    if isinstance(value, str):
        return value.lower().strip()
    return json.dumps(value)


@F.pandas_udf(StringType())
def canonical(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """canonical_text() of JSON texts; null where one doesn't parse."""
    for p in parts:
        out = []
        for t in p:
            try:
                out.append(None if t is None else canonical_text(json.loads(t)))
            except ValueError:
                out.append(None)
        yield pd.Series(out, dtype=object)


def fingerprint(c: Column) -> Column:
    """Embedding of the canonical text."""
    return vectors.byte_embedding(canonical(c))


def similar(docs: DataFrame, query: str, least: float, n: int, key: str, content: str) -> DataFrame:
    """The n documents whose fingerprint has at least that cosine to a JSON query's."""
    q = docs.sparkSession.range(1).select(F.lit(query).alias("q")).select(fingerprint(F.col("q"))).first()[0]
    d = docs.select(key, F.col(content).alias("__c")).repartition(key)  # many documents can lie in one small file, which is one task
    return d.select(key, F.round(vectors.to_query(q or [])(fingerprint(F.col("__c"))), 6).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(n)


def chosen(value: dict, include: set[str] | None, exclude: set[str]) -> dict:
    return {k: v for k, v in value.items() if k not in exclude and (include is None or k in include)}


def field_prints(c: Column, include: list[str] | None = None, exclude: tuple[str, ...] = ()) -> Column:
    """Map of each top-level field that is asked for to the embedding of its canonical text; empty where the text is no object, null where it doesn't parse."""
    only, never = None if include is None else set(include), set(exclude)

    @F.pandas_udf("map<string,string>")
    def texts(p: pd.Series) -> pd.Series:
        out = []
        for t in p:
            try:
                v = None if t is None else json.loads(t)
                out.append(None if t is None else {k: canonical_text(x, 1) for k, x in chosen(v, only, never).items()} if isinstance(v, dict) else {})
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return texts(c)


def similar_field(docs: DataFrame, query: str, field: str, least: float, n: int, key: str, content: str) -> DataFrame:
    """The n documents whose print of one field has at least that cosine to a JSON query's; those without the field have none."""
    prints = lambda c: vectors.byte_embedding(F.try_element_at(field_prints(c, [field]), F.lit(field)))
    q = docs.sparkSession.range(1).select(prints(F.lit(query))).first()[0]
    d = docs.select(key, F.col(content).alias("__c")).repartition(key)  # many documents can lie in one small file, which is one task
    d = d.select(key, prints(F.col("__c")).alias("__v")).where("__v IS NOT NULL")
    return d.select(key, F.round(vectors.to_query(q or [])(F.col("__v")), 6).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(n)


def stored(old: DataFrame, new: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """JSON documents (key, content, seq) after writing some, the last of a key stays, and deleting others."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc("seq"))
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__new", "__r").join(gone.select(key).distinct(), key, "left_anti")


def field_score(sims: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Weighted mean of the fields' similarities; an absent one counts as 0 and keeps its weight."""
    total = sum(weights.values())
    out = F.lit(0.0)
    for f, w in weights.items():
        out = out + F.coalesce(sims[f], F.lit(0.0)) * w
    return out / total


def squared_score(sims: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """sum of max(s, 0)^2 w^2 / sum of w^2."""
    out = F.lit(0.0)
    for f, w in weights.items():
        s = F.greatest(F.coalesce(sims[f], F.lit(0.0)), F.lit(0.0))
        out = out + s * s * (w * w)
    return out / sum(w * w for w in weights.values())


def pretty(c: Column) -> Column:
    """A JSON text parsed and written again with indents of two, keys as they are; null where it doesn't parse."""

    @F.pandas_udf("string")
    def written(p: pd.Series) -> pd.Series:
        out = []
        for t in p:
            try:
                out.append(None if t is None else json.dumps(json.loads(t), indent=2, ensure_ascii=False))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return written(c)
