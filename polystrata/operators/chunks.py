"""Chunks of documents for retrieval: fixed windows, sentence and paragraph packing, context, expansion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(docs: DataFrame, size: int = 512, overlap: int = 50, least: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, start, content): windows of ``size`` characters, one every size - overlap; those under ``least`` characters are left out, but for a text's only one."""
    step = size - overlap
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    d = docs.where(F.length(text) > 0).select(key, text, n.alias("__n"), F.posexplode(starts).alias("chunk", "start"))
    content = F.substring(F.col(text), F.col("start") + 1, F.lit(size))
    return d.where((F.least(F.col("__n") - F.col("start"), F.lit(size)) >= least) | (F.col("chunk") == 0)).select(key, "chunk", "start", content.alias("content"))


def sentences(text: Column) -> Column:
    """Texts between ends of sentences, trimmed; blank ones are left out."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?])\\s+"), F.trim), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\\n\\n"), F.trim), lambda s: s != "")


_CHUNK = "chunk int, start int, stop int, paragraph int, sentence int, content string, before string, after string"


def _pack(text: str, size: int, overlap: int, context: int) -> list[dict]:
    """Whole sentences up to ``size`` characters; the next chunk begins with the last ones that fit in ``overlap``. Offsets are true ones."""
    import re

    spans, p = [], 0
    for par in re.finditer(r"(?:(?!\n\n).)+", text, re.S):
        begun = par.start()
        for m in re.finditer(r".+?(?:[.!?]+(?=\s|\Z)|\Z)", par.group(), re.S):
            s = m.group()
            a = begun + m.start() + len(s) - len(s.lstrip())
            b = begun + m.end() - (len(s) - len(s.rstrip()))
            if b > a:
                spans.append((a, b, p))
        p += 1
    out, i = [], 0
    while i < len(spans):
        j = i + 1
        while j < len(spans) and spans[j][1] - spans[i][0] <= size:
            j += 1
        a, b = spans[i][0], spans[j - 1][1]
        out.append({"chunk": len(out), "start": a, "stop": b, "paragraph": spans[i][2], "sentence": i, "content": text[a:b], "before": text[max(0, a - context) : a], "after": text[b : b + context]})
        if j == len(spans):
            break
        k = j
        while k - 1 > i and spans[j - 1][1] - spans[k - 1][0] <= overlap:
            k -= 1
        i = k
    return out


def packed(docs: DataFrame, size: int = 512, overlap: int = 50, context: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of whole sentences, with their place and the characters around them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [{key: k, **c} for k, t in zip(p[key], p[text]) if t for c in _pack(t, size, overlap, context)]
            if rows:
                yield pd.DataFrame(rows)

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, {_CHUNK}")


def stats(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents, chunks, and chunks a document."""
    c = chunks.groupBy(key).agg(F.count("*").alias("c"))
    return docs.select(key).join(c, key, "left").agg(F.count("*").alias("documents"), F.sum(F.coalesce("c", F.lit(0))).alias("chunks"), F.round(F.sum(F.coalesce("c", F.lit(0))) / F.count("*"), 6).alias("per_document"))


def expanded(docs: DataFrame, chunks: DataFrame, around: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks with ``around`` characters of their document on either side."""
    d = docs.select(key, F.col(text).alias("__text"))
    lo = F.greatest(F.col("start") - around, F.lit(0))
    hi = F.least(F.col("start") + F.length("content") + around, F.length("__text"))
    return chunks.join(d, key).select(key, "chunk", F.expr("0").alias("__z"), F.substring(F.col("__text"), lo + 1, hi - lo).alias("content")).drop("__z")


def context_block(chunks: DataFrame) -> DataFrame:
    """The chunk between its contexts, under headings."""
    part = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"[{name}]\n"), F.col(c)))
    return chunks.withColumn("block", F.concat_ws("\n", part("Context Before", "before"), part("Main Content", "content"), part("Context After", "after")))


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words, sentences and paragraphs of each document."""
    w = F.size(F.filter(F.split(F.col(text), "\\s+"), lambda x: x != ""))
    return docs.select(key, w.alias("words"), F.size(sentences(F.col(text))).alias("sentences"), F.size(paragraphs(F.col(text))).alias("paragraphs"))


def at_spaces(docs: DataFrame, size: int = 512, overlap: int = 50, least: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As fixed(), but a window that ends inside the text goes back to its last space; its step stays, so what is cut off is in no window where it is longer than the overlap."""
    c = fixed(docs, size, overlap, 0, key, text).join(docs.select(key, F.length(text).alias("__n")), key)
    inside = F.col("start") + size < F.col("__n")
    back = F.instr(F.reverse("content"), " ")
    cut = F.when(inside & (back > 0) & (back < F.length("content")), F.col("content").substr(F.lit(1), F.length("content") - back)).otherwise(F.col("content"))
    return c.withColumn("content", cut).where((F.length("content") >= least) | (F.col("chunk") == 0)).drop("__n")


def stored(chunks: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """Chunks as they are kept: chunk_id, the shard they are dealt to in turn, the embedding and the terms of what is searched, which is the content between its contexts if they have any."""
    from polystrata.operators import text, vectors

    around = [F.col(c) for c in ("before", "content", "after") if c in chunks.columns]
    searched = F.concat_ws(" ", *around)
    return chunks.select(
        F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk").cast("string")).alias("chunk_id"), key, "chunk", "content", F.pmod("chunk", F.lit(shards)).cast("int").alias("shard"),
        vectors.byte_embedding(F.col("content")).alias("embedding"), text.tokens(searched).alias("terms"),
    )


def document_of(chunk_id: Column) -> Column:
    """The document that a chunk is of."""
    return F.substring_index(chunk_id, "_chunk_", 1)


def of_document(chunks: DataFrame, value, key: str = "doc_id") -> DataFrame:
    return chunks.where(F.col(key) == value)


def rebuilt(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): documents put together again from chunks with their start; where two overlap the first gives the text."""
    parts = F.array_sort(F.collect_list(F.struct("start", "content")))
    more = lambda acc, p: F.concat(acc, F.substring(p["content"], F.greatest(F.length(acc) - p["start"], F.lit(0)) + 1, F.length(p["content"])))
    return chunks.groupBy(key).agg(F.aggregate(parts, F.lit(""), more).alias("text"))


def without(chunks: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks but those of some documents."""
    return chunks.join(keys.select(key).distinct(), key, "left_anti")


def hybrid(kept: DataFrame, query: str, n: int, weight: float = 0.7) -> DataFrame:
    """(chunk_id, doc, score, content) of the n best chunks of stored(): the 2n nearest to the query's embedding above 0.3 and the 2n with most of its terms, combined as weight * cosine + (1 - weight) * min(tf / 10, 1)."""
    from polystrata.operators import text, vectors

    q = text.query_tokens(query)
    v = kept.sparkSession.range(1).select(vectors.byte_embedding(F.lit(query)).alias("e")).first()[0]
    near = vectors.scored(kept, v).where(F.col("score") > vectors.LEAST).select("chunk_id", F.round("score", 6).alias("v")).orderBy(F.desc("v"), "chunk_id").limit(2 * n)
    tf = F.size(F.filter("terms", lambda t: t.isin(q) if q else F.lit(False)))
    word = kept.select("chunk_id", tf.alias("k")).where("k > 0").orderBy(F.desc("k"), "chunk_id").limit(2 * n)
    both = near.join(word, "chunk_id", "full").select("chunk_id", F.round(F.coalesce("v", F.lit(0.0)) * weight + F.least(F.coalesce("k", F.lit(0)) / 10, F.lit(1.0)) * (1 - weight), 7).alias("score"))  # a place more than the cosine has: nothing is rounded at a half
    best = both.orderBy(F.desc("score"), "chunk_id").limit(n)
    return kept.join(F.broadcast(best), "chunk_id").select("chunk_id", document_of(F.col("chunk_id")).alias("doc"), "score", "content")  # n rows


def near(kept: DataFrame, query: str, n: int) -> DataFrame:
    """(chunk_id, doc, score): the n chunks of stored() nearest to a query, above 0.3."""
    from polystrata.operators import vectors

    v = kept.sparkSession.range(1).select(vectors.byte_embedding(F.lit(query)).alias("e")).first()[0]
    return vectors.knn(kept, v, n, "chunk_id").select("chunk_id", document_of(F.col("chunk_id")).alias("doc"), "score")


def break_aware(text: str, size: int = 500, least: int = 50) -> list[str]:
    """Pieces of about ``size`` characters that end at a paragraph, else at a sentence past the half-way mark; short ones are left out."""
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            p = text.rfind("\n\n", at + size // 2, end)
            s = max(text.rfind(x, at + size // 2, end) for x in (". ", "! ", "? "))
            end = p + 2 if p >= 0 else s + 2 if s >= 0 else end
        piece = text[at:end].strip()
        if len(piece) > least:
            out.append(piece)
        at = end
    return out
