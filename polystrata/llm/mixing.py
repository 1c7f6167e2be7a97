"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the exponential key -ln(u) / quality weight; ascending keys
order a source as weighted sampling without replacement would. A source's token
budget is first spent on complete epochs, then on the prefix of documents in key
order whose summed tokens fit in what is left.

Keys fall in buckets, and only bucket sums are gathered. The cut of a source
lies in one of its buckets, and only that bucket is sorted; every other document
is in or out by its key alone. So no source, however large, is sorted in one
task, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polystrata.llm.common import BROADCAST_LIMIT, materialize, packed

SEED = 17
TEMPER = 0.5  #: target shares are in proportion to a source's tokens to this power
BUDGET = 0.6  #: tokens wanted, as a share of the tokens there are
QUALITY = {1: 1.0, None: 0.5, 0: 0.1}  #: sampling weight of documents labelled good, not labelled, labelled bad
BUCKET_ROWS = 8192  #: documents wanted in a bucket
LABEL_BYTES, SOURCE_BYTES = 64, 256  #: of a row of labels or of sources, once broadcast


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from a keyed hash of ``doc_id``: 52 bits, so that it is exact as a double."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def token_count(text: Column) -> Column:
    """Tokens as the budget counts them: runs of anything but white space; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _weight(quality: Column) -> Column:
    return F.when(quality == 1, QUALITY[1]).when(quality == 0, QUALITY[0]).otherwise(QUALITY[None])


def with_keys(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with __src (source, a null as its own), __tokens and __key.

    Labels are broadcast only while there are few (common.BROADCAST_LIMIT), else joined on doc_id.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__q")).where("__id IS NOT NULL")
    own = own.groupBy("__id").agg(F.min("__q").alias("__q"))
    if labels.count() * LABEL_BYTES <= BROADCAST_LIMIT:
        own = F.broadcast(own)
    d = docs.join(own, F.col("doc_id").cast("long") == F.col("__id"), "left")
    src = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    return d.withColumns({"__src": src, "__tokens": token_count(F.col("text").cast("string")), "__key": -F.ln(uniform(F.col("doc_id"), seed)) / _weight(F.col("__q"))}).drop("__id", "__q")


def plan(keyed: DataFrame, targets: dict[str | None, float] | None = None, budget: float = BUDGET, temper: float = TEMPER) -> DataFrame:
    """For each source (__src): __epochs, and the key and doc_id up to which one copy more is taken (null: none).

    ``targets`` names the weight of each source (one that isn't named has none);
    without it weights are the sources' tokens to the power ``temper``. The
    budget is ``budget`` times all tokens.
    """
    narrow = materialize(keyed.select("__src", F.col("doc_id").cast("string").alias("__id"), "__tokens", "__key"), "keys")
    by = narrow.groupBy("__src").agg(F.sum("__tokens").alias("__total"), F.count("*").alias("__rows"))
    if targets is None:
        weight = F.pow(F.col("__total").cast("double"), temper)
    else:
        weight = F.lit(0.0)
        for k, v in targets.items():
            weight = F.when(F.col("__src") == ("null" if k is None else f"s{k}"), float(v)).otherwise(weight)
    by = by.withColumn("__w", weight)
    whole = by.agg(F.sum("__total").alias("t"), F.sum("__w").alias("w"))
    by = by.crossJoin(whole).withColumn("__want", F.when(F.col("w") > 0, F.floor(F.col("t") * budget * F.col("__w") / F.col("w"))).otherwise(0).cast("long"))
    by = by.withColumn("__epochs", F.when(F.col("__total") > 0, F.expr("__want div __total")).otherwise(0).cast("long"))
    by = by.withColumn("__rest", F.col("__want") - F.col("__epochs") * F.col("__total")).withColumn("__buckets", F.ceil(F.col("__rows") / BUCKET_ROWS) * 8)
    by = by.select("__src", "__epochs", "__rest", "__buckets")

    placed = narrow.join(by, "__src").withColumn("__b", F.floor(F.col("__key") / (F.col("__key") + 1) * F.col("__buckets")))
    sums = placed.groupBy("__src", "__rest", "__b").agg(F.sum("__tokens").alias("__sum"))
    w = Window.partitionBy("__src").orderBy("__b")
    sums = sums.withColumn("__upto", F.sum("__sum").over(w))
    # The first bucket that doesn't fit whole holds the cut; without one all documents fit.
    edge = sums.groupBy("__src").agg(F.min(F.when(F.col("__upto") > F.col("__rest"), F.col("__b"))).alias("__b"))
    edge = edge.join(sums.select("__src", "__b", (F.col("__upto") - F.col("__sum")).alias("__before")), ["__src", "__b"])
    edge = materialize(edge, "edges")
    inner = placed.join(F.broadcast(edge) if edge.count() * SOURCE_BYTES <= BROADCAST_LIMIT else edge, ["__src", "__b"])
    wi = Window.partitionBy("__src").orderBy("__key", "__id")  # peers, that is rows that repeat a doc_id, go together
    fit = inner.withColumn("__cum", F.col("__before") + F.sum("__tokens").over(wi)).where("__cum <= __rest")
    last = fit.groupBy("__src").agg(F.max(F.struct("__key", "__id")).alias("__last"))
    # No document of the edge bucket fits: the cut is the bucket's lower end.
    cut = by.join(edge.select("__src", F.col("__b").alias("__edge")), "__src", "left").join(last, "__src", "left")
    return materialize(cut.select("__src", "__epochs", "__buckets", "__edge", F.col("__last.__key").alias("__cutkey"), F.col("__last.__id").alias("__cutid")), "cuts")


def with_copies(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """``keyed`` with the number of copies of each row. There is one row of ``cuts`` a source; it is broadcast while they are few."""
    few = cuts.count() * SOURCE_BYTES <= BROADCAST_LIMIT
    d = keyed.join(F.broadcast(cuts) if few else cuts, "__src", "left")
    b = F.floor(F.col("__key") / (F.col("__key") + 1) * F.col("__buckets"))
    ident = F.col("doc_id").cast("string")
    in_edge = F.col("__cutkey").isNotNull() & ((F.col("__key") < F.col("__cutkey")) | ((F.col("__key") == F.col("__cutkey")) & (F.coalesce(ident, F.lit("")) <= F.coalesce("__cutid", F.lit("")))))
    more = F.when(F.col("__edge").isNull() | (b < F.col("__edge")), 1).when((b == F.col("__edge")) & in_edge, 1).otherwise(0)
    return d.withColumn("copies", (F.coalesce("__epochs", F.lit(0)) + more).cast("long"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str | None, float] | None = None, budget: float = BUDGET, temper: float = TEMPER, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, copies) for each row of ``docs``.

    ``docs`` needs doc_id, text and source; ``labels`` doc_id and quality. A null
    source is a source of its own, a null or empty text has 0 tokens, a doc_id
    that is null or not labelled has the middle weight, and of two labels the
    worse counts. Rows that repeat a doc_id within a source share a key and are
    taken or left together; equal keys are ordered by doc_id. A source without
    tokens has no epochs, and its rows fit in any rest. Other columns are
    ignored. An empty table gives no rows. All of a very long text is counted.
    """
    keyed = with_keys(docs.select("doc_id", "text", "source"), labels, seed)
    out = with_copies(keyed, plan(keyed, targets, budget, temper))
    return out.select("doc_id", "source", F.col("__tokens").alias("tokens"), "copies")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str | None, float] | None = None, budget: float = BUDGET, temper: float = TEMPER, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as mix() says, with their columns, whatever their names. Nulls, empty and very long texts, ties, repeated rows and an empty table are as in mix()."""
    own = ["doc_id", "text", "source"]
    rest, columns = packed(docs, tuple(own))
    keyed = with_keys(docs.select(*own, rest), labels, seed)
    out = with_copies(keyed, plan(keyed, targets, budget, temper)).where("copies > 0")
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return out.withColumn("__copy", again).select(*columns)


#: The same copies in DuckDB SQL, with the parameters above.
SQL = f"""
WITH q AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, source, coalesce('s' || source, 'null') AS src, coalesce(len(regexp_extract_all(text, '\\S+')), 0)::BIGINT AS tokens,
             -ln((('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE)
             / CASE WHEN q = 1 THEN {QUALITY[1]!r}::DOUBLE WHEN q = 0 THEN {QUALITY[0]!r}::DOUBLE ELSE {QUALITY[None]!r}::DOUBLE END AS k
      FROM documents LEFT JOIN q USING (doc_id)),
s AS (SELECT src, sum(tokens)::BIGINT AS total FROM d GROUP BY src),
b AS (SELECT src, total, floor(sum(total) OVER () * {BUDGET!r}::DOUBLE * pow(total::DOUBLE, {TEMPER!r}) / sum(pow(total::DOUBLE, {TEMPER!r})) OVER ())::BIGINT AS want FROM s),
e AS (SELECT src, CASE WHEN total > 0 THEN want // total ELSE 0 END AS epochs, want - CASE WHEN total > 0 THEN want // total ELSE 0 END * total AS rest FROM b),
c AS (SELECT d.*, sum(tokens) OVER (PARTITION BY src ORDER BY k, doc_id::VARCHAR) AS cum FROM d)
SELECT doc_id, source, tokens, (epochs + CASE WHEN cum <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c JOIN e USING (src)
"""
