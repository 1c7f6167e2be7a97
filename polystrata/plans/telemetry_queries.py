"""Queries over telemetry, blobs, routing, cells and root causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polystrata.functions import scalar as S
from polystrata.operators import blobs as B
from polystrata.operators import cells as C
from polystrata.operators import rca as Q
from polystrata.operators import routing as R
from polystrata.operators import telemetry as T
from polystrata.operators import text as X
from polystrata.plans.registry import query
from polystrata.sources.files import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return T.plain(table(spark, d, "events"))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return T.from_events(table(spark, d, "events"))


_T = "t AS (SELECT event_id AS id, ts, event_type AS key, 'user_' || user_id AS source, value, props AS metadata FROM events)"
_L = "l AS (SELECT event_id AS id, ts, event_type AS key, 'user_' || user_id AS source, value, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)"


@query(f"WITH {_T} SELECT id, ts, key, source, value FROM t WHERE ts BETWEEN '2024-01-05' AND '2024-01-12' AND (key LIKE '%err%' OR key LIKE '%click%') AND source LIKE '%user_1%' ORDER BY ts DESC, id LIMIT 100")
def telemetry_filter_topn(spark, d):
    return T.search(_events(spark, d), "2024-01-05", "2024-01-12", ["err", "click"], ["user_1"], kind="float", limit=100).select("id", "ts", "key", "source", "value")


@query(f"WITH {_T} SELECT id, ts, key, source, value FROM t WHERE ts BETWEEN '2024-01-05' AND '2024-01-12'")
def telemetry_time_filter(spark, d):
    return T.search(_events(spark, d), "2024-01-05", "2024-01-12").select("id", "ts", "key", "source", "value")


@query("SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def telemetry_time_range(spark, d):
    return T.bounds(_events(spark, d))


@query(f"WITH {_L} SELECT id, key, p AS primary_id FROM l WHERE id <> p")
def telemetry_secondary_filter(spark, d):
    return T.search(_linked(spark, d), primary=False).select("id", "key", "primary_id")


@query("SELECT event_id AS id, event_type AS key, value FROM events WHERE event_id = 42")
def telemetry_point_lookup(spark, d):
    return _events(spark, d).where("id = 42").select("id", "key", "value")


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M') AS bucket, count(*) AS n, round(avg(value), 6) AS mean,
                 CASE WHEN sum(value) > 0 THEN round(sum(value), 6) END AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1""")
def bucket_stats(spark, d):
    return T.bucket_stats(_events(spark, d))


@query("""SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value / 500), 6) AS mean, round(greatest(0, max(value / 500)), 6) AS most,
                 round(least(1, min(value / 500)), 6) AS least FROM events GROUP BY 1""")
def hourly_patterns(spark, d):
    return T.hourly_patterns(_events(spark, d), F.col("value") / 500)


@query("SELECT event_type AS key, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def downsample_5_minutes(spark, d):
    return T.downsample(_events(spark, d), 5)


@query("SELECT event_id AS id, date_trunc('minute', ts) AS minute, date_trunc('minute', ts) - INTERVAL 1 MINUTE AS before, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS after FROM events")
def minute_window(spark, d):
    return T.minute_window(_events(spark, d))


@query(f"WITH {_L} SELECT p.id, p.key, s.id AS secondary_id, s.ts AS secondary_ts FROM l s JOIN l p ON s.p = p.id WHERE s.id <> s.p")
def secondaries_join(spark, d):
    return T.secondaries(_linked(spark, d))


@query(f"WITH {_L} SELECT s.id, s.p AS primary_id, p.key AS primary_key, p.ts AS primary_ts FROM l s JOIN l p ON s.p = p.id WHERE s.id <> s.p")
def primary_of_secondary(spark, d):
    return T.primary_of(_linked(spark, d))


@query(f"WITH {_T} SELECT source, id, rank FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY ts DESC, id DESC) AS rank FROM t) WHERE rank <= 3")
def latest_n_per_source(spark, d):
    return T.latest(_events(spark, d), 3, ["source"]).select("source", "id", "rank")


@query(f"WITH {_T} SELECT id, key, round(avg(value) OVER (PARTITION BY key ORDER BY ts, id ROWS 2 PRECEDING), 6) AS smooth FROM t")
def sma3_per_key(spark, d):
    return T.smoothed(_events(spark, d)).select("id", "key", "smooth")


@query(f"""WITH {_T} SELECT id, key, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE value END, 6) AS scaled
          FROM t WINDOW w AS (PARTITION BY key)""")
def minmax_normalize(spark, d):
    return T.normalised(_events(spark, d)).select("id", "key", "scaled")


@query(f"""WITH {_T} SELECT id, source, key, row_number() OVER (PARTITION BY source, key ORDER BY ts, id) - 1 AS occurrence,
          CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 3600 THEN lag(key) OVER w END AS previous FROM t WINDOW w AS (PARTITION BY source ORDER BY ts, id)""")
def running_occurrence_prev_event(spark, d):
    return T.occurrences(_events(spark, d), 3600)


@query("""SELECT event_type AS key, count(value) AS n, round(avg(value), 6) AS arithmetic, round(exp(avg(ln(value)) FILTER (value > 0)), 6) AS geometric,
          round(count(*) FILTER (value > 0) / sum(1 / value) FILTER (value > 0), 6) AS harmonic, round(sum(value * (1 + user_id)) / sum(1 + user_id), 6) AS arithmetic_weighted,
          round(exp(sum(ln(value) * (1 + user_id)) / sum(1 + user_id)), 6) AS geometric_weighted, round(sum(1 + user_id) / sum((1 + user_id) / value), 6) AS harmonic_weighted
          FROM events WHERE value > 0 GROUP BY 1""")
def means_all(spark, d):
    return T.means(_events(spark, d).where("value > 0"), weight=F.substring_index("source", "_", -1).cast("double") + 1)


@query("""SELECT event_type AS key, round(1 / avg(1 / value), 6) AS harmonic, round(pow(1 / avg(1 / value), 2) * sqrt(var_pop(1 / value) / count(*)), 6) AS spread FROM events WHERE value > 0 GROUP BY 1""")
def harmonic_spread(spark, d):
    return T.harmonic_spread(_events(spark, d))


@query("SELECT event_type AS key, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def percentiles(spark, d):
    return T.percentiles(_events(spark, d))


@query("SELECT event_type AS key, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def nan_min_max(spark, d):
    return _events(spark, d).groupBy("key").agg(S.nan_min(F.col("value")).alias("least"), S.nan_max(F.col("value")).alias("most"))


@query(f"WITH {_T} SELECT key, source, value, arg_min(id, (ts, id)) AS id, count(*) - 1 AS repeats FROM t GROUP BY key, source, value")
def dedup_fingerprint(spark, d):
    return T.distinct_by_fingerprint(_events(spark, d))


@query("SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 100")
def frequent_keys(spark, d):
    return T.frequent_keys(_events(spark, d), 100)


@query("SELECT count(DISTINCT event_type) AS keys, count(DISTINCT user_id) AS sources, count(*) AS records FROM events")
def distinct_counts(spark, d):
    return table(spark, d, "events").agg(F.countDistinct("event_type").alias("keys"), F.countDistinct("user_id").alias("sources"), F.count("*").alias("records"))


@query("SELECT greatest(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7), 1)::BIGINT AS windows FROM events")
def window_count(spark, d):
    return T.window_count(_events(spark, d), 60)


@query("""SELECT event_id AS id, TRY_CAST(v AS DOUBLE) AS as_float, trunc(TRY_CAST(v AS DOUBLE))::BIGINT AS as_int, v AS as_text
          FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE value::DECIMAL(18,2)::VARCHAR END AS v FROM events)""")
def value_coercions(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("decimal(18,2)").cast("string")))
    return e.select(F.col("event_id").alias("id"), *(c for c in T.coerced(F.col("v")))).drop("as_bool")


@query("""SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:') || lpad((minute(ts) // 15 * 15)::VARCHAR, 2, '0') AS quarter, strftime(ts, '%Y-%m-%d ') || lpad((hour(ts) // 6 * 6)::VARCHAR, 2, '0') AS six_hours,
          strftime(ts, '%Y-%m-') || lpad((day(ts) // 7 * 7)::VARCHAR, 2, '0') AS week_of_days, isoyear(ts) || '-W' || lpad((week(ts) // 2 * 2)::VARCHAR, 2, '0') AS fortnight,
          strftime(ts, '%Y-') || lpad(((month(ts) - 1) // 3 * 3 + 1)::VARCHAR, 2, '0') AS quarter_year FROM events""")
def time_bucket_labels(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), T.time_label(ts, 15, "minutes").alias("quarter"), T.time_label(ts, 6, "hours").alias("six_hours"), T.time_label(ts, 7, "days").alias("week_of_days"), T.time_label(ts, 2, "weeks").alias("fortnight"), T.time_label(ts, 3, "months").alias("quarter_year"))


# --------------------------------------------------------------------------- blobs

_B = "b AS (SELECT 'doc:' || doc_id AS key, encode(text) AS data, source AS prefix, octet_length(encode(text)) AS size, doc_id AS seq FROM documents)"


def _blobs(spark, d):
    return B.from_documents(table(spark, d, "documents"))


@query(f"WITH {_B} SELECT key, prefix, size FROM b WHERE key LIKE 'doc:1%'")
def key_prefix_scan(spark, d):
    return B.scan_prefix(_blobs(spark, d), "doc:1").select("key", "prefix", "size")


@query(f"WITH {_B} SELECT key, size FROM b WHERE prefix = 'src0' AND key GLOB 'doc:*7*' ORDER BY key LIMIT 20 OFFSET 5")
def blob_glob_query(spark, d):
    return B.find(_blobs(spark, d), "src0", "doc:*7*", 5, 20).select("key", "size")


@query(f"WITH {_B} SELECT key, size FROM b WHERE key = 'doc:17'")
def blob_get(spark, d):
    return B.get(_blobs(spark, d), "doc:17").select("key", "size")


@query("SELECT p_partkey AS key, list_reduce(list_prepend(0, list_transform(range(1, length(p_name) + 1), lambda i: ascii(p_name[i]))), lambda a, b: xor(a, b))::BIGINT AS checksum FROM part")
def blob_checksum(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), B.checksum(F.encode("p_name", "UTF-8")).alias("checksum"))


@query(f"WITH {_B} SELECT prefix, count(DISTINCT key) AS keys, sum(size)::BIGINT AS bytes, max(size) AS largest FROM b GROUP BY 1")
def blob_stats(spark, d):
    return B.stats(_blobs(spark, d))


@query(f"WITH {_B} SELECT key, CASE WHEN seq % 3 = 0 THEN 'new' ELSE prefix END AS prefix, CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS created_at FROM b")
def blob_upsert(spark, d):
    old = _blobs(spark, d).select("key", "prefix", "seq", F.lit(0).alias("created_at"))
    new = old.where("seq % 3 = 0").select("key", F.lit("new").alias("prefix"), "seq", F.lit(1).alias("created_at"))
    return B.upsert(old, new).select("key", "prefix", "created_at")


@query(f"WITH {_B} SELECT key, prefix, 0 AS created_at, CASE WHEN seq % 3 = 0 THEN size + 1 ELSE size END AS size FROM b")
def blob_update(spark, d):
    old = _blobs(spark, d).select("key", "prefix", "seq", F.lit(0).alias("created_at"), "size")
    new = old.where("seq % 3 = 0").select("key", F.lit(None).cast("string").alias("prefix"), "seq", F.lit(1).alias("created_at"), (F.col("size") + 1).alias("size"))
    return B.update(old, new).select("key", "prefix", "created_at", "size")


@query(f"WITH {_B} SELECT key, size FROM b WHERE seq % 2 <> 0")
def blob_delete(spark, d):
    b = _blobs(spark, d).select("key", "size", "seq")
    return B.remove(b, b.where("seq % 2 = 0")).select("key", "size")


@query("SELECT DISTINCT 'k' || (doc_id % 50) AS key FROM documents WHERE 'k' || (doc_id % 50) LIKE 'k1%'")
def shard_key_union(spark, d):
    k = table(spark, d, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id") % 50).alias("key"))
    return B.all_keys([k.where("doc_id % 2 = 0"), k.where("doc_id % 2 = 1")], "k1")


@query(f"WITH {_B} SELECT DISTINCT key FROM b WHERE key LIKE '%:9%'")
def key_substring_search(spark, d):
    return B.search_keys(_blobs(spark, d), ":9")


# ------------------------------------------------------------------------- routing


@query("""WITH s AS (SELECT ('0x' || substr(md5('doc:' || doc_id), 1, 8))::BIGINT % 4 AS shard FROM documents), c AS (SELECT shard, count(*) AS n FROM s GROUP BY 1)
          SELECT count(*) AS shards, sum(n)::BIGINT AS rows, round(1 - least(stddev_pop(n) / avg(n), 1), 6) AS entropy, round(avg(n) / max(n), 6) AS balance FROM c""")
def distribution_by_hash(spark, d):
    return R.balance(table(spark, d, "documents").select(R.by_hash(F.concat(F.lit("doc:"), F.col("doc_id")), 4).alias("shard")))


@query("""WITH s AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM documents) SELECT shard::INT AS shard, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY 1""")
def distribution_round_robin(spark, d):
    return R.shares(R.round_robin(table(spark, d, "documents").select("doc_id"), "doc_id", 4))


@query("""SELECT doc_id, CASE WHEN source >= 'src0' AND source < 'src2' THEN 1 WHEN source >= 'src2' AND source < 'src4' THEN 2 ELSE 0 END AS shard FROM documents""")
def shard_by_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", R.by_prefix(F.col("source"), [("src0", "src2", 1), ("src2", "src4", 2)]).alias("shard"))


@query("""WITH r AS (SELECT s, ('0x' || substr(md5('shard_' || s || ':' || v), 1, 8))::BIGINT AS place FROM range(4) a(s), range(150) b(v)), h AS (SELECT doc_id, ('0x' || substr(md5('doc:' || doc_id), 1, 8))::BIGINT AS place FROM documents)
          SELECT doc_id, coalesce((SELECT arg_min(s, r.place) FROM r WHERE r.place >= h.place), (SELECT arg_min(s, place) FROM r))::INT AS shard FROM h""")
def shard_consistent_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", R.consistent(F.concat(F.lit("doc:"), F.col("doc_id")), 4).alias("shard"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS shard, count(*) AS n FROM events GROUP BY 1")
def shard_by_time(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("shard")).agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------- cells

_C = "c AS (SELECT l_linenumber AS x, l_suppkey AS y, l_linenumber || '_' || l_suppkey AS cell, l_orderkey, l_extendedprice AS value, l_shipdate AS ts FROM lineitem)"


def _samples(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_linenumber").alias("x"), F.col("l_suppkey").alias("y"), C.cell_key(F.col("l_linenumber"), F.col("l_suppkey")).alias("cell"), "l_orderkey", F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("ts"))


@query(f"WITH {_C} SELECT cell, l_orderkey, value FROM c QUALIFY row_number() OVER (PARTITION BY cell ORDER BY l_orderkey DESC, value DESC) <= 5")
def fifo_cells(spark, d):
    return C.queued(_samples(spark, d), 5, ["cell"], ["l_orderkey", "value"]).select("cell", "l_orderkey", "value")


@query(f"WITH {_C} SELECT cell, l_orderkey, ts, value FROM c QUALIFY row_number() OVER (PARTITION BY cell ORDER BY ts DESC, l_orderkey DESC, value DESC) <= 1")
def latest_per_cell(spark, d):
    return C.queued(_samples(spark, d), 1, ["cell"], ["ts", "l_orderkey", "value"]).select("cell", "l_orderkey", "ts", "value")


@query(f"WITH {_C} SELECT x, y, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM c WHERE x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 50 GROUP BY ALL")
def cell_summary(spark, d):
    return C.summary(C.within(_samples(spark, d), {"x": (1, 3), "y": (1, 50)}), ["x", "y"])


@query(f"WITH {_C} SELECT cell, l_orderkey, value FROM c WHERE cell = '1_1' AND ts BETWEEN '1995-01-01' AND '1997-01-01'")
def cell_time_range(spark, d):
    return C.in_time(_samples(spark, d), "1_1", "1995-01-01", "1997-01-01").select("cell", "l_orderkey", "value")


# --------------------------------------------------------------------- root causes

_PAIR = f"{_T}, p AS (SELECT x.id AS id_a, x.key AS a, y.key AS b, (epoch_us(y.ts) - epoch_us(x.ts)) / 1e6 AS gap FROM t x JOIN t y ON y.ts BETWEEN x.ts AND x.ts + INTERVAL 300 SECOND AND (y.ts > x.ts OR y.id > x.id) AND y.id <> x.id)"
_FOUND = f"""{_PAIR}, f AS (SELECT a, b, id_a, min(gap) AS gap FROM p WHERE a <> b GROUP BY ALL), n AS (SELECT a, b, count(*) AS n, round(avg(gap), 6) AS mean_gap FROM f GROUP BY ALL),
found AS (SELECT a, b, n, round(n / (SELECT greatest(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 3e8), 1) FROM t), 6) AS support, round(n / (SELECT count(*) FROM t WHERE key = n.a), 6) AS confidence, mean_gap FROM n WHERE n >= 2)"""


def _found(spark, d, confidence=0.0):
    return Q.patterns(_events(spark, d), 300, 0.0, confidence)


@query(f"WITH {_PAIR} SELECT a, b, count(*) AS n, round(avg(gap), 6) AS mean_gap FROM p GROUP BY a, b")
def cooccurrence_pairs(spark, d):
    return Q.co_occurrences(_events(spark, d), 300)


@query(f"WITH {_FOUND} SELECT * FROM found")
def rca_pairs(spark, d):
    return _found(spark, d)


@query(f"WITH {_FOUND} SELECT a AS cause, b AS effect, max(confidence) AS confidence FROM found GROUP BY ALL")
def causal_links(spark, d):
    return Q.causal_links(_found(spark, d))


@query(f"WITH {_FOUND} SELECT DISTINCT a AS root FROM found WHERE confidence > 0.001 AND n >= 2")
def rca_roots(spark, d):
    return Q.roots(_found(spark, d), 0.001, 2)


@query(f"WITH {_FOUND} SELECT a AS root, list_sort(list(DISTINCT b)) AS affects FROM found WHERE a IN (SELECT a FROM found WHERE confidence > 0.001) GROUP BY 1")
def rca_impact(spark, d):
    f = _found(spark, d)
    return Q.impact(f, Q.roots(f, 0.001, 2))


@query(f"""WITH {_FOUND}, r AS (SELECT DISTINCT a AS root FROM found) SELECT x.root AS a, y.root AS b, CASE WHEN x.root = y.root THEN 1.0 ELSE coalesce(confidence, 0)::DOUBLE END AS confidence
          FROM r x CROSS JOIN r y LEFT JOIN found ON a = x.root AND b = y.root""")
def rca_correlation(spark, d):
    f = _found(spark, d)
    return Q.correlation(f, f.select(F.col("a").alias("root")).distinct())


@query(f"""WITH {_FOUND}, r AS (SELECT a AS root, max(confidence) AS confidence FROM found GROUP BY 1)
          SELECT root, confidence, row_number() OVER (ORDER BY confidence DESC, root) AS place, CASE WHEN row_number() OVER (ORDER BY confidence DESC, root) <= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM r""")
def rca_recommendations(spark, d):
    return Q.recommendations(_found(spark, d)).drop("advice")


# -------------------------------------------------------------------------- facets


@query("SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2")
def facet_counts(spark, d):
    return X.facets(table(spark, d, "part"), ["p_brand", "p_type"])


@query("SELECT p_partkey, p_name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_type = 'ECONOMY' AND p_size BETWEEN 5 AND 30")
def facet_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2") & (F.col("p_type") == "ECONOMY") & F.col("p_size").between(5, 30)).select("p_partkey", "p_name")
