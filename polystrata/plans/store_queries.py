"""Queries over stores: blobs, shards, files, telemetry writes, saved indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from polystrata.functions import scalar as S
from polystrata.operators import blobs as B
from polystrata.operators import cells as C
from polystrata.operators import logs as G
from polystrata.operators import routing as R
from polystrata.operators import telemetry as T
from polystrata.operators import text as X
from polystrata.plans.content_queries import _TOK, _in, Q
from polystrata.plans.registry import query
from polystrata.plans.telemetry_queries import _B, _L, _T, _blobs, _events, _linked
from polystrata.session import shared_dir
from polystrata.sources import files
from polystrata.sources.files import table


def _place(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/polystrata-{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- blobs


@query(f"WITH {_B} SELECT 'doc:' || k AS key, 'doc:' || k IN (SELECT key FROM b) AS existed FROM (SELECT DISTINCT doc_id * 2 AS k FROM documents)")
def blob_delete_flags(spark, d):
    keys = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id") * 2).alias("key"))
    return B.removal(_blobs(spark, d), keys)


@query(f"WITH {_B} SELECT key, row_number() OVER (ORDER BY seq) - 1 AS place FROM b")
def blob_key_list(spark, d):
    from polystrata.operators.order import numbered

    return numbered(_blobs(spark, d).select("key", "seq"), "seq", "place").select("key", "place")


@query(f"WITH {_B} SELECT key, md5(data) AS digest FROM b")
def blob_full_scan(spark, d):
    return _blobs(spark, d).select("key", F.md5("data").alias("digest"))


@query(f"WITH {_B} SELECT key, size FROM b WHERE false")
def blob_clear(spark, d):
    return B.cleared(_blobs(spark, d)).select("key", "size")


@query("SELECT p_partkey::VARCHAR AS key, p_partkey % 5 <> 0 AS intact FROM part")
def blob_verify(spark, d):
    """Every fifth blob has a byte more than when its checksum was taken."""
    data = F.encode("p_name", "UTF-8")
    b = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_partkey", data.alias("data"), F.octet_length(data).cast("long").alias("size"), B.checksum(data).alias("checksum"))
    return B.verify(b.withColumn("data", F.when(F.col("p_partkey") % 5 == 0, F.concat("data", F.lit(bytearray(b"!")))).otherwise(F.col("data"))))


@query(f"""WITH {_TOK}, s AS (SELECT doc_id, count(*) AS score FROM tok WHERE term IN ({_in(Q)}) GROUP BY 1)
          SELECT doc_id, score, source AS prefix, CASE WHEN source IS NOT NULL THEN octet_length(encode(text)) END AS size FROM s LEFT JOIN (FROM documents WHERE doc_id % 2 = 0) USING (doc_id)""")
def hits_with_metadata(spark, d):
    """Hits with the metadata of their blob, of which every second is stored."""
    docs = table(spark, d, "documents")
    hits = X.search(docs.select("doc_id", "text"), Q).select("doc_id", "score", F.concat(F.lit("doc:"), F.col("doc_id")).alias("key"))
    return B.with_metadata(hits, B.from_documents(docs.where("doc_id % 2 = 0")).withColumn("checksum", F.lit(0))).select("doc_id", "score", "prefix", "size")


@query("SELECT doc_id, md5(text) AS digest, true AS shrinks FROM documents WHERE length(text) > 200")
def compressed_texts(spark, d):
    t = table(spark, d, "documents").where("length(text) > 200").withColumn("z", S.compressed()(F.encode("text", "UTF-8")))
    return t.select("doc_id", F.md5(S.decompressed(F.col("z"))).alias("digest"), (F.octet_length("z") < F.octet_length("text")).alias("shrinks"))


@query("SELECT p_partkey, p_name AS name, p_size AS size, p_retailprice AS price FROM part")
def typed_objects(spark, d):
    """Objects of a type as compressed JSON, and back."""
    kind = "struct<name:string,size:int,price:double>"
    p = table(spark, d, "part").select("p_partkey", S.compressed()(F.encode(F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))), "UTF-8")).alias("z"))
    return p.select("p_partkey", F.from_json(F.decode(S.decompressed(F.col("z")), "UTF-8"), kind).alias("o")).select("p_partkey", "o.*")


@query("SELECT event_id, event_type AS kind, (props ->> '$.k')::BIGINT AS k, value FROM events")
def packed_objects(spark, d):
    """Objects in MessagePack and CBOR, and back: null where the two differ."""
    from polystrata.functions import packing as P

    o = F.to_json(F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value"))
    e = table(spark, d, "events").select("event_id", P.unpacked(P.packed(o, "msgpack"), "msgpack").alias("m"), P.unpacked(P.packed(o, "cbor"), "cbor").alias("c"))
    same = F.when(F.col("m") == F.col("c"), F.col("m"))
    return e.select("event_id", F.from_json(same, "kind string, k long, value double").alias("o")).select("event_id", "o.*")


# ------------------------------------------------------------------- routed shards

_K = "'doc:' || doc_id"
_H = "(('0x' || substr(md5(key), 1, 8))::BIGINT % 4)::INT"
#: Every key in its own shard; every third also in shard 3, with other data.
_STORE = f"s AS (SELECT key, {_H} AS shard, seq, seq AS data FROM (SELECT {_K} AS key, doc_id AS seq FROM documents) UNION SELECT key, 3, seq, seq + CASE WHEN {_H} = 3 THEN 0 ELSE 1000000 END FROM (SELECT {_K} AS key, doc_id AS seq FROM documents WHERE doc_id % 3 = 0))"


def _store(spark, d):
    k = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("key"), F.col("doc_id").alias("seq"))
    own = k.withColumn("shard", R.by_hash(F.col("key"), 4)).withColumn("data", F.col("seq"))
    more = own.where("seq % 3 = 0").withColumn("data", F.col("seq") + F.when(F.col("shard") == 3, 0).otherwise(1000000)).withColumn("shard", F.lit(3))
    return own.unionByName(more).distinct()


def _asked(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id") * 2).alias("key"))


_ASKED = "a AS (SELECT DISTINCT 'doc:' || doc_id * 2 AS key FROM documents)"


@query(f"WITH {_STORE}, {_ASKED} SELECT key, shard, data FROM s WHERE key IN (SELECT key FROM a) QUALIFY row_number() OVER (PARTITION BY key ORDER BY shard <> {_H}, shard) = 1")
def routed_get(spark, d):
    return R.lookup(_store(spark, d), _asked(spark, d), R.by_hash(F.col("key"), 4)).select("key", "shard", "data")


@query(f"WITH {_STORE}, {_ASKED} SELECT key, key IN (SELECT key FROM s) AS there FROM a")
def routed_exists(spark, d):
    return R.exists(_store(spark, d), _asked(spark, d))


@query(f"WITH {_STORE}, {_ASKED} SELECT key, shard, data FROM s QUALIFY key NOT IN (SELECT key FROM a) OR row_number() OVER (PARTITION BY key ORDER BY shard <> {_H}, shard) > 1")
def routed_delete(spark, d):
    return R.delete(_store(spark, d), _asked(spark, d), R.by_hash(F.col("key"), 4)).select("key", "shard", "data")


@query(f"""WITH {_STORE}, o AS (SELECT key, min(shard) AS own FROM s GROUP BY 1), n AS (SELECT 'doc:' || doc_id * 2 AS key, doc_id * 2 AS seq, -doc_id AS data FROM documents),
          w AS (SELECT n.key, coalesce(own, {_H}) AS shard, seq, data FROM n LEFT JOIN o USING (key))
          SELECT key, shard, data FROM (SELECT *, 0 AS new FROM s UNION ALL SELECT key, shard, seq, data, 1 FROM w) QUALIFY row_number() OVER (PARTITION BY key, shard ORDER BY new DESC, seq DESC) = 1""")
def routed_put(spark, d):
    new = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id") * 2).alias("key"), (F.col("doc_id") * 2).alias("seq"), (-F.col("doc_id")).alias("data"))
    return R.put(_store(spark, d), new, R.by_hash(F.col("key"), 4)).select("key", "shard", "data")


@query(f"WITH k AS (SELECT 'k' || doc_id % 50 AS key FROM documents) SELECT {_H} AS shard, count(*) AS writes, count(DISTINCT key) AS keys FROM k GROUP BY 1")
def routed_writes(spark, d):
    k = table(spark, d, "documents").select(F.concat(F.lit("k"), F.col("doc_id") % 50).alias("key"))
    return R.written(k.withColumn("shard", R.by_hash(F.col("key"), 4)))


@query("SELECT p_partkey, r::INT AS shard FROM part, range(3) t(r)")
def replicated_rows(spark, d):
    return R.replicated(table(spark, d, "part").select("p_partkey"), 3)


@query(f"WITH {_STORE} SELECT r::INT AS shard, count(key) AS rows, count(DISTINCT key) AS keys, true AS healthy FROM range(6) t(r) LEFT JOIN s ON shard = r GROUP BY r")
def shard_health(spark, d):
    return R.health(_store(spark, d), 6)


@query("""WITH n AS (SELECT r::INT AS s, count(doc_id) AS n FROM range(4) t(r) LEFT JOIN documents ON CASE WHEN doc_id % 10 < 6 THEN 0 ELSE 1 + doc_id % 2 END = r GROUP BY r), m AS (SELECT avg(n) AS mean, arg_min(s, n * 10 + s) AS low FROM n)
          SELECT doc_id, CASE WHEN (SELECT n FROM n WHERE s = x.shard) * 0.7 > (SELECT mean FROM m) THEN (SELECT low FROM m) ELSE x.shard END::INT AS new_shard FROM (SELECT doc_id, CASE WHEN doc_id % 10 < 6 THEN 0 ELSE 1 + doc_id % 2 END AS shard FROM documents) x""")
def redirected_rows(spark, d):
    k = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 10 < 6, 0).otherwise(1 + F.col("doc_id") % 2).cast("int").alias("shard"))
    return R.redirected(k, 4).select("doc_id", "new_shard")


_RING = lambda n: f"(SELECT s, ('0x' || substr(md5('shard_' || s || ':' || v), 1, 8))::BIGINT AS place FROM range({n}) a(s), range(150) b(v))"


@query(f"""WITH h AS (SELECT doc_id, ('0x' || substr(md5('doc:' || doc_id), 1, 8))::BIGINT AS place FROM documents),
          x AS (SELECT doc_id, coalesce((SELECT arg_min(s, r.place) FROM {_RING(4)} r WHERE r.place >= h.place), (SELECT arg_min(s, place) FROM {_RING(4)}))::INT AS old_shard, coalesce((SELECT arg_min(s, r.place) FROM {_RING(5)} r WHERE r.place >= h.place), (SELECT arg_min(s, place) FROM {_RING(5)}))::INT AS new_shard FROM h)
          SELECT *, old_shard <> new_shard AS moves FROM x""")
def resharded_rows(spark, d):
    return R.resharded(table(spark, d, "documents").select("doc_id"), F.concat(F.lit("doc:"), F.col("doc_id")), 4, 5)


# --------------------------------------------------------------------------- files


@query("""SELECT event_id, date_trunc('second', ts) AS ts, event_type AS key, CASE event_id % 5 WHEN 1 THEN 'user_' || user_id ELSE 'default' END AS source FROM events WHERE event_id % 5 < 4""")
def ingested_file(spark, d):
    """Log lines written to a text file, read back and parsed; lines without a format are left out."""
    at = _place(spark, "lines")
    r = G.render(table(spark, d, "events"))
    r.select(F.concat_ws("\t", "event_id", "line").alias("value")).write.text(at)
    back = files.lines(spark, at).select(F.substring_index("line", "\t", 1).cast("long").alias("event_id"), F.expr("substr(line, instr(line, '\t') + 1)").alias("line"))
    return G.records(G.parse(back)).select("event_id", "ts", "key", "source")


@query("SELECT * FROM (VALUES ('cpu', 'host1', '42', 'int'), ('cpu', 'host2', 'true', 'bool')) t(key, source, value, kind)")
def memory_lines(spark, d):
    got = files.memory(spark, ["1700000000|host1|cpu|42|", "2024-01-15 10:30:45|host2|cpu|true|a=1", "nothing that fits"])
    return G.records(G.parse(got)).select("key", "source", "value", "kind")


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_report(spark, d):
    r = files.report(table(spark, d, "events").select("event_id", "props"))
    return r.select(F.get_json_object("report", "$.event_id").cast("long").alias("event_id"), F.get_json_object(F.get_json_object("report", "$.props"), "$.k").cast("long").alias("k"))


@query("""SELECT * FROM (VALUES ('written', 6), ('read', 6), ('is_file', 1), ('copied', 6), ('moved', 6), ('moved away', 0), ('files', 2), ('removed', 1), ('removed again', 0)) t(step, n)""")
def file_words(spark, d):
    """Files written, read, copied, moved, listed and removed in the shared folder."""
    at = _place(spark, "words")
    size = lambda p: int(files.whole(spark, p).first()["length"])
    rows = [("written", files.write_text(spark, f"{at}/a/one.txt", "h\u00e9llo")), ("read", len(files.snippet(spark, file=f"{at}/a/one.txt").encode())), ("is_file", int(files.is_file(spark, f"{at}/a/one.txt") and not files.is_file(spark, f"{at}/a")))]
    files.copy(spark, f"{at}/a/one.txt", f"{at}/b/two.txt")
    rows.append(("copied", size(f"{at}/b/two.txt")))
    files.copy(spark, f"{at}/b/two.txt", f"{at}/b/three.txt", move=True)
    rows += [("moved", size(f"{at}/b/three.txt")), ("moved away", int(files.exists(spark, f"{at}/b/two.txt"))), ("files", files.listing(spark, at, "*.txt").count())]
    rows += [("removed", int(files.remove(spark, at))), ("removed again", int(files.remove(spark, at)))]
    return spark.createDataFrame(rows, "step string, n int")


# ----------------------------------------------------------------------- telemetry


@query(f"WITH {_T} SELECT id, ts, key FROM t WHERE ts BETWEEN '2024-01-05 03:30:00' AND '2024-01-06 17:45:00'")
def telemetry_pruned_range(spark, d):
    """Telemetry written by day and read again: only the folders of the range are."""
    stored = T.written(_events(spark, d), _place(spark, "telemetry"))
    return T.in_range(stored, "2024-01-05 03:30:00", "2024-01-06 17:45:00").select("id", "ts", "key")


@query(f"WITH {_L} SELECT id, key, p AS primary_id FROM l WHERE id <> p AND p % 2 = 1")
def telemetry_written_links(spark, d):
    stored = T.written(_linked(spark, d), _place(spark, "linked"))
    return T.search(stored, primary=False).where("primary_id % 2 = 1").select("id", "key", "primary_id")


@query(f"WITH {_L} SELECT DISTINCT p AS primary_id, id AS secondary_id FROM l WHERE id <> p")
def links_written(spark, d):
    """Links written twice, and one of each row with itself, are there once."""
    own = _linked(spark, d).where("NOT is_primary").select("primary_id", F.col("id").alias("secondary_id"))
    return T.linked(own, own.unionByName(own.select("primary_id", F.col("primary_id").alias("secondary_id"))))


@query("SELECT event_id AS id, ts >= '2024-01-15 11:00:00' AS hour, ts >= '2024-01-14 12:00:00' AS day, ts >= '2024-01-08 12:00:00' AS week, ts >= '2023-12-16 12:00:00' AS month FROM events")
def relative_intervals(spark, d):
    return _events(spark, d).select("id", *((F.col("ts") >= T.since("2024-01-15 12:00:00", u)).alias(u) for u in ("hour", "day", "week", "month")))


@query("SELECT event_id AS id, floor(epoch(ts))::BIGINT AS seconds, date_trunc('second', ts) AS back FROM events")
def epoch_conversions(spark, d):
    return _events(spark, d).select("id", T.epoch(F.col("ts")).alias("seconds"), T.from_epoch(T.epoch(F.col("ts"))).alias("back"))


@query(f"WITH {_T} SELECT strftime(ts, '%Y-%m-%d %H:%M') AS bucket, count(*) AS n, list(id ORDER BY ts, id) AS ids FROM t GROUP BY 1")
def minute_bucket_records(spark, d):
    return T.bucket_records(_events(spark, d))


@query(f"WITH {_T}, n AS (SELECT * FROM t ORDER BY ts DESC, id DESC LIMIT 300) SELECT strftime(ts, '%Y-%m-%d %H:%M') AS bucket, count(*) AS n, list(id ORDER BY ts, id) AS ids FROM n GROUP BY 1")
def newest_bucket_records(spark, d):
    return T.bucket_records(_events(spark, d), 300)


@query(f"WITH {_T}, h AS (SELECT date_trunc('hour', ts) AS hour, id, ts, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, id) AS r FROM t) SELECT hour, count(*) AS n, list(id ORDER BY r) FILTER (r <= 2) AS ids FROM h GROUP BY 1")
def hour_index(spark, d):
    return T.hour_index(_events(spark, d), 2)


@query(f"WITH {_T} SELECT id, 'telemetry_' || substr(sha256(key || chr(1) || source), 1, 16) AS telemetry_id FROM t")
def telemetry_ids(spark, d):
    return _events(spark, d).select("id", T.telemetry_id(_events(spark, d), "key", "source").alias("telemetry_id"))


@query("SELECT count(*) AS documents, max(n_chars) AS longest, max(doc_id) AS last FROM documents")
def store_summary(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("documents"), F.max("n_chars").alias("longest"), F.max("doc_id").alias("last"))


@query("""SELECT * FROM (VALUES ('a', true), ('b', false), ('c', true)) t(label, added)""")
def dimension_catalog(spark, d):
    dims = spark.createDataFrame([("b", "2D", 5)], "label string, dim_type string, capacity int")
    new = spark.createDataFrame([("a", "1D", 3), ("b", "1D", 3), ("c", "3D", 1), ("c", "3D", 1)], dims.schema)
    return C.registered(dims, new)


@query("SELECT l_linenumber AS x, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1")
def dropped_dimension(spark, d):
    """Samples after a dimension has been dropped, with all its samples."""
    s = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("x"), "l_orderkey")
    return C.dropped(s, "x", [2]).groupBy("x").agg(F.count("*").alias("n"))


# -------------------------------------------------------------------- saved indexes


@query(f"""WITH {_TOK}, l AS (SELECT doc_id, count(term) AS len FROM documents LEFT JOIN tok USING (doc_id) GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS avglen FROM l),
          c AS (SELECT doc_id, term, count(*) AS c FROM tok WHERE term IN ({_in(Q)}) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
          SELECT doc_id AS key, sum(c)::BIGINT AS score, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len / avglen))), 6) AS bm25 FROM c JOIN f USING (term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY 1""")
def saved_index_search(spark, d):
    """Term frequencies and BM25 from an index saved by term; only the query's postings are read."""
    at = _place(spark, "index")
    X.save_index(table(spark, d, "documents").select("doc_id", "text"), at)
    return X.search_index(spark, at, Q)


@query(f"WITH {_TOK} SELECT term, count(DISTINCT doc_id) AS documents FROM tok WHERE doc_id % 3 <> 0 GROUP BY 1")
def index_without_documents(spark, d):
    p = X.without(X.postings(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "documents").where("doc_id % 3 = 0"))
    return p.groupBy("term").agg(F.countDistinct("doc_id").alias("documents"))
