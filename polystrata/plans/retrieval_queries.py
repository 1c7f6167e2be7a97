"""Queries over chunks, vector stores, log ingestion, facets and further text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from polystrata.functions import scalar as S
from polystrata.functions import stemming
from polystrata.operators import chunks as K
from polystrata.operators import logs as G
from polystrata.operators import text as X
from polystrata.operators import vectors as V
from polystrata.plans.content_queries import _COS, _STEM, _TOK, _VQ, Q, _docs, _in, _vec
from polystrata.plans.registry import query
from polystrata.plans.store_queries import _place
from polystrata.sources.files import table

# -------------------------------------------------------------------------- chunks

_S = "s AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 462)) AS start FROM documents WHERE length(text) > 0)"
_CH = f"{_S}, c AS (SELECT doc_id, (start // 462)::INT AS chunk, start, substr(text, start + 1, 512) AS content FROM s WHERE start = 0 OR least(n - start, 512) >= 100)"


def _sql_embedding(source: str, x: str) -> str:
    """SQL of es(key, j, w), the sums of a byte embedding of ``x``, and en(key, n), their lengths."""
    return f"""eb AS (SELECT key, (i - 1) % 384 AS j, ('0x' || substr(hx, (2 * i - 1)::BIGINT, 2))::INT / 255 AS w FROM (SELECT key, hx, unnest(range(1, length(hx) // 2 + 1)) AS i FROM (SELECT key, hex(encode({x})) AS hx FROM {source}))),
es AS (SELECT key, j, sum(w) AS w FROM eb GROUP BY ALL), en AS (SELECT key, sqrt(sum(w * w)) AS n FROM es GROUP BY 1)"""


@query(f"""WITH {_S}, c AS (SELECT doc_id, (start // 462)::INT AS chunk, start, n, substr(text, start + 1, 512) AS x FROM s),
          b AS (SELECT *, instr(reverse(x), ' ') AS back FROM c), r AS (SELECT doc_id, chunk, CASE WHEN start + 512 < n AND back > 0 AND back < length(x) THEN left(x, length(x) - back) ELSE x END AS content FROM b)
          SELECT * FROM r WHERE length(content) >= 100 OR chunk = 0""")
def chunks_at_spaces(spark, d):
    return K.at_spaces(_docs(spark, d)).select("doc_id", "chunk", "content")


@query(f"WITH {_CH} SELECT doc_id, chunk, content FROM c WHERE doc_id = 7")
def chunks_of_document(spark, d):
    return K.of_document(K.fixed(_docs(spark, d)), 7).select("doc_id", "chunk", "content")


@query(f"WITH {_CH}, tok AS (SELECT doc_id || '_chunk_' || chunk AS chunk_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS w FROM c), k AS (SELECT chunk_id, count(*) FILTER (octet_length(encode(w)) BETWEEN 2 AND 50 AND w NOT IN {str(X.STOP)}) AS terms FROM tok GROUP BY 1) SELECT doc_id || '_chunk_' || chunk AS chunk_id, doc_id, (chunk % 4)::INT AS shard, coalesce(terms, 0)::INT AS terms FROM c LEFT JOIN k ON k.chunk_id = doc_id || '_chunk_' || chunk")
def stored_chunks(spark, d):
    return K.stored(K.fixed(_docs(spark, d)), 4).select("chunk_id", "doc_id", "shard", F.size("terms").alias("terms"))


@query(f"WITH {_CH} SELECT (chunk % 4)::INT AS shard, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM c GROUP BY 1")
def chunks_by_shard(spark, d):
    return K.fixed(_docs(spark, d)).groupBy(F.pmod("chunk", F.lit(4)).cast("int").alias("shard")).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


@query("SELECT doc_id, CASE WHEN length(text) <= 512 OR (length(text) - 1) % 462 >= 99 THEN text ELSE left(text, greatest((length(text) - 1) // 462 * 462 + 50, 512)) END AS text FROM documents WHERE length(text) > 0")
def rebuilt_documents(spark, d):
    """Documents from their chunks: whole but for an end too short to be a chunk and not in the one before."""
    return K.rebuilt(K.fixed(_docs(spark, d)))


@query(f"WITH {_CH} SELECT doc_id, count(*) AS chunks FROM c WHERE doc_id % 5 <> 0 GROUP BY 1")
def chunks_without_documents(spark, d):
    left = K.without(K.fixed(_docs(spark, d)), table(spark, d, "documents").where("doc_id % 5 = 0"))
    return left.groupBy("doc_id").agg(F.count("*").alias("chunks"))


_CE = f"{_CH}, cc AS (SELECT doc_id || '_chunk_' || chunk AS key, * FROM c), q AS (SELECT 'q' AS key, '{Q}' AS content), ac AS (SELECT key, content FROM cc UNION ALL SELECT key, content FROM q), {_sql_embedding('ac', 'content')}, sims AS (SELECT a.key, round(sum(a.w * b.w) / any_value(na.n) / any_value(nb.n), 6) AS score FROM es a JOIN es b ON b.key = 'q' AND a.j = b.j JOIN en na ON na.key = a.key JOIN en nb ON nb.key = 'q' WHERE a.key <> 'q' GROUP BY 1)"


@query(f"WITH {_CE} SELECT key AS chunk_id, split_part(key, '_chunk_', 1) AS doc, score FROM sims WHERE score > 0.3 ORDER BY score DESC, key LIMIT 10")
def chunk_knn(spark, d):
    return K.near(K.stored(K.fixed(_docs(spark, d)), 4), Q, 10)


_KEPT = f"octet_length(encode(w)) BETWEEN 2 AND 50 AND w NOT IN {X.STOP}"


@query(f"""WITH {_CE}, tk AS (SELECT key, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS w FROM cc), st AS (SELECT key, {_STEM} AS term FROM tk WHERE {_KEPT}),
          kw AS (SELECT key, count(*) AS k FROM st WHERE term IN ({_in(Q)}) GROUP BY 1 ORDER BY k DESC, key LIMIT 20), vs AS (SELECT key, score AS v FROM sims WHERE score > 0.3 ORDER BY score DESC, key LIMIT 20),
          b AS (SELECT key, round(coalesce(v, 0) * 0.7 + least(coalesce(k, 0) / 10, 1) * 0.3, 7) AS score FROM vs FULL JOIN kw USING (key) ORDER BY score DESC, key LIMIT 10)
          SELECT key AS chunk_id, split_part(key, '_chunk_', 1) AS doc, score, content FROM b JOIN cc USING (key)""")
def chunk_hybrid(spark, d):
    return K.hybrid(K.stored(K.fixed(_docs(spark, d)), 4), Q, 10)


@query("SELECT doc_id, '[Main Content]' || chr(10) || text AS block FROM documents WHERE length(text) BETWEEN 1 AND 512 AND NOT regexp_matches(text, '^\\s|\\s$')")
def context_blocks(spark, d):
    """A document that is one chunk has no context before or after it."""
    docs = _docs(spark, d).where(F.length("text").between(1, 512) & ~F.col("text").rlike("^\\s|\\s$"))
    c = K.fixed(docs).withColumns({"before": F.lit(""), "after": F.lit("")})
    return K.context_block(c).select("doc_id", "block")


# ------------------------------------------------------------------------- vectors


@query(f"WITH x AS (SELECT event_id AS key, event_type || ' ' || value::DECIMAL(18,2)::VARCHAR AS x FROM events), {_sql_embedding('x', 'x')} SELECT key AS id, j::INT AS place, round(w / n, 6) AS v FROM es JOIN en USING (key) WHERE j < 3")
def telemetry_embeddings(spark, d):
    """Telemetry rows with the embedding of their text; its first three numbers."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", F.col("value").cast("decimal(18,2)").cast("string")).alias("x"))
    e = e.select("id", V.byte_embedding(F.col("x")).alias("e"))
    return e.select("id", F.posexplode(F.slice("e", 1, 3)).alias("place", "v")).select("id", "place", F.round("v", 6).alias("v"))


@query(f"WITH x AS (SELECT doc_id AS key, text AS x FROM documents WHERE length(text) BETWEEN 1 AND 2000), {_sql_embedding('x', 'x')}, p AS (SELECT key, round(n, 4) AS length, list(round(w / n, 6) ORDER BY j) AS v FROM es JOIN en USING (key) WHERE j < 8 GROUP BY ALL) SELECT key AS doc_id, v FROM p")
def byte_embedding_head(spark, d):
    t = _docs(spark, d).where(F.length("text").between(1, 2000)).select("doc_id", F.slice(V.byte_embedding(F.col("text")), 1, 8).alias("e"), F.octet_length("text").alias("n"))
    return t.select("doc_id", F.transform(F.slice("e", 1, F.least(F.lit(8), "n")), lambda x: F.round(x, 6)).alias("v"))


@query(f"WITH x AS (SELECT 'a' || p_partkey AS key, p_name AS x FROM part UNION ALL SELECT 'b' || p_partkey, lower(p_type) FROM part), {_sql_embedding('x', 'x')} SELECT p_partkey, round(sum(a.w * b.w) / any_value(na.n) / any_value(nb.n), 6) AS score FROM part JOIN es a ON a.key = 'a' || p_partkey JOIN es b ON b.key = 'b' || p_partkey AND a.j = b.j JOIN en na ON na.key = a.key JOIN en nb ON nb.key = b.key GROUP BY 1")
def text_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(V.text_similarity(F.col("p_name"), F.lower("p_type")), 6).alias("score"))


@query("""WITH b AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)
          SELECT doc_id, list_transform(range(0, 384), lambda i: round(CASE WHEN n < 1000 THEN i / 384 ELSE ('0x' || substr(h, (i * (n // 384) * 2 + 1)::BIGINT, 2))::INT / 255 END, 6)) AS v FROM b""")
def binary_embeddings(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.transform(V.binary_embedding(F.encode("text", "UTF-8")), lambda x: F.round(x, 6)).alias("v"))


@query(f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings WHERE {_COS} > 0.3 ORDER BY round({_COS}, 6) DESC, vec_id LIMIT 10")
def knn_all_modalities(spark, d):
    return V.knn(_vec(spark, d), _VQ, 10).select("vec_id", "label", "score")


@query("SELECT 'v' || vec_id AS key, label % 3 AS modality, CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END AS written FROM embeddings WHERE vec_id % 7 <> 0")
def vector_store(spark, d):
    """Vectors saved by modality, a fourth written again, a seventh deleted, and read back."""
    v = _vec(spark, d).select(F.concat(F.lit("v"), "vec_id").alias("key"), (F.col("label") % 3).alias("modality"), "embedding", F.col("vec_id").alias("seq"), F.lit(0).alias("written"))
    now = V.upserted(v, v.where("seq % 4 = 0").withColumn("written", F.lit(1))).where("seq % 7 <> 0")
    at = _place(spark, "vectors")
    now.write.partitionBy("modality").parquet(at)
    return spark.read.parquet(at).select("key", "modality", "written")


@query(f"WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL), v AS (SELECT label, list(m ORDER BY i) AS e FROM c GROUP BY 1) SELECT label, round(list_cosine_similarity(e, {_VQ}::DOUBLE[]), 6) AS score FROM v WHERE list_cosine_similarity(e, {_VQ}::DOUBLE[]) > -1 ORDER BY score DESC, label LIMIT 3")
def knn_dimension_labels(spark, d):
    """The labels nearest to a vector by their mean embeddings."""
    return V.knn(V.averages(_vec(spark, d), "label", digits=12), _VQ, 3, "label", "centroid", least=-1).select("label", "score")


@query(f"""WITH e AS (SELECT vec_id AS id, ts, event_type AS key, 'user_' || user_id % 3 AS source, embedding::DOUBLE[] AS v FROM embeddings JOIN events ON vec_id = event_id), m AS (SELECT * FROM e WHERE id = 7),
          s AS (SELECT e.id, round(0.8 * round(list_cosine_similarity(e.v, m.v), 6) + 0.2 * (1 - abs(epoch(e.ts) - epoch(m.ts)) / 864000), 6) AS combined FROM e JOIN m ON e.key = m.key AND e.source = m.source AND e.id <> m.id AND abs(epoch(e.ts) - epoch(m.ts)) <= 864000) SELECT * FROM s WHERE combined >= 0.1""")
def similar_around_event(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("vec_id"), "ts", F.col("event_type").alias("key"), F.concat(F.lit("user_"), F.col("user_id") % 3).alias("source"))
    return V.around_event(_vec(spark, d).join(e, "vec_id").withColumnRenamed("vec_id", "id"), 7, 240, least=0.1)


@query(f"""SELECT vec_id, round(0.7 * round({_COS}, 6) + 0.3 * (ts BETWEEN '2024-01-05' AND '2024-01-15')::INT, 6) AS combined FROM embeddings JOIN events ON vec_id = event_id
          WHERE round(0.7 * round({_COS}, 6) + 0.3 * (ts BETWEEN '2024-01-05' AND '2024-01-15')::INT, 6) >= 0.2""")
def vector_time_in_range(spark, d):
    s = V.scored(_vec(spark, d), _VQ).select("vec_id", F.round("score", 6).alias("score"))
    return V.within_time(s.join(table(spark, d, "events").select(F.col("event_id").alias("vec_id"), "ts"), "vec_id"), "2024-01-05", "2024-01-15").select("vec_id", "combined")


@query(f"""WITH {_TOK}, k AS (SELECT doc_id, count(*) AS k FROM tok WHERE term IN ({_in(Q)}) GROUP BY 1 ORDER BY k DESC, doc_id LIMIT 20), v AS (SELECT vec_id AS doc_id, round({_COS}, 6) AS v FROM embeddings WHERE {_COS} > 0.1 ORDER BY v DESC, doc_id LIMIT 20),
          b AS (SELECT doc_id, round(coalesce(v, 0) * 0.6 + least(coalesce(k, 0) / 100, 1) * 0.4, 6) AS score FROM v FULL JOIN k USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10)
          SELECT doc_id, score, left(text, 200) AS preview FROM b JOIN documents USING (doc_id)""")
def hybrid_topk(spark, d):
    """The 10 best of the 20 best of either list, with the first 200 characters of each."""
    v = V.scored(_vec(spark, d), _VQ).where("score > 0.1").select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"))
    best = V.hybrid_top(v, X.search(_docs(spark, d), Q), 10, 0.6)
    return _docs(spark, d).join(F.broadcast(best), "doc_id").select("doc_id", "score", F.substring("text", 1, 200).alias("preview"))  # 10 rows


# ---------------------------------------------------------------------------- logs


@query("""SELECT event_id, CASE event_id % 8 WHEN 6 THEN 'vector_log' WHEN 7 THEN 'json_log' ELSE 'pipe_log' END AS pattern,
          CASE event_id % 8 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'bool' WHEN 3 THEN 'null' WHEN 4 THEN 'json' WHEN 5 THEN 'string' WHEN 6 THEN 'int' ELSE 'json' END AS kind,
          CASE event_id % 8 WHEN 0 THEN v WHEN 1 THEN v || '.5' WHEN 2 THEN 'true' WHEN 3 THEN 'null' WHEN 4 THEN '{"k": ' || v || '}' WHEN 5 THEN 'text ' || v WHEN 6 THEN v ELSE '{"n": ' || v || '}' END AS value,
          CASE WHEN event_id % 8 < 7 THEN date_trunc('second', ts) END AS ts, CASE WHEN event_id % 8 < 6 THEN 'host_' || user_id ELSE 'default' END AS source
          FROM (SELECT *, floor(value)::BIGINT::VARCHAR AS v FROM events)""")
def grok_values(spark, d):
    """Every kind of value, and every pattern that grok_parse doesn't meet."""
    return G.records(G.parse(G.rendered_values(table(spark, d, "events")))).select("event_id", "pattern", "kind", "value", "ts", "source")


@query("""SELECT event_id, CASE WHEN event_id % 8 < 6 THEN 'test' END AS env, CASE WHEN event_id % 8 < 6 THEN 'z' || user_id % 3 END AS zone, CASE WHEN event_id % 8 = 6 THEN '64' END AS dimensions, CASE WHEN event_id % 8 < 6 THEN 2 WHEN event_id % 8 = 6 THEN 3 ELSE 1 END AS fields FROM events""")
def log_metadata(spark, d):
    m = G.metadata(G.parse(G.rendered_values(table(spark, d, "events"))))
    get = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return m.select("event_id", get("env"), get("zone"), get("dimensions"), F.size("metadata").alias("fields"))


@query("SELECT event_id, event_type AS word, user_id::VARCHAR AS n, '10.0.0.' || user_id % 256 AS ip, CASE WHEN event_id % 2 = 0 THEN 'rest ' || event_id END AS rest FROM events")
def grok_full(spark, d):
    line = F.concat_ws(" ", "event_type", "user_id", F.concat(F.lit("from 10.0.0."), F.col("user_id") % 256, F.lit(":"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" rest "), "event_id")).otherwise(F.lit(""))))
    e = table(spark, d, "events").select("event_id", G.grokked(line, "%{WORD:word} %{INT:n} from %{IP:ip}:%{SPACE}%{GREEDYDATA:rest}").alias("f"))
    return e.select("event_id", *(F.try_element_at("f", F.lit(k)).alias(k) for k in ("word", "n", "ip", "rest")))


def _texts(spark, d):
    e = table(spark, d, "events")
    text = F.concat_ws(" ", "event_type", F.col("user_id") % 5, F.floor(F.col("value") / 100).cast("long"))
    return e.select(F.col("event_id").alias("id"), "ts", F.date_format("ts", "yyyyMMdd").alias("day"), F.concat(F.lit("user_"), F.col("user_id") % 3).alias("source"), text.alias("text"))


@query()
def log_near_duplicates(spark, d):
    """Primaries and secondaries of a day and source by likeness of their texts. It depends on the rows before, so it has no SQL; tests hold it against a plain loop."""
    return G.near_duplicates(_texts(spark, d), ["day", "source"], ["ts"])


@query()
def log_ingestion(spark, d):
    """Lines to stored records: parsed, de-duplicated, sharded by hour."""
    return G.ingested(G.render(table(spark, d, "events")), "event_id")


@query("SELECT DISTINCT event_type AS value, true AS maybe FROM events UNION ALL SELECT 'absent', false")
def bloom_filter(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("value"))
    bits = G.bloom(e, "value")
    return G.maybe_in(e.distinct().unionByName(spark.range(1).select(F.lit("absent").alias("value"))), "value", bits)


# -------------------------------------------------------------------- text search

@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)
          SELECT term, damerau_levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g'), 'theron')::INT AS distance FROM w WHERE damerau_levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '#', 'g'), 'theron') <= 2""")
def vocabulary_search(spark, d):
    """Words within two edits of one; each once, with its least distance."""
    return X.vocabulary(_docs(spark, d), "theron", 2)


@query()
def mean_similarity(spark, d):
    """Mean of Jaro-Winkler and Dice. Half transpositions count, unlike in SQL's function; tests hold it against a plain loop."""
    return table(spark, d, "part").select("p_partkey", F.round(X.mean_similarity(F.col("p_name"), F.lower("p_type")), 6).alias("score"))


@query("SELECT doc_id, md5(replace(replace(text, 'walk', '**walk**'), 'eaux', '**eaux**')) AS marked FROM documents")
def highlight_stemmed(spark, d):
    """The stems of the query's terms are marked, wherever they occur."""
    return _docs(spark, d).select("doc_id", F.md5(X.highlight(F.col("text"), X.query_tokens("the walking eaux"))).alias("marked"))


@query("""WITH f AS (SELECT * FROM part WHERE p_size < 25), c AS (SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM f GROUP BY 2)
          SELECT (SELECT count(*) FROM f) AS total, (SELECT list(p_partkey ORDER BY p_partkey) FROM (FROM f ORDER BY p_partkey LIMIT 5 OFFSET 10)) AS page, (SELECT list(facet || ':' || value || ':' || n ORDER BY facet, n DESC, value) FROM c) AS counts""")
def facet_page(spark, d):
    return X.facet_page(table(spark, d, "part"), ["p_brand", "p_type"], F.col("p_size") < 25, "p_partkey", 10, 5)


@query()
def english_stems(spark, d):
    """Words of the documents by their Porter2 stem; tests hold the stemmer against published pairs."""
    w = _docs(spark, d).select(F.explode(F.split("text", "\\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.select("n", stemming.english(F.col("word")).alias("stem")).groupBy("stem").agg(F.sum("n").alias("n"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines, list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: w))) AS words FROM documents WHERE NOT contains(text, chr(13))")
def text_lines(spark, d):
    t = _docs(spark, d).where(~F.contains("text", F.lit("\r")))
    return t.select("doc_id", F.size(S.lines(F.col("text"))).alias("lines"), S.unique_words(F.col("text")).alias("words"))


@query(f"WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM documents), s AS (SELECT doc_id, {_STEM} AS t FROM w) SELECT doc_id, list_sort(list(DISTINCT t)) AS stems FROM s GROUP BY 1")
def stemmed_words(spark, d):
    return _docs(spark, d).select("doc_id", S.stemmed_words(F.col("text")).alias("stems")).where(F.size("stems") > 0)


@query("SELECT p_partkey, p_name AS back, length(p_name) > 0 AS matched FROM part")
def string_round_trips(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", S.unbase64(S.base64(n)).alias("back"), (S.fuzzymatch(n, F.substring(n, 1, 3)) > 0).alias("matched"))


@query("SELECT p_partkey, true AS ipv4, true AS word, true AS roll, true AS ulid, true AS uuid FROM part")
def made_values(spark, d):
    """Made values have their form; what they are is chance."""
    p = table(spark, d, "part").select("p_partkey", S.random_ipv4(1).alias("ip"), S.random_password(12, 5).alias("pw"), S.random_int(1, 6, 9).alias("roll"), S.ulid(F.lit("2024-01-15").cast("timestamp"), 3).alias("ulid"), F.uuid().alias("uuid"))
    return p.select("p_partkey", F.col("ip").rlike(r"^\d{1,3}(\.\d{1,3}){3}$").alias("ipv4"), F.col("pw").rlike("^[A-Za-z2-9]{12}$").alias("word"), F.col("roll").between(1, 6).alias("roll"), F.col("ulid").rlike("^[0-7][0-9A-HJKMNP-TV-Z]{25}$").alias("ulid"), F.col("uuid").rlike("^[0-9a-f-]{36}$").alias("uuid"))
