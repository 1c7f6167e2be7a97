"""Queries over texts, vectors, chunks, logs, JSON and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from polystrata.functions import anomalies as A
from polystrata.functions import scalar as S
from polystrata.operators import chunks as K
from polystrata.operators import jsondocs as J
from polystrata.operators import logs as G
from polystrata.operators import telemetry as T
from polystrata.operators import text as X
from polystrata.operators import vectors as V
from polystrata.plans.registry import query
from polystrata.sources.files import table

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP) + "]"
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_STEM = "CASE " + " ".join(f"WHEN w LIKE '%{s}' AND length(w) > {len(s) + 2} THEN left(w, length(w) - {len(s)})" for s in X.SUFFIXES) + " ELSE w END"
_TOK = f"tok AS (SELECT doc_id, {_STEM} AS term FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) WHERE octet_length(encode(w)) BETWEEN 2 AND 50 AND NOT list_contains({_STOP}, w))"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _in(q: str) -> str:
    return ", ".join(f"'{t}'" for t in sorted(set(X.query_tokens(q))))


Q = "heron there thin eaux"


@query(f"WITH {_TOK} SELECT doc_id, count(*) AS n, count(DISTINCT term) AS terms FROM tok GROUP BY 1")
def text_tokenize(spark, d):
    t = _docs(spark, d).select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("terms")).where("n > 0")


@query(f"WITH {_TOK} SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL")
def inverted_index(spark, d):
    return X.postings(_docs(spark, d))


@query(f"WITH {_TOK} SELECT count(DISTINCT term) AS terms, count(DISTINCT (doc_id, term)) AS \"references\" FROM tok")
def index_stats(spark, d):
    return X.index_stats(_docs(spark, d))


@query(f"WITH {_TOK} SELECT doc_id, count(*) AS score, list_sort(list(DISTINCT term)) AS matched FROM tok WHERE term IN ({_in(Q)}) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10")
def fts_tf_topk(spark, d):
    return X.top(X.search(_docs(spark, d), Q).drop("text"), 10)


@query(f"""WITH {_TOK}, n AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1), c AS (SELECT doc_id, term, count(*) AS c FROM tok WHERE term IN ({_in(Q)}) GROUP BY ALL)
          SELECT doc_id, round(sum((1 + log10(c)) / (1 + c / n)) / {len(set(X.query_tokens(Q)))}, 6) AS score FROM c JOIN n USING (doc_id) GROUP BY 1""")
def fts_log_tf(spark, d):
    return X.log_tf(_docs(spark, d), Q)


@query(f"""WITH {_TOK}, l AS (SELECT doc_id, count(term) AS len FROM documents LEFT JOIN tok USING (doc_id) GROUP BY 1), s AS (SELECT count(*) AS n, avg(len) AS avglen FROM l),
          c AS (SELECT doc_id, term, count(*) AS c FROM tok WHERE term IN ({_in(Q)}) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
          SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len / avglen))), 6) AS score FROM c JOIN f USING (term) JOIN l USING (doc_id) CROSS JOIN s GROUP BY 1""")
def fts_bm25(spark, d):
    return X.bm25(_docs(spark, d), Q)


_TERMS = f"w AS (SELECT DISTINCT doc_id, regexp_replace(unnest({_WORDS}), '[^\\x00-\\x7F]', '#', 'g') AS term FROM documents)"


@query(f"WITH {_TERMS}, h AS (SELECT doc_id, levenshtein(term, 'theron') AS d FROM w WHERE left(term, 3) = 'the') SELECT doc_id, round(max(1 - d / 3), 6) AS score FROM h WHERE d <= 3 GROUP BY 1")
def fts_fuzzy(spark, d):
    return X.fuzzy(_docs(spark, d), "theron")


@query(f"WITH {_TERMS}, h AS (SELECT doc_id, damerau_levenshtein(term, 'theron') AS d FROM w WHERE left(term, 3) = 'the') SELECT doc_id, round(max(1 - d / 3), 6) AS score FROM h WHERE d <= 3 GROUP BY 1")
def fts_fuzzy_damerau(spark, d):
    return X.fuzzy(_docs(spark, d), "theron", X.damerau(F.col("term"), F.lit("theron")))


@query(f"""WITH {_TOK}, s AS (SELECT doc_id, count(*) AS tf FROM tok WHERE term IN ({_in('un la')}) GROUP BY 1)
          SELECT doc_id, (tf + 10 * ((length(lower(text)) - length(replace(lower(text), 'un la', ''))) // 5))::BIGINT AS score FROM s JOIN documents USING (doc_id) WHERE contains(lower(text), 'un la')""")
def fts_phrase(spark, d):
    return X.phrase(_docs(spark, d), "un la")


@query("""WITH w AS (SELECT doc_id, string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' ') AS a FROM documents), p AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM w)
          SELECT a.doc_id, min(abs(a.i - b.i))::INT AS gap FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.x = 'un' AND b.x = 'la' GROUP BY 1 HAVING min(abs(a.i - b.i)) <= 3""")
def fts_proximity(spark, d):
    return X.near(_docs(spark, d), "un", "la", 3)


@query("SELECT doc_id, md5(replace(replace(text, 'eaux', '**eaux**'), 'the', '**the**')) AS marked FROM documents")
def highlight(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.highlight(F.col("text"), ["eaux", "the"])).alias("marked"))


@query("SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'heron')")
def substring_search(spark, d):
    return X.contains(_docs(spark, d), "HERON")


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS x FROM documents), m AS (SELECT doc_id, min(levenshtein(regexp_replace(x, '[^\\x00-\\x7F]', '#', 'g'), 'heron')) AS d FROM w GROUP BY 1)
          SELECT doc_id, CASE WHEN contains(lower(text), 'heron') THEN 1.0 ELSE round(1 - d / 10, 6) END AS score FROM m JOIN documents USING (doc_id) WHERE contains(lower(text), 'heron') OR d <= 2""")
def loose_search(spark, d):
    return X.loose(_docs(spark, d), "heron")


_GRAMS = "SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name)), lambda i: p_name[i:i+1])) AS x, list_distinct(list_transform(range(1, length(p_type)), lambda i: lower(p_type)[i:i+1])) AS y FROM part"


@query(f"WITH g AS ({_GRAMS}) SELECT p_partkey, round(2 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) AS dice FROM g")
def dice_bigrams(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(X.dice(F.col("p_name"), F.lower("p_type")), 6).alias("dice"))


@query(f"WITH g AS ({_GRAMS}) SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) AS jaccard FROM g")
def ngram_jaccard_columns(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(X.jaccard(F.col("p_name"), F.lower("p_type"), 2), 6).alias("jaccard"))


@query()
def jaro_winkler(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(X.jaro_winkler(F.col("p_name"), F.lower("p_type")), 6).alias("score"))


@query(f"""WITH {_TERMS}, e AS (SELECT doc_id, max(1 - levenshtein(term, 'theron') / 3) AS s FROM w WHERE left(term, 3) = 'the' AND levenshtein(term, 'theron') <= 3 GROUP BY 1), c AS (SELECT doc_id, 1.0 AS s FROM documents WHERE contains(lower(text), 'heron'))
          SELECT doc_id, round(max(s), 6)::DOUBLE AS score FROM (SELECT * FROM e UNION ALL SELECT * FROM c) GROUP BY 1""")
def best_of_exact_and_fuzzy(spark, d):
    return X.best_of(X.fuzzy(_docs(spark, d), "theron"), X.contains(_docs(spark, d), "heron"))


@query(f"""WITH {_TOK}, a AS (SELECT doc_id, row_number() OVER (ORDER BY count(*) DESC, doc_id) AS r FROM tok WHERE term IN ({_in(Q)}) GROUP BY 1 QUALIFY r <= 50),
          b AS (SELECT doc_id, row_number() OVER (ORDER BY count(*) DESC, doc_id) AS r FROM tok WHERE term IN ({_in('un la')}) GROUP BY 1 QUALIFY r <= 50)
          SELECT doc_id, round(sum(1 / (60 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def rrf_fusion(spark, d):
    return X.fused([X.top(X.search(_docs(spark, d), q).drop("text"), 50) for q in (Q, "un la")])


# ------------------------------------------------------------------------- vectors

_VQ = [round(((i * 37) % 64) / 64 - 0.5, 4) for i in range(64)]
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_VQ}::DOUBLE[])"


def _vec(spark, d):
    return table(spark, d, "embeddings")


@query(f"SELECT vec_id, round({_COS}, 6) AS score FROM embeddings WHERE {_COS} > -1 ORDER BY round({_COS}, 6) DESC, vec_id LIMIT 10")
def knn_cosine_topk(spark, d):
    return V.knn(_vec(spark, d), _VQ, 10, least=-1).select("vec_id", "score")


@query(f"SELECT vec_id, label, round({_COS}, 6) AS score FROM embeddings WHERE label = 3 AND {_COS} > -1 ORDER BY round({_COS}, 6) DESC, vec_id LIMIT 10")
def knn_by_label(spark, d):
    return V.knn(_vec(spark, d).where("label = 3"), _VQ, 10, least=-1).select("vec_id", "label", "score")


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label = 7)
          SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def knn_batch_join(spark, d):
    v = _vec(spark, d)
    return V.knn_join(v.where("label = 7"), v, 5)


@query()
def knn_self_join(spark, d):
    """The 5 nearest of every vector. Its SQL would be quadratic; tests hold it against brute force."""
    v = _vec(spark, d)
    return V.knn_join(v, v, 5)


@query("""WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL)
          SELECT label, max(n) AS n, list(round(m, 6) ORDER BY i) AS centroid FROM m GROUP BY 1""")
def average_embedding_per_label(spark, d):
    return V.averages(_vec(spark, d), "label")


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_VQ}::DOUBLE[]), 6) AS distance FROM embeddings")
def vector_l2(spark, d):
    return _vec(spark, d).select("vec_id", F.round(V.l2(F.col("embedding"), V.literal(_VQ)), 6).alias("distance"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def vector_unit(spark, d):
    return _vec(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("length"), F.round(V.unit(F.col("embedding"))[0], 6).alias("first"))


@query("SELECT count(*) AS vectors, max(len(embedding))::INT AS dimensions FROM embeddings")
def vector_stats(spark, d):
    return _vec(spark, d).agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimensions"))


@query(f"""WITH {_TOK}, k AS (SELECT doc_id, count(*) AS k FROM tok WHERE term IN ({_in(Q)}) GROUP BY 1), v AS (SELECT vec_id AS doc_id, round({_COS}, 6) AS v FROM embeddings WHERE {_COS} > 0.1)
          SELECT doc_id, round(coalesce(v, 0) * 0.6 + least(coalesce(k, 0) / 100, 1) * 0.4, 6) AS score FROM v FULL JOIN k USING (doc_id)""")
def hybrid_weighted(spark, d):
    v = V.scored(_vec(spark, d), _VQ).where("score > 0.1").select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"))
    return V.hybrid(v, X.search(_docs(spark, d), Q), 0.6)


@query(f"""SELECT vec_id, round(0.7 * round({_COS}, 6) + 0.3 * greatest(0, 1 - abs(epoch(ts) - epoch(TIMESTAMP '2024-01-15')) / 864000), 6) AS combined FROM embeddings JOIN events ON vec_id = event_id
          WHERE round(0.7 * round({_COS}, 6) + 0.3 * greatest(0, 1 - abs(epoch(ts) - epoch(TIMESTAMP '2024-01-15')) / 864000), 6) >= 0.2""")
def vector_time_score(spark, d):
    s = V.scored(_vec(spark, d), _VQ).select("vec_id", F.round("score", 6).alias("score"))
    e = table(spark, d, "events").select(F.col("event_id").alias("vec_id"), "ts")
    return V.time_weighted(s.join(e, "vec_id"), "2024-01-15 00:00:00", 864000).select("vec_id", "combined")


@query()
def byte_embeddings(spark, d):
    return _docs(spark, d).select("doc_id", V.byte_embedding(F.col("text")).alias("embedding"))


@query()
def word_embeddings(spark, d):
    return _docs(spark, d).select("doc_id", V.word_embedding(F.col("text")).alias("embedding"))


# -------------------------------------------------------------------------- chunks


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 462)) AS start FROM documents WHERE length(text) > 0)
          SELECT doc_id, (start // 462)::INT AS chunk, start::INT AS start, substr(text, start + 1, 512) AS content FROM s WHERE start = 0 OR least(length(text) - start, 512) >= 100""")
def fixed_chunks(spark, d):
    return K.fixed(_docs(spark, d))


@query("""WITH s AS (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 462)) AS start FROM documents WHERE length(text) > 0), c AS (SELECT count(*) AS c FROM s WHERE start = 0 OR least(n - start, 512) >= 100)
          SELECT (SELECT count(*) FROM documents) AS documents, c AS chunks, round(c / (SELECT count(*) FROM documents), 6) AS per_document FROM c""")
def chunk_stats(spark, d):
    return K.stats(_docs(spark, d), K.fixed(_docs(spark, d)))


@query()
def packed_chunks(spark, d):
    return K.context_block(K.packed(_docs(spark, d)))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 462)) AS start FROM documents WHERE length(text) > 0)
          SELECT doc_id, (start // 462)::INT AS chunk, substr(text, greatest(start - 40, 0) + 1, least(start + least(512, length(text) - start) + 40, length(text)) - greatest(start - 40, 0)) AS content FROM s WHERE start = 0 OR least(length(text) - start, 512) >= 100""")
def expanded_chunks(spark, d):
    return K.expanded(_docs(spark, d), K.fixed(_docs(spark, d)), 40)


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INT AS words, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x: trim(x) <> ''))::INT AS paragraphs FROM documents")
def text_counts(spark, d):
    return K.counts(_docs(spark, d)).drop("sentences")


# ---------------------------------------------------------------------------- logs

_LINES = """lines AS (SELECT event_id, floor(value)::BIGINT AS v, event_type, user_id, ts, event_id % 5 AS i FROM events)"""


@query(f"""WITH {_LINES} SELECT event_id, CASE i WHEN 0 THEN 'app_log' WHEN 1 THEN 'pipe_log' WHEN 2 THEN 'search_log' WHEN 3 THEN 'graph_log' END AS pattern FROM lines""")
def grok_pattern(spark, d):
    return G.parse(G.render(table(spark, d, "events"))).select("event_id", "pattern")


@query(f"""WITH {_LINES} SELECT event_id, date_trunc('second', ts) AS ts, CASE i WHEN 3 THEN event_type WHEN 2 THEN event_type ELSE event_type END AS key, CASE i WHEN 1 THEN 'user_' || user_id ELSE 'default' END AS source,
          CASE i WHEN 0 THEN 'value ' || v ELSE v::VARCHAR END AS value, CASE i WHEN 0 THEN 'string' ELSE 'int' END AS kind FROM lines WHERE i < 4""")
def grok_parse(spark, d):
    return G.records(G.parse(G.render(table(spark, d, "events")))).select("event_id", "ts", "key", "source", "value", "kind")


@query("""SELECT event_type AS key, 'user_' || user_id AS source, floor(value)::BIGINT AS value, min(event_id) AS first, count(*) - 1 AS repeats FROM events GROUP BY ALL""")
def log_dedup(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.concat(F.lit("user_"), F.col("user_id")).alias("source"), F.floor("value").alias("value"), "event_id")
    return G.deduplicated(e, "event_id")


@query("SELECT event_id, CASE WHEN value > 300 OR event_type = 'error' OR user_id IN (1, 2, 3) THEN 'primary' ELSE 'secondary' END AS route FROM events")
def log_priority_routing(spark, d):
    e = table(spark, d, "events")
    return G.priority(e, F.col("value") > 300, F.col("event_type"), F.col("user_id").cast("string"), ["1", "2", "3"]).select("event_id", "route")


@query("SELECT event_id, strftime(ts, '%Y%m%d%H') AS hour_shard FROM events")
def log_hour_shards(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMddHH").alias("hour_shard"))


# ---------------------------------------------------------------------------- JSON


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k, props ->> '$.none.x' AS absent FROM events")
def json_path_extract(spark, d):
    return table(spark, d, "events").select("event_id", J.path(F.col("props"), "k").cast("long").alias("k"), J.path(F.col("props"), "none.x").alias("absent"))


@query("SELECT event_id, 'k: ' || (props ->> '$.k') AS canonical FROM events")
def json_canonical(spark, d):
    return table(spark, d, "events").select("event_id", J.canonical(F.col("props")).alias("canonical"))


@query()
def json_similarity(spark, d):
    return J.similar(table(spark, d, "events"), '{"k": 42}', 0.5, 10, "event_id", "props")


@query("""SELECT event_id, round((a * 2 + b) / 3, 6) AS mean_score, round((a * a * 4 + b * b) / 5, 6) AS squared FROM (SELECT event_id, 1 / (1 + abs((props ->> '$.k')::BIGINT - 50)) AS a, least(value / 500, 1) AS b FROM events)""")
def json_field_scores(spark, d):
    e = table(spark, d, "events")
    sims = {"k": 1 / (1 + F.abs(J.path(F.col("props"), "k").cast("long") - 50)), "v": F.least(F.col("value") / 500, F.lit(1.0))}
    w = {"k": 2.0, "v": 1.0}
    return e.select("event_id", F.round(J.field_score(sims, w), 6).alias("mean_score"), F.round(J.squared_score(sims, w), 6).alias("squared"))


# ---------------------------------------------------------------- scalar functions


@query("""SELECT p_partkey, levenshtein(p_name, lower(p_type))::INT AS lev, damerau_levenshtein(p_name, lower(p_type))::INT AS dam, CASE WHEN length(p_name) = length(p_type) THEN hamming(p_name, lower(p_type))::INT END AS ham FROM part""")
def string_distances(spark, d):
    a, b = F.col("p_name"), F.lower("p_type")
    return table(spark, d, "part").select("p_partkey", S.levenshtein(a, b).alias("lev"), X.damerau(a, b).alias("dam"), S.hamming(a, b).alias("ham"))


@query("""SELECT p_partkey, p_name GLOB '*r?n*' AS wild, regexp_matches(p_name, '(small|large) \\w+') AS rx, regexp_extract_all(p_name, '[a-z]+') AS words, string_split(p_name, ' ') AS parts, starts_with(p_name, 'small') AS pre, ends_with(p_name, 'ring') AS suf FROM part""")
def string_words(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", S.wildcard(n, "*r?n*").alias("wild"), n.rlike("(small|large) \\w+").alias("rx"), S.matches(n, "[a-z]+").alias("words"), F.split(n, " ").alias("parts"), n.startswith("small").alias("pre"), n.endswith("ring").alias("suf"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS words FROM documents")
def unique_words(spark, d):
    return _docs(spark, d).select("doc_id", S.unique_words(F.col("text")).alias("words"))


@query("SELECT p_partkey, contains(p_name, 'small') AND NOT contains(p_name, 'ring') OR contains(p_name, 'large') AS fits FROM part")
def string_expression(spark, d):
    return table(spark, d, "part").select("p_partkey", S.expression(F.col("p_name"), '(small and not "ring") or large').alias("fits"))


@query("SELECT p_partkey, 'Part ' || p_name || ' of ' || p_brand || '!' AS line, base64(encode(p_name)) AS b64 FROM part")
def string_template(spark, d):
    c = {"name": F.col("p_name"), "brand": F.col("p_brand")}
    return table(spark, d, "part").select("p_partkey", S.template("Part {name} of {brand}!", c).alias("line"), S.base64(F.col("p_name")).alias("b64"))


@query("""SELECT p_partkey, CASE WHEN sin(p_size) <> 0 THEN round(1 / sin(p_size), 6) END AS csc, round(exp(p_size / 10), 6) AS e, round(ln(p_retailprice), 6) AS ln, round(log10(p_retailprice), 6) AS log10, round(pow(p_size, 1 / 3), 6) AS cube_root,
          round(pow(p_size, 2), 6) AS square, (2 * (p_size + 3))::INT AS perimeter, factorial(p_size % 15)::DOUBLE AS fact FROM part""")
def math_words(spark, d):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(S.cosecant(s), 6).alias("csc"), F.round(F.exp(s / 10), 6).alias("e"), F.round(F.ln(p), 6).alias("ln"), F.round(F.log10(p), 6).alias("log10"), F.round(S.nth_root(s, F.lit(3)), 6).alias("cube_root"), F.round(S.power(s, F.lit(2)), 6).alias("square"), S.perimeter(s, F.lit(3)).alias("perimeter"), S.factorial(s % 15).alias("fact"))


@query("SELECT p_partkey, round(CASE WHEN p_size < 10 THEN p_size * 2 WHEN p_size < 40 THEN 20 + (p_size - 10) * 1.0 ELSE 50 END, 6)::DOUBLE AS y FROM part")
def math_interpolation(spark, d):
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    return table(spark, d, "part").select("p_partkey", F.round(S.interpolated(F.col("p_size"), arr(0, 10, 40), arr(0, 20, 50)), 6).alias("y"))


@query("SELECT range AS i, 1.5 + range * 0.5 AS x FROM range(128)")
def series_generator(spark, d):
    return S.series(spark, 1.5, 0.5)


@query()
def deunicoded(spark, d):
    return _docs(spark, d).select("doc_id", S.deunicode(F.col("text")).alias("ascii"))


@query()
def series_breakouts(spark, d):
    return A.per_series(T.plain(table(spark, d, "events")), "breakouts")


@query()
def seasonal_outliers(spark, d):
    return A.per_series(T.plain(table(spark, d, "events")), "seasonal", period=24)
