"""Queries over graphs and the virtual filesystem."""

from __future__ import annotations

from pyspark.sql import functions as F

from polystrata.operators import graph as N
from polystrata.operators import vfs as P
from polystrata.plans.registry import query
from polystrata.sources.files import table


def _trade(spark, d):
    """Customer nation to supplier nation, weighed by the number of lines."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("src", "dst").agg(F.count("*").alias("weight"))


_E = "e AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def _dag(spark, d):
    return _trade(spark, d).where("src < dst")


@query(f"WITH {_E} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1")
def graph_degrees(spark, d):
    return N.degrees(_trade(spark, d))


@query(f"""WITH {_E} SELECT [x.src, x.dst] AS path, x.weight::DOUBLE AS weight FROM e x WHERE x.src = 0 AND x.dst <> 0
          UNION ALL SELECT [x.src, x.dst, y.dst], (x.weight + y.weight)::DOUBLE FROM e x JOIN e y ON x.dst = y.src WHERE x.src = 0 AND x.dst <> 0 AND y.dst NOT IN (x.src, x.dst)""")
def k_hop_paths(spark, d):
    return N.simple_paths(_trade(spark, d), F.col("src") == 0, 2)



@query(f"WITH RECURSIVE {_E}, r AS (SELECT 0 AS id, 0::BIGINT AS cost UNION SELECT dst, cost + weight FROM r JOIN e ON e.src = r.id AND e.src < e.dst) SELECT id, min(cost)::DOUBLE AS cost FROM r GROUP BY 1")
def shortest_path(spark, d):
    return N.shortest(_dag(spark, d), 0).select("id", "cost")


@query(f"WITH RECURSIVE {_E}, r AS (SELECT 0 AS id, 0 AS hops UNION SELECT dst, hops + 1 FROM r JOIN e ON e.src = r.id WHERE hops < 25) SELECT id, min(hops)::INT AS hops FROM r GROUP BY 1")
def bfs_hops(spark, d):
    return N.hops(_trade(spark, d), 0)


@query(f"""WITH RECURSIVE {_E}, n AS (SELECT src AS id FROM e WHERE src < dst UNION SELECT dst FROM e WHERE src < dst), r AS (SELECT id, 0 AS layer FROM n UNION SELECT dst, layer + 1 FROM r JOIN e ON e.src = r.id AND e.src < e.dst)
          SELECT id, max(layer)::INT AS layer FROM r GROUP BY 1""")
def topological_layers(spark, d):
    return N.layers(_dag(spark, d))


@query(f"""WITH {_E}, x AS (SELECT * FROM e WHERE src <> dst) SELECT [a.src, a.dst] AS path FROM x a JOIN x b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
          UNION ALL SELECT [a.src, a.dst, b.dst] FROM x a JOIN x b ON a.dst = b.src JOIN x c ON b.dst = c.src AND c.dst = a.src WHERE b.dst <> a.src AND a.src < a.dst AND a.src < b.dst""")
def graph_cycles(spark, d):
    return N.cycles(_trade(spark, d), 3)


@query(f"WITH {_E} SELECT count(*) > 0 AS cyclic FROM e WHERE src = dst OR EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)")
def cycle_check(spark, d):
    return spark.range(1).select(F.lit(N.has_cycle(_trade(spark, d))).alias("cyclic"))


@query(f"""WITH RECURSIVE {_E}, n AS (SELECT dst FROM e WHERE src < dst), s AS (SELECT DISTINCT src FROM e WHERE src < dst AND src NOT IN (FROM n)), r AS (SELECT src AS id, 0::BIGINT AS cost FROM s UNION SELECT dst, cost + weight FROM r JOIN e ON e.src = r.id AND e.src < e.dst)
          SELECT id, max(cost)::DOUBLE AS cost FROM r GROUP BY 1""")
def dag_longest_path(spark, d):
    return N.longest(_dag(spark, d))


_F = "f AS (SELECT DISTINCT '/' || regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages)"


def _files(spark, d):
    p = table(spark, d, "pages").select(P.normal(F.regexp_extract("url", "^https?://([^?#]*)", 1)).alias("path"), F.lit("text").alias("kind"))
    return p.distinct()


_NODES = """g AS (SELECT DISTINCT CASE WHEN length(path) > 1 THEN regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') ELSE path END AS path FROM f), s AS (SELECT path, string_split(path, '/') AS a FROM g),
u AS (SELECT CASE WHEN i = 1 THEN '/' ELSE array_to_string(a[1:i], '/') END AS path FROM (SELECT a, unnest(range(1, len(a))) AS i FROM s WHERE path <> '/')), folders AS (SELECT DISTINCT path FROM u),
nodes AS (SELECT path, 'folder' AS kind FROM folders UNION ALL SELECT path, 'text' FROM g WHERE path NOT IN (FROM folders))"""


@query(f"WITH {_F}, {_NODES} SELECT * FROM nodes")
def vfs_nodes(spark, d):
    return P.with_folders(_files(spark, d))


@query(f"WITH {_F}, {_NODES} SELECT CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS folder, count(*) AS children FROM nodes WHERE path <> '/' GROUP BY 1")
def vfs_ls(spark, d):
    return P.listing(P.with_folders(_files(spark, d)))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INT AS words FROM documents")
def vfs_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", P.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END::INT AS lines FROM documents")
def vfs_line_count(spark, d):
    return table(spark, d, "documents").select("doc_id", P.line_count(F.col("text")).alias("lines"))


@query("SELECT page_id, parse_filename(regexp_replace(url, '[?#].*', '')) AS file, len(list_filter(string_split(url, '/'), lambda x: x <> ''))::INT AS parts FROM pages")
def path_words(spark, d):
    from polystrata.functions import scalar as S

    return table(spark, d, "pages").select("page_id", S.filename(F.regexp_replace("url", "[?#].*", "")).alias("file"), F.size(S.path_split(F.col("url"))).alias("parts"))
