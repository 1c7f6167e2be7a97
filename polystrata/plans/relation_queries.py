"""Queries over graphs, root causes, JSON documents, the virtual filesystem and streams: storage, filters, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from polystrata.operators import graph as N
from polystrata.operators import jsondocs as J
from polystrata.operators import rca as Q
from polystrata.operators import routing as R
from polystrata.operators import telemetry as T
from polystrata.operators import vfs as P
from polystrata.plans.graph_queries import _E, _F, _NODES, _files, _trade
from polystrata.plans.registry import query
from polystrata.plans.telemetry_queries import _FOUND, _T, _events, _found
from polystrata.sources.files import table

# -------------------------------------------------------------------------- graphs


def _nodes(spark, d):
    """Nations, of a type by their region, with properties."""
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("node_type"), F.create_map(F.lit("name"), "n_name", F.lit("parity"), (F.col("n_nationkey") % 2).cast("string")).alias("properties"))


def _edges(spark, d):
    return _trade(spark, d).withColumn("kind", F.when(F.col("weight") % 2 == 0, "even").otherwise("odd"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 1")
def graph_nodes_where(spark, d):
    return N.nodes_where(_nodes(spark, d), "r1", properties={"parity": "1"}).select("id", F.element_at("properties", "name").alias("name"))


@query("SELECT n_nationkey AS id FROM nation WHERE n_nationkey IN (3, 5, 7, 11) ORDER BY 1 LIMIT 2 OFFSET 1")
def graph_nodes_page(spark, d):
    return N.nodes_where(_nodes(spark, d), ids=[3, 5, 7, 11, 99], offset=1, limit=2).select("id")


@query(f"WITH {_E} SELECT src, dst, weight FROM e WHERE weight % 2 = 0 AND weight BETWEEN 4 AND 12")
def graph_edges_where(spark, d):
    return N.edges_where(_edges(spark, d), "even", 4, 12).select("src", "dst", "weight")


@query(f"""WITH {_E}, x AS (SELECT * FROM e WHERE weight % 2 = 0 AND src <> dst), p AS (SELECT [a.src, a.dst] AS path, a.weight::DOUBLE AS weight FROM x a WHERE a.src < 3 AND a.dst > 20
          UNION ALL SELECT [a.src, a.dst, b.dst], (a.weight + b.weight)::DOUBLE FROM x a JOIN x b ON a.dst = b.src WHERE a.src < 3 AND b.dst > 20 AND b.dst NOT IN (a.src, a.dst)
          UNION ALL SELECT [a.src, a.dst, b.dst, c.dst], (a.weight + b.weight + c.weight)::DOUBLE FROM x a JOIN x b ON a.dst = b.src JOIN x c ON b.dst = c.src WHERE a.src < 3 AND c.dst > 20 AND b.dst NOT IN (a.src, a.dst) AND c.dst NOT IN (a.src, a.dst, b.dst))
          SELECT path, weight FROM p ORDER BY weight DESC, path LIMIT 50""")
def graph_paths_between(spark, d):
    n = _nodes(spark, d)
    return N.paths_between(_edges(spark, d), n, n.where("id < 3"), n.where("id > 20"), "even", 3, 50)


@query(f"WITH {_E} SELECT 'node' AS what, n_nationkey AS a, NULL::INT AS b FROM nation WHERE n_nationkey NOT IN (1, 12) UNION ALL SELECT 'edge', src, dst FROM e WHERE src NOT IN (1, 12) AND dst NOT IN (1, 12)")
def graph_without_nodes(spark, d):
    """Nodes 1 and 12 are deleted with their edges; 10 to 19 stay."""
    n, e = N.without_nodes(_nodes(spark, d), _edges(spark, d), _nodes(spark, d).where("id IN (1, 12)"))
    return n.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit(None).cast("int").alias("b")).unionByName(e.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"WITH {_E} SELECT src, dst, weight + CASE WHEN src % 2 = 0 THEN 1 ELSE 0 END AS weight FROM e")
def graph_edge_store(spark, d):
    """An edge written again takes the place of the one between the two nodes."""
    e = _trade(spark, d).withColumn("seq", F.lit(0))
    again = e.where("src % 2 = 0").withColumn("weight", F.col("weight") + 1).withColumn("seq", F.lit(1))
    return N.last_edges(e.unionByName(again), "seq").select("src", "dst", "weight")


@query(f"""WITH {_E}, n AS (SELECT ('0x' || substr(md5(n_nationkey::VARCHAR), 1, 8))::BIGINT % 3 AS shard, count(*) AS nodes FROM nation GROUP BY 1), x AS (SELECT ('0x' || substr(md5(src::VARCHAR), 1, 8))::BIGINT % 3 AS shard, count(*) AS edges FROM e GROUP BY 1)
          SELECT shard::INT AS shard, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM n FULL JOIN x USING (shard)""")
def graph_by_shard(spark, d):
    return N.by_shard(_nodes(spark, d), _edges(spark, d), lambda c: R.by_hash(c.cast("string"), 3))


@query(f"""WITH RECURSIVE {_E}, r AS (SELECT 0 AS id, 0 AS hops, 0::BIGINT AS cost UNION SELECT dst, hops + 1, cost + weight FROM r JOIN e ON e.src = r.id AND e.src < e.dst AND e.dst - e.src <= 4), t AS (SELECT hops, cost FROM r WHERE id = 24)
          SELECT hops, min(cost)::DOUBLE AS weight FROM t WHERE hops = (SELECT min(hops) FROM t) GROUP BY 1""")
def graph_meeting(spark, d):
    """A way of fewest edges between two nodes, searched from both ends."""
    return N.meet(_trade(spark, d).where("src < dst AND dst - src <= 4"), 0, 24)


# --------------------------------------------------------------------- root causes


@query(f"WITH {_T}, a AS (SELECT x.id, count(DISTINCT y.key) AS n FROM t x JOIN t y ON y.key IN ('error', 'click', 'signup') AND (y.ts > x.ts OR y.ts = x.ts AND y.id >= x.id) AND epoch_us(y.ts) - epoch_us(x.ts) <= 3600000000 GROUP BY 1) SELECT count(*) FILTER (n = 3) AS n FROM a")
def pattern_windows(spark, d):
    return Q.whole_windows(_events(spark, d), ["error", "click", "signup"], 3600)


@query(f"WITH {_T} SELECT row_number() OVER (ORDER BY count(*), key) AS place, key, count(*) AS n FROM t WHERE key IN ('error', 'click', 'signup') GROUP BY key")
def pattern_order(spark, d):
    return Q.by_frequency(_events(spark, d), ["error", "click", "signup"])


@query(f"""WITH {_FOUND}, r AS (SELECT a AS root, row_number() OVER (ORDER BY max(confidence) DESC, a) AS place FROM found GROUP BY 1)
          SELECT root, place, ['{"', '".join(Q.ADVICE)}'][((place - 1) % {len(Q.ADVICE)} + 1)::INT] AS advice FROM r""")
def rca_advice(spark, d):
    return Q.recommendations(_found(spark, d)).select("root", "place", "advice")


@query(f"""WITH {_FOUND} SELECT (SELECT list(DISTINCT a ORDER BY a) FROM found WHERE confidence > 0.001 AND n >= 2) AS roots, count(*) AS patterns, count(DISTINCT (a, b)) AS links, count(DISTINCT b) AS affected, (SELECT a || ' -> ' || b FROM found ORDER BY confidence DESC, a || ' -> ' || b DESC LIMIT 1) AS strongest FROM found""")
def rca_report(spark, d):
    return Q.report(_found(spark, d), 0.001, 2)


@query()
def rca_chains(spark, d):
    """Causal chains by one greedy pass, which SQL can't express; tests hold it against a plain loop."""
    got = Q.chains(Q.causal_links(_found(spark, d)))
    return spark.createDataFrame([(i, c) for i, c in enumerate(got)], "chain int, keys array<string>")


# ---------------------------------------------------------------------------- JSON


def _objects(spark, d):
    """Nested JSON of each part, its keys out of order, with lists, upper case and blanks."""
    p = table(spark, d, "part")
    inner = F.struct(F.col("p_type").alias("type"), F.array(F.lit("  B "), F.lit("a")).alias("list"), F.struct(F.col("p_size").alias("z"), F.lit(True).alias("a")).alias("deep"))
    return p.select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("name"), F.col("p_brand").alias("brand"), inner.alias("info"))).alias("content"))


@query("SELECT p_partkey AS id, 'brand: ' || lower(p_brand) || ', info: deep: a: true, z: ' || p_size || ', list: [b, a], type: ' || lower(p_type) || ', name: ' || p_name AS canonical FROM part")
def json_canonical_nested(spark, d):
    return _objects(spark, d).select("id", J.canonical(F.col("content")).alias("canonical"))


@query("""SELECT p_partkey AS id, ['brand', 'name'] AS fields, true AS found FROM part""")
def json_field_prints(spark, d):
    m = _objects(spark, d).select("id", J.field_prints(F.col("content"), ["brand", "name", "info"], ("info",)).alias("m"))
    return m.select("id", F.array_sort(F.map_keys("m")).alias("fields"), (F.element_at("m", "name") != "").alias("found"))


@query("SELECT p_partkey AS id, 1.0 AS score FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 3) ORDER BY p_partkey LIMIT 5")
def json_field_search(spark, d):
    """Documents whose brand is just that of one: their prints are equal."""
    o = _objects(spark, d)
    return J.similar_field(o, o.where("id = 3").first()["content"], "brand", 0.9999999, 5, "id", "content")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS written FROM part WHERE p_partkey % 4 <> 0")
def json_store(spark, d):
    o = _objects(spark, d).withColumns({"seq": F.col("id"), "written": F.lit(0)})
    return J.stored(o, o.where("id % 3 = 0").withColumn("written", F.lit(1)), o.where("id % 4 = 0")).select("id", "written")


@query("SELECT event_id, '{' || chr(10) || '  \"k\": ' || (props ->> '$.k') || chr(10) || '}' AS pretty FROM events")
def json_pretty(spark, d):
    return table(spark, d, "events").select("event_id", J.pretty(F.col("props")).alias("pretty"))


# -------------------------------------------------------------- virtual filesystem


@query(f"WITH {_F}, {_NODES} SELECT path || '/new' AS path, CASE kind WHEN 'folder' THEN NULL ELSE 'parent is no folder' END AS error FROM nodes WHERE path <> '/' UNION ALL SELECT path, 'exists' FROM nodes UNION ALL SELECT '/no/such/place', 'no parent'")
def vfs_created(spark, d):
    """What comes of making a node below every node, every node again, and one below nothing."""
    n = P.with_folders(_files(spark, d))
    new = n.where("path <> '/'").select(F.concat("path", F.lit("/new")).alias("path")).unionByName(n.select("path")).unionByName(spark.range(1).select(F.lit("no/such//place/").alias("path")))
    return P.created(n, new)


@query(f"WITH {_F}, {_NODES} SELECT '/links' || path AS path, path AS target, kind FROM nodes WHERE path <> '/' UNION ALL SELECT '/links/none', '/none', NULL")
def vfs_links(spark, d):
    n = P.with_folders(_files(spark, d))
    links = n.where("path <> '/'").select(F.concat(F.lit("/links"), "path").alias("path"), "path").toDF("path", "target").unionByName(spark.range(1).select(F.lit("/links/none").alias("path"), F.lit("/none/").alias("target")))
    return P.targets(n, links)


@query(f"WITH {_F}, {_NODES}, busy AS (SELECT DISTINCT CASE WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS path FROM nodes WHERE path <> '/') SELECT path, kind FROM nodes WHERE path IN (FROM busy) OR path = '/'")
def vfs_removed(spark, d):
    """Of all nodes those that may go are removed: folders with a child, and the root, stay."""
    n = P.with_folders(_files(spark, d))
    return P.removed(n, n.select("path"))


@query(f"WITH {_F}, {_NODES}, t AS (SELECT min(path) AS p FROM nodes WHERE kind = 'text') SELECT path, kind FROM nodes, t WHERE path = '/' OR p = path OR starts_with(p, path || '/')")
def vfs_walk(spark, d):
    n = P.with_folders(_files(spark, d))
    return P.walked(n, n.where("kind = 'text'").agg(F.min("path")).first()[0])


@query("SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 3 = 0 THEN ['brand', 'info', 'name'] ELSE [] END AS fields, p_partkey % 3 < 2 AS valid FROM part")
def vfs_json_nodes(spark, d):
    o = _objects(spark, d).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 3 == 0, F.col("content")).when(F.col("id") % 3 == 1, F.lit("[1, 2]")).otherwise(F.lit("{no")).alias("content"))
    return P.json_nodes(o, "content")


@query("SELECT p_partkey, list_transform(range(0, p_partkey % 3), lambda i: 'f' || i) AS names FROM part")
def vfs_function_names(spark, d):
    """Names of the functions in a text of code."""
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("\n", F.transform(F.slice(F.array(F.lit("0"), F.lit("1")), 1, (F.col("p_partkey") % 3).cast("int")), lambda i: F.concat(F.lit("pub fn f"), i, F.lit("() {}")))).alias("code"))
    return p.select("p_partkey", P.function_names(F.col("code")).alias("names"))


@query(f"WITH {_F}, {_NODES} SELECT bool_or(path <> '/' AND starts_with(path, '/')) AND true AS busy FROM nodes")
def vfs_removable(spark, d):
    n = P.with_folders(_files(spark, d))
    return P.removable(n, "/").select((~F.col("removable")).alias("busy"))


# -------------------------------------------------------------------------- series


@query(f"WITH {_T}, g AS (SELECT date_trunc('hour', ts) AS hour, key, avg(value) AS v FROM t GROUP BY ALL) SELECT hour, count(*)::INT AS series, round(sum(v), 4) AS total FROM g GROUP BY 1")
def hourly_series(spark, d):
    from polystrata.functions import anomalies as A

    h = A.hourly(_events(spark, d))
    return h.select("hour", F.size("values").alias("series"), F.round(F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"WITH {_T} SELECT key, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM t GROUP BY 1")
def outer_percentiles(spark, d):
    return T.percentiles(_events(spark, d), shares=(0.1, 0.9))
