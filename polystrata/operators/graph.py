"""Property graphs: nodes (id, ...) and edges (src, dst, weight, kind). Iterations end in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polystrata.session import materialize


def last_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge for each pair of nodes: the last written."""
    w = Window.partitionBy("src", "dst").orderBy(F.desc(order))
    return edges.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degrees of all nodes with edges."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def simple_paths(edges: DataFrame, starts: Column, depth: int = 3) -> DataFrame:
    """(path, weight): all simple paths of 1 to ``depth`` edges from the nodes that fit."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("w"))
    step = e.where(starts & (F.col("src") != F.col("dst"))).select(F.array("src", "dst").alias("path"), F.col("w").alias("weight"))
    out = step
    for _ in range(depth - 1):
        nxt = e.select(F.col("src").alias("__s"), "dst", "w")
        step = step.join(nxt, F.element_at("path", -1) == F.col("__s")).where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.concat("path", F.array("dst")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"))
        out = out.unionByName(step)
    return out


def shortest(edges: DataFrame, start, most_rounds: int = 1000) -> DataFrame:
    """(id, cost, path) of the least-cost way from ``start`` to every node that can be reached; costs mustn't be negative.

    Only nodes whose cost fell in a round go on to the next.
    """
    e = edges.groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("w"))
    kind = dict(edges.dtypes)["src"]
    spark = edges.sparkSession
    known = materialize(spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(0.0).alias("cost"), F.array(F.lit(start).cast(kind)).alias("path"), F.lit(True).alias("new")), "ways")
    for _ in range(most_rounds):
        front = known.where("new").select(F.col("id").alias("src"), "cost", "path")
        found = front.join(e, "src").select(F.col("dst").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("dst")).alias("path"), F.lit(True).alias("new"))
        best = known.withColumn("new", F.lit(False)).unionByName(found).groupBy("id").agg(F.min(F.struct("cost", "new", "path")).alias("b"))
        known = materialize(best.select("id", "b.cost", "b.path", "b.new"), "ways")
        if known.where("new").isEmpty():
            return known.select("id", "cost", "path")
    raise RuntimeError(f"ways still change after {most_rounds} rounds")


def hops(edges: DataFrame, start) -> DataFrame:
    """(id, hops): the least number of edges from ``start``."""
    return shortest(edges.withColumn("weight", F.lit(1.0)), start).select("id", F.col("cost").cast("int").alias("hops"))


def layers(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id, layer): Kahn's topological layers; nodes on or behind a cycle have none."""
    left = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    nodes = materialize(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct(), "nodes")
    left = materialize(left, "left")
    out = None
    for k in range(most_rounds):
        free = materialize(nodes.join(left.select(F.col("dst").alias("id")), "id", "left_anti"), "free")
        if free.isEmpty():
            break
        got = free.withColumn("layer", F.lit(k))
        out = got if out is None else out.unionByName(got)
        nodes = materialize(nodes.join(free, "id", "left_anti"), "nodes")
        left = materialize(left.join(free.withColumnRenamed("id", "src"), "src", "left_anti"), "left")
    return nodes.withColumn("layer", F.lit(0)).where("false") if out is None else out


def has_cycle(edges: DataFrame) -> bool:
    """Whether any directed cycle exists: not every node has a topological layer."""
    n = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().count()
    return layers(edges).count() < n


def cycles(edges: DataFrame, most: int = 3) -> DataFrame:
    """(path): simple cycles of 2 to ``most`` edges, each once, from its least node."""
    e = edges.select("src", "dst").where("src <> dst").distinct().withColumn("weight", F.lit(1.0))
    p = simple_paths(e, F.lit(True), most - 1).where(F.col("path")[0] == F.array_min("path"))
    back = e.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    return p.join(back, (F.element_at("path", -1) == F.col("__s")) & (F.col("path")[0] == F.col("__d"))).select("path")


def longest(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(id, cost): the greatest weight of a way in an acyclic graph that ends at each node; relaxed layer by layer."""
    order = materialize(layers(edges), "layers")
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("w")).join(order.withColumnRenamed("id", "dst"), "dst")
    e = materialize(e.groupBy("src", "dst", "layer").agg(F.max("w").alias("w")), "by_layer")
    cost = materialize(order.where("layer = 0").select("id", F.lit(0.0).alias("cost")), "cost")
    last = order.agg(F.max("layer")).first()[0] or 0
    for k in range(1, last + 1):
        new = e.where(F.col("layer") == k).join(cost.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("cost") + F.col("w")).alias("cost"))
        cost = materialize(cost.unionByName(new), "cost")
    return cost


# ------------------------------------------------------- storage and filtered queries


def nodes_where(nodes: DataFrame, node_type: str | None = None, ids: list | None = None, properties: dict[str, str] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Nodes (id, node_type, properties) that fit all that is given, in the order of their ids where paged."""
    if node_type is not None:
        nodes = nodes.where(F.col("node_type") == node_type)
    if ids is not None:
        nodes = nodes.where(F.col("id").isin(ids) if ids else F.lit(False))
    for k, v in (properties or {}).items():
        nodes = nodes.where(F.try_element_at("properties", F.lit(k)) == v)
    if offset or limit is not None:
        nodes = nodes.orderBy("id").offset(offset)
        nodes = nodes if limit is None else nodes.limit(limit)
    return nodes


def edges_where(edges: DataFrame, kind: str | None = None, least: float | None = None, most: float | None = None) -> DataFrame:
    """Edges of a kind, with inclusive bounds of their weight."""
    for c in (None if kind is None else F.col("kind") == kind, None if least is None else F.col("weight") >= least, None if most is None else F.col("weight") <= most):
        edges = edges if c is None else edges.where(c)
    return edges


def paths_between(edges: DataFrame, nodes: DataFrame, starts: DataFrame, ends: DataFrame, kind: str | None = None, depth: int = 3, limit: int | None = None) -> DataFrame:
    """(path, weight): simple paths of 1 to ``depth`` edges of a kind from one set of ids to another, heaviest first where limited. Only known nodes count."""
    e = edges_where(edges, kind).join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    e = e.select("src", "dst", F.col("weight").cast("double").alias("w"))
    first = e.where("src <> dst").join(starts.select(F.col("id").alias("src")), "src", "left_semi")
    step = first.select(F.array("src", "dst").alias("path"), F.col("w").alias("weight"))
    out = step
    for _ in range(depth - 1):
        nxt = e.select(F.col("src").alias("__s"), "dst", "w")
        step = step.join(nxt, F.element_at("path", -1) == F.col("__s")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), (F.col("weight") + F.col("w")).alias("weight"))
        out = out.unionByName(step)
    out = out.withColumn("__end", F.element_at("path", -1)).join(ends.select(F.col("id").alias("__end")), "__end", "left_semi").drop("__end")
    return out if limit is None else out.orderBy(F.desc("weight"), "path").limit(limit)


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after deleting nodes (by their whole id) with their edges."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def by_shard(nodes: DataFrame, edges: DataFrame, shard) -> DataFrame:
    """(shard, nodes, edges): an edge lies in the shard of its first node; ``shard`` gives the shard of an id column."""
    n = nodes.groupBy(shard(F.col("id")).alias("shard")).agg(F.count("*").alias("nodes"))
    e = edges.groupBy(shard(F.col("src")).alias("shard")).agg(F.count("*").alias("edges"))
    return n.join(e, "shard", "full").select("shard", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def meet(edges: DataFrame, start, end, most_rounds: int = 64) -> DataFrame:
    """(hops, weight) of a way of fewest edges between two nodes, searched from both ends: of those the one of least weight, which needn't be the lightest way of all; no row if there is none.

    Each round goes one step from the end that has seen fewer nodes. Nodes that
    have been seen aren't seen again, so the two frontiers shrink to nothing.
    """
    spark = edges.sparkSession
    fore = materialize(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").cast("double").alias("w")), "edges")  # else each round makes them anew
    sides = [fore, fore.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")]
    one = lambda x: materialize(spark.range(1).select(F.lit(x).alias("id"), F.lit(0).alias("hops"), F.lit(0.0).alias("weight")), "front")
    seen = [one(start), one(end)]
    front, count, depth = list(seen), [1, 1], [0, 0]
    for _ in range(most_rounds):
        both = seen[0].join(seen[1].toDF("id", "h", "w"), "id").select((F.col("hops") + F.col("h")).alias("hops"), (F.col("weight") + F.col("w")).alias("weight"))
        got = both.agg(F.min(F.struct("hops", "weight")).alias("x")).select("x.hops", "x.weight").where("hops IS NOT NULL")
        if (row := got.first()) is not None and row[0] <= sum(depth):
            return got
        k = 0 if count[0] <= count[1] else 1
        step = front[k].join(sides[k], F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min(F.col("weight") + F.col("w")).alias("weight"))
        step = step.join(seen[k].select("id"), "id", "left_anti").select("id", F.lit(depth[k] + 1).alias("hops"), "weight")
        front[k] = materialize(step, "front")
        n = front[k].count()
        if not n:
            return got
        depth[k] += 1
        count[k] += n
        seen[k] = seen[k].unionByName(front[k])
    raise RuntimeError(f"no meeting after {most_rounds} rounds")
