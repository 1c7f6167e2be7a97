"""A virtual filesystem: nodes of absolute paths, with kinds folder, text, json, code and link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(path: Column) -> Column:
    """Absolute, without a slash at the end or doubled."""
    p = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)


def parent(path: Column) -> Column:
    """The folder above; null for the root."""
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path == "/", F.lit(None)).otherwise(F.when(up == "", "/").otherwise(up))


def name(path: Column) -> Column:
    return F.when(path == "/", "/").otherwise(F.substring_index(path, "/", -1))


def with_folders(files: DataFrame) -> DataFrame:
    """(path, kind): the files and every folder above them, each once; a path that is both a file and a folder stays a folder."""
    p = F.col("path")
    parts = F.split(p, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    folders = files.where(p != "/").select(F.explode(ups).alias("path")).withColumn("kind", F.lit("folder"))
    return files.select("path", "kind").unionByName(folders).groupBy("path").agg(F.min(F.when(F.col("kind") == "folder", "0folder").otherwise(F.concat(F.lit("1"), "kind"))).alias("k")).select("path", F.substring("k", 2, 100).alias("kind"))


def listing(nodes: DataFrame) -> DataFrame:
    """Each folder's number of children."""
    return nodes.where("path <> '/'").groupBy(parent(F.col("path")).alias("folder")).agg(F.count("*").alias("children"))


def resolve(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == normal(F.lit(path)))


def word_count(text: Column) -> Column:
    """Whitespace words."""
    return F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))


def line_count(text: Column) -> Column:
    """Lines; a line end at the end of the text begins none."""
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(text, "\\n$", ""), "\\n")))


def function_names(text: Column) -> Column:
    """Names after the word fn."""
    return F.regexp_extract_all(text, F.lit(r"\bfn\s+(\w+)"), F.lit(1))


def removable(nodes: DataFrame, path: str) -> DataFrame:
    """Whether a node may go: it isn't the root and has no child."""
    kids = nodes.where(parent(F.col("path")) == path)
    return kids.agg((F.count("*") == 0).alias("empty")).select((F.col("empty") & F.lit(path != "/")).alias("removable"))


def created(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """(path, error) of folders or files to create: null where one can be, else 'exists', 'no parent' or 'parent is no folder'."""
    have = nodes.select("path", F.col("kind").alias("__kind")).distinct()
    up = have.select(F.col("path").alias("__up"), F.col("__kind").alias("__above"))
    d = new.select(normal(F.col("path")).alias("path")).distinct().withColumn("__up", parent(F.col("path"))).join(have, "path", "left").join(up, "__up", "left")
    return d.select("path", F.when(F.col("__kind").isNotNull(), "exists").when(F.col("__above").isNull(), "no parent").when(F.col("__above") != "folder", "parent is no folder").alias("error"))


def targets(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, target, kind): each link with what it leads to; a null kind where there is nothing."""
    t = nodes.select(F.col("path").alias("target"), "kind")
    return links.select("path", normal(F.col("target")).alias("target")).join(t, "target", "left").select("path", "target", "kind")


def json_nodes(files: DataFrame, content: str) -> DataFrame:
    """(path, fields, valid) of JSON files: their top-level fields, in order; none where it isn't an object."""
    keys = F.array_sort(F.coalesce(F.json_object_keys(F.col(content)), F.array().cast("array<string>")))
    return files.select("path", keys.alias("fields"), F.try_parse_json(content).isNotNull().alias("valid"))


def removed(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``nodes`` without those of ``paths`` that may go: the root and folders with a child stay."""
    busy = nodes.where("path <> '/'").select(parent(F.col("path")).alias("path")).distinct()
    go = paths.select(normal(F.col("path")).alias("path")).distinct().where("path <> '/'").join(busy, "path", "left_anti")
    return nodes.join(go, "path", "left_anti")


def walked(nodes: DataFrame, path: str) -> DataFrame:
    """(path, kind): the node of a path and all folders above it, as a walk from the root meets them; no row where one is missing."""
    parts = [x for x in path.split("/") if x]
    way = ["/", *("/" + "/".join(parts[: i + 1]) for i in range(len(parts)))]
    got = nodes.where(F.col("path").isin(way))
    whole = got.agg(F.countDistinct("path").alias("__n"))
    return got.crossJoin(F.broadcast(whole)).where(F.col("__n") == len(way)).drop("__n")  # one row
