"""Sources and sinks: tables, texts, folders, and exports."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file): the lines of text files."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content): files as they are."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of all files under a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def export(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Writes parquet, json, csv, orc or text, replacing what is there; partitions given by ``by``."""
    w = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        w = w.option("header", "true")
    (w.partitionBy(*by) if by else w).save(path)


def load(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    r = spark.read.format(kind)
    if kind == "csv":
        r = r.option("header", "true")
    return (r.schema(schema) if schema else r).load(path)


def report(df: DataFrame) -> DataFrame:
    """Each row as pretty JSON."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("report"))


def memory(spark: SparkSession, lines_: list[str]) -> DataFrame:
    """(line, file): lines held by the driver."""
    return spark.createDataFrame([(x, "memory") for x in lines_], "line string, file string")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> int:
    """Writes a text as one file, replacing what is there; gives its bytes."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    raw = text.encode()
    out.write(bytearray(raw))
    out.close()
    return len(raw)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def copy(spark: SparkSession, source: str, target: str, move: bool = False) -> bool:
    """Copies or moves a file or folder."""
    (a, fa), (b, fb) = _path(spark, source), _path(spark, target)
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, move, True, spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder; false if there is none."""
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def snippet(spark: SparkSession, text: str | None = None, file: str | None = None, url: str | None = None) -> str | None:
    """The first source that is given: a text, a file, a URL."""
    if text is not None:
        return text
    if file is not None:
        return bytes(whole(spark, file).first()["content"]).decode()
    return None if url is None else fetch(url)[0]


def fetch(url: str, tries: int = 4, first_wait: float = 0.1, timeout: float = 10.0) -> tuple[str | None, int, str | None]:
    """(text, tries made, error): a URL's text; after a failure the wait before the next try doubles. A refusal (4xx) isn't tried again."""
    error = None
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.read().decode("utf-8", "replace"), k + 1, None
        except urllib.error.HTTPError as e:
            error = f"status {e.code}"
            if e.code < 500:
                return None, k + 1, error
        except OSError as e:
            error = type(e).__name__
        if k + 1 < tries:
            time.sleep(first_wait * 2**k)
    return None, tries, error


def fetched(urls: DataFrame, column: str = "url", tries: int = 4, first_wait: float = 0.1) -> DataFrame:
    """(url, text, tries, error) of every URL, fetched by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            got = [(None, 0, "no url") if u is None else fetch(u, tries, first_wait) for u in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())], ["url", "text", "tries", "error"])

    return urls.select(F.col(column).cast("string").alias("url")).mapInArrow(run, "url string, text string, tries int, error string")
