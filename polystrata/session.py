"""Sessions, and making this package importable on executors."""

from __future__ import annotations

import atexit
import functools
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of the session, once, so that Arrow functions can import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="polystrata-zip-")) / "polystrata_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, Path(home.name) / p.relative_to(home))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


def session(name: str = "polystrata", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster its own settings win."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


# --------------------------------------------------------------- shared storage


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="polystrata-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where the session names none, one of our own in local mode, as in tests; on a cluster that is an error, since each machine would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or _own_dir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; its folder is the cluster's to clean
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: lineage ends in files that outlive any executor. The files go when Python exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/polystrata-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files behind a materialized table that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/polystrata-" in f:
            remove(df.sparkSession, f)
