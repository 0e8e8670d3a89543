"""Reading the tables and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table `name` of `sf_dir`, with only `columns` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's own. Without one, a temporary folder where
    driver and executors are one process (a local master, as in tests), and an error on a cluster."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


_staged: dict[str, list] = {}


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends there, and a lost executor costs
    nothing but its running tasks. The files go when the driver ends, or by `unstage`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _staged:
        atexit.register(_clean)
    out = spark.read.schema(df.schema).parquet(path)
    _staged[path] = [spark]
    out._millrace_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged DataFrame that no later step reads."""
    path = getattr(df, "_millrace_path", None)
    if path and path in _staged:
        _delete(_staged.pop(path)[0], path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        pass


def _clean() -> None:
    for path, (spark,) in list(_staged.items()):
        _delete(spark, path)
    _staged.clear()


def first_delivery(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: chunks and records are sometimes delivered twice with the same content."""
    return df.dropDuplicates(list(keys))

