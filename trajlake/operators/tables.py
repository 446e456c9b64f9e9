"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and all runs in one JVM, as in tests, a new local one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-trajlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the application ends."""
    path = f"{scratch_root(spark)}/trajlake-{name}-{uuid.uuid4().hex}"
    where, files = _file_system(spark, path)
    files.mkdirs(where.getParent())
    files.mkdirs(where)  # only what exists can be marked
    files.deleteOnExit(where)
    files.delete(where, True)
    return path


def kept(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet in the shared folder and read back: its lineage ends there, and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._trajlake_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by kept() once nothing reads them any more."""
    for df in tables:
        where, files = _file_system(df.sparkSession, df._trajlake_path)
        files.delete(where, True)
