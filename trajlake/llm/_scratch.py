"""Reading tables, and Arrow batches for Python workers."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), with what keeps Python workers small: Arrow batches of about 4 MB from now on in this
    session, unless it has its own setting, as whole texts make the default of 64 MB too much; and free memory goes back
    to the system after each task, as workers live on."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == "67108864b":
        conf.set(BATCH_BYTES, "4m")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return df.mapInArrow(task, schema)
