"""Appending frames to a table that takes only later ones: accepted and rejected rows apart, batch by batch.

A frame is accepted if its time is later than that of every frame before it in its sequence: in earlier batches, and in its own
batch in the order of frame numbers. Each batch writes its own folders, the last time of each sequence among them, and reads
those of the batch before; a batch that is given again overwrites what it wrote, so that it adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import pieces
from ..operators.tables import _file_system, drop, kept

KEPT_BATCHES = 2


def with_accepted(rows: DataFrame, last: DataFrame | None, keys: list[str], order: str = "frame_idx", time: str = "frame_time") -> DataFrame:
    """rows with `accepted`: whether each is later than all rows before it (by order, then time) and than last_time in `last`
    (keys, last_time). A row without a time is rejected; equal rows are accepted once at most."""
    cut = pieces.carry(pieces.by_step(rows, order, pieces.FRAMES), keys, {"trajlake_high": F.max(time)}, {"trajlake_before": F.max("trajlake_high").over(pieces.earlier(keys))})
    here = Window.partitionBy(*keys, pieces.PIECE).orderBy(order, time).rowsBetween(Window.unboundedPreceding, -1)
    latest = [F.max(time).over(here), F.col("trajlake_before")]
    if last is not None:
        cut = _joined(cut, last.withColumnRenamed("last_time", "trajlake_last"), keys)
        latest.append(F.col("trajlake_last"))
    later = F.col(time).isNotNull() & F.coalesce(F.col(time) > F.greatest(*latest), F.lit(True))
    return cut.withColumn("accepted", later).drop(pieces.PIECE, "trajlake_before", "trajlake_last")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    names = {k: f"trajlake_key_{i}" for i, k in enumerate(keys)}
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return left.join(right.withColumnsRenamed(names), same, "left").drop(*names.values())


def _batches(spark: SparkSession, folder: str) -> list[int]:
    where, files = _file_system(spark, folder)
    return sorted(int(f.getPath().getName().removeprefix("batch=")) for f in files.listStatus(where)) if files.exists(where) else []


def append_batch(rows: DataFrame, batch: int, path: str, keys: list[str], order: str = "frame_idx", callback: Callable[[int, DataFrame, DataFrame], None] | None = None) -> None:
    """Write one batch under `path`: accepted/batch=N, rejected/batch=N and last/batch=N. callback gets the number and both tables
    once they are written."""
    spark = rows.sparkSession
    before = [b for b in _batches(spark, f"{path}/last") if b < batch]
    last = spark.read.parquet(f"{path}/last/batch={before[-1]}") if before else None
    told = kept(with_accepted(rows, last, keys, order), "batch")
    for name, some in (("accepted", told.filter("accepted")), ("rejected", told.filter("NOT accepted"))):
        some.drop("accepted").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    times = told.filter("accepted").select(*keys, F.col("frame_time").alias("last_time"))
    times = times if last is None else times.unionByName(last)
    times.groupBy(*keys).agg(F.max("last_time").alias("last_time")).write.mode("overwrite").parquet(f"{path}/last/batch={batch}")
    for old in before[: -KEPT_BATCHES + 1]:
        where, files = _file_system(spark, f"{path}/last/batch={old}")
        files.delete(where, True)
    drop(told)
    if callback:
        callback(batch, *(spark.read.parquet(f"{path}/{name}/batch={batch}") for name in ("accepted", "rejected")))


def append_frames(frames: DataFrame, path: str, checkpoint: str, keys: list[str], order: str = "frame_idx", callback: Callable[[int, DataFrame, DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """A stream of frames into the table at `path`; started with the given trigger (availableNow=True and so on)."""
    writer = frames.writeStream.foreachBatch(lambda rows, batch: append_batch(rows, batch, path, keys, order, callback))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def appended(spark: SparkSession, path: str, name: str = "accepted") -> DataFrame:
    """All rows accepted (or rejected) so far, with their batch."""
    return spark.read.parquet(f"{path}/{name}")
