"""Frames, regions and detections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import pieces
from .tables import kept


def remap_classes(df: DataFrame, source: list[str], target: list[str]) -> DataFrame:
    """class_id from an index in source to one in target; rows whose class isn't in target go."""
    table = {k: target.index(c) for k, c in enumerate(source) if c in target}
    if not table:
        return df.limit(0)
    ids = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return df.withColumn("class_id", F.try_element_at(ids, F.col("class_id"))).filter("class_id IS NOT NULL")


def known_classes(predictions: DataFrame, names: list[str], allowed: list[str]) -> DataFrame:
    """Rows whose class, by name, is one of `allowed`."""
    return predictions.filter(F.get(F.array(*map(F.lit, names)), F.col("class_id")).isin(allowed))


def confident(df: DataFrame, least: float = 0.0001) -> DataFrame:
    return df.filter((F.col("conf") >= least) & F.col("class_id").isNotNull())


def top_detections(detections: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k surest detections of each frame."""
    order = Window.partitionBy(*keys).orderBy(F.col("conf").desc(), "det_id")
    return detections.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def region_of(boxes: DataFrame, keys: list[str], ratio: float = 1.0, least_width: float = 0.05) -> DataFrame:
    """The region of each frame: the union of its boxes, least_width wide at least, expanded, within the frame."""
    union = boxes.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    x1, y1, x2, y2 = g.box()
    middle, half = (x1 + x2) / 2, F.greatest(x2 - x1, F.lit(least_width)) / 2
    wide = g.expand((middle - half, y1, middle + half, y2), ratio)
    return union.select(*keys, *(g.clip(v).alias(n) for v, n in zip(wide, ("x1", "y1", "x2", "y2"), strict=True)))


def regions_ahead(predictions: DataFrame, motion: DataFrame, keys: list[str], more: float = 0.0, least: float = 0.05) -> DataFrame:
    """The region to look at in each frame: the union of the frame's motion (keys, box) and of what is predicted there
    (associate.predict), with `more` / 2 of its width and height (`least` at least) added on each side, within the frame.

    A frame has a region where it has motion, a prediction or both; sides without a number (nulls, NaN) play no part.
    """
    names = ("x1", "y1", "x2", "y2")
    sides = F.explode(F.array(*(F.struct(*(F.col(f"{s}_{c}").alias(c) for c in names)) for s in ("flow", "filter")))).alias("b")
    boxes = predictions.select(*keys, sides).select(*keys, "b.*").unionByName(motion.select(*keys, *names))
    known = boxes.select(*keys, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in names))
    x1, y1, x2, y2 = g.box()
    union = known.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    w, h = (F.greatest(F.lit(least), size) * (more / 2) for size in (x2 - x1, y2 - y1))
    wide = (x1 - w, y1 - h, x2 + w, y2 + h)
    return union.select(*keys, *(g.clip(v).alias(n) for v, n in zip(wide, names, strict=True)))


def _through(rows: DataFrame, regions: DataFrame, keys: list[str], change: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """rows with all that lies in the frame changed by its region: box, subbox, pose_pos and face_pos, where there are such."""
    low, high = ({c: F.col(f"trajlake_{c}{k}") for c in "xy"} for k in "12")
    r = regions.select(*keys, *(F.col(f"{c}{k}").alias(f"trajlake_{c}{k}") for c in "xy" for k in "12"))
    joined = rows.join(r, keys, "left")
    one = lambda value, axis: F.coalesce(change(value, low[axis], high[axis]), value)
    new = {c: one(F.col(c), c[0]) for c in ("x1", "y1", "x2", "y2") if c in rows.columns}
    if "subbox" in rows.columns:
        new["subbox"] = F.transform("subbox", lambda v, i: F.when(i % 2 == 0, one(v, "x")).otherwise(one(v, "y")))
    for name in {"pose_pos", "face_pos"} & set(rows.columns):
        new[name] = F.transform(name, lambda p: F.transform(p, lambda v, i: F.when(i % 2 == 0, one(v, "x")).otherwise(one(v, "y"))))
    return joined.withColumns(new).drop(*(c for c in joined.columns if c.startswith("trajlake_")))


def unmap_parts(rows: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes, sub-boxes and points (x, y) relative to their frame's region, in the full frame; without a region they stay."""
    return _through(rows, regions, keys, g.unmap)


def map_parts(rows: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """The other way: from the full frame to the frame's region, for regions with a width and height."""
    return _through(rows, regions, keys, lambda value, low, high: F.try_divide(value - low, high - low))


def unmap_boxes(boxes: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes relative to their frame's region, in the full frame; without a region they stay."""
    r = regions.select(*keys, *(F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")))
    joined = boxes.join(r, keys, "left")
    new = {c: F.coalesce(g.unmap(F.col(c), F.col(f"r_{c[0]}1"), F.col(f"r_{c[0]}2")), F.col(c)) for c in ("x1", "y1", "x2", "y2")}
    return joined.withColumns(new).drop(*(f"r_{c}" for c in new))


def skip_still(frames: DataFrame, motion_area: Column, least: float) -> DataFrame:
    """Frames whose motion covers less than `least` stay, untracked."""
    return frames.withColumn("tracked", F.col("tracked") & (motion_area >= least))


def stats(frames: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """tracked_frames, those skipped and their share, tracked_time, tracked_fps and the mean region area of the others (1
    without a region)."""
    r = regions.select(*keys, "frame_idx", g.area(g.box()).alias("area"))
    joined = frames.join(r, [*keys, "frame_idx"], "left")
    out = joined.groupBy(*keys).agg(F.count("*").alias("tracked_frames"), F.count_if(~F.col("tracked")).alias("tracked_frames_skipped"), F.sum(F.when(F.col("tracked"), F.coalesce("area", F.lit(1.0)))).alias("area"), (F.max("frame_time") - F.min("frame_time")).alias("tracked_time"))
    n, skipped = F.col("tracked_frames"), F.col("tracked_frames_skipped")
    return out.select(*keys, "tracked_frames", "tracked_frames_skipped", (skipped / n).alias("tracked_frames_skipped_frac"), "tracked_time", F.try_divide(n, "tracked_time").alias("tracked_fps"), (F.coalesce("area", F.lit(0.0)) / (n - skipped + 1e-7)).alias("average_detection_roi_area"))


def miss_runs(log: DataFrame, keys: list[str]) -> DataFrame:
    """Object events with `missed_in_row`: misses up to here since the last match."""
    order = Window.partitionBy(*keys, "oid").orderBy("frame_idx")
    hit = (F.col("type") != "MISS").cast("int")
    island = log.filter("oid IS NOT NULL").withColumn("island", F.sum(hit).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "oid", "island").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("missed_in_row", F.sum(1 - hit).over(inside)).drop("island")


def mean_embedding(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The mean vector of each key, by dimension: partial sums before the shuffle, however many rows a key has."""
    parts = rows.select(*keys, F.posexplode(vector).alias("dim", "value"))
    means = parts.groupBy(*keys, "dim").agg(F.avg(F.col("value").cast("double")).alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "value")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda x: x["value"]).alias("mean"))


def running_embedding(rows: DataFrame, keys: list[str], vector: str, order: str, share: float = 0.5) -> DataFrame:
    """`blend`: the running mean of each key's vectors by this order, where each new vector takes `share` of it.

    A vector's weight follows from its place alone, so places are counted in ranges of the order and weighted vectors summed
    by dimension; those far back, whose weight is 0 in a double, add nothing.
    """
    ranges = kept(pieces.by_range(rows.select(*keys, order, vector), *keys, order), "blend")
    sums = {"n_before": F.sum("n").over(pieces.earlier(keys)), "n_behind": F.sum("n").over(pieces.later(keys)), "n_here": F.col("n")}
    cut = pieces.carry(ranges, keys, {"n": F.count("*")}, sums)
    place = F.row_number().over(pieces.inside(keys, order)) + F.coalesce("n_before", F.lit(0))
    total = F.coalesce("n_before", F.lit(0)) + F.col("n_here") + F.coalesce("n_behind", F.lit(0))
    first = F.when(F.col("place") == 1, 1.0).otherwise(share)
    weighted = cut.withColumns({"place": place, "total": total}).withColumn("weight", first * F.pow(F.lit(1.0 - share), F.col("total") - F.col("place"))).filter("weight > 0")
    parts = weighted.select(*keys, "weight", F.posexplode(vector).alias("dim", "value"))
    means = parts.groupBy(*keys, "dim").agg(F.sum(F.col("value").cast("double") * F.col("weight")).alias("value"))
    listed = F.array_sort(F.collect_list(F.struct("dim", "value")))
    return means.groupBy(*keys).agg(F.transform(listed, lambda x: x["value"]).alias("blend"))


def with_previous(rows: DataFrame, keys: list[str], column: str, order: str, name: str = "previous") -> DataFrame:
    """rows with the column of the row before in its key, null at the first; one row a range is handed on to the next."""
    ranges = kept(pieces.by_range(rows, *keys, order), "previous")
    last = F.max(F.struct(order, column))[column]
    cut = pieces.carry(ranges, keys, {"end": last}, {"trajlake_end": F.last("end").over(pieces.earlier(keys))})
    before = F.when(F.row_number().over(pieces.inside(keys, order)) == 1, F.col("trajlake_end")).otherwise(F.lag(column).over(pieces.inside(keys, order)))
    return cut.withColumn(name, before).drop("trajlake_end", pieces.PIECE)
