"""Pairs of boxes of one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def iou_pairs(objects: DataFrame, predictions: DataFrame, keys: list[str], max_distance: float = 0.45) -> DataFrame:
    """keys, oid, hid and d = 1 - IoU for pairs within the gate; one shuffle by the frame's keys."""
    left = objects.select(*keys, F.col("traj_id").alias("oid"), *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")))
    right = predictions.select(*keys, F.col("traj_id").alias("hid"), *(F.col(c).alias(f"h_{c}") for c in ("x1", "y1", "x2", "y2")))
    both = left.join(right, keys).withColumn("d", 1 - g.iou(g.box("o_"), g.box("h_")))
    return both.filter(F.col("d") <= max_distance).select(*keys, "oid", "hid", "d")


def grid_iou_pairs(objects: DataFrame, predictions: DataFrame, keys: list[str], width: float, height: float, max_distance: float = 0.45, n: int = 8) -> DataFrame:
    """The same pairs by cells of an n x n grid: for frames with very many boxes.

    Each box goes to the cells it touches; overlapping boxes share one. A pair is taken only in the first cell of its
    intersection, so that none has to be taken out again.
    """
    scale = (width, height, width, height)

    def celled(df: DataFrame, name: str, prefix: str) -> DataFrame:
        unit = tuple(F.col(c) / s for c, s in zip(("x1", "y1", "x2", "y2"), scale, strict=True))
        return df.select(*keys, F.col("traj_id").alias(name), *(F.col(c).alias(f"{prefix}_{c}") for c in ("x1", "y1", "x2", "y2")), F.explode(g.grid_cells(unit, n)).alias("cell"))

    both = celled(objects, "oid", "o").join(celled(predictions, "hid", "h"), [*keys, "cell"])
    o, h = g.box("o_"), g.box("h_")
    first = g.grid_cell(F.greatest(o[1], h[1]) / height, n) * n + g.grid_cell(F.greatest(o[0], h[0]) / width, n)
    return both.withColumn("d", 1 - g.iou(o, h)).filter((F.col("d") <= max_distance) & (F.col("cell") == first)).select(*keys, "oid", "hid", "d")


def suppress_duplicates(trajectories: DataFrame, keys: list[str], least_iou: float) -> DataFrame:
    """trajectories without the Lost ones that overlap a Tracked one by least_iou: pairs are taken one to one, best first where
    they compete (each side's best partner, by IoU and then id; several rounds are folded in one array)."""
    names = ["traj_id", "x1", "y1", "x2", "y2"]
    sides = {p: trajectories.filter(F.col("state") == s).select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in names)) for p, s in (("a", "Tracked"), ("b", "Lost"))}
    pairs = sides["a"].join(sides["b"], keys).withColumn("iou", g.iou(g.box("a_"), g.box("b_"))).filter(F.col("iou") >= least_iou)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("less"), F.col("a_traj_id").alias("a"), F.col("b_traj_id").alias("b"))))
    start = F.struct(F.array().cast("array<bigint>").alias("a"), F.array().cast("array<bigint>").alias("b"))
    free = lambda s, p: ~F.array_contains(s["a"], p["a"]) & ~F.array_contains(s["b"], p["b"])
    fold = F.aggregate(ordered, start, lambda s, p: F.when(free(s, p), F.struct(F.array_append(s["a"], p["a"].cast("bigint")).alias("a"), F.array_append(s["b"], p["b"].cast("bigint")).alias("b"))).otherwise(s), lambda s: s["b"])
    gone = pairs.groupBy(*keys).agg(fold.alias("gone")).select(*keys, F.explode("gone").alias("traj_id"))
    return trajectories.join(gone, [*keys, "traj_id"], "left_anti")
