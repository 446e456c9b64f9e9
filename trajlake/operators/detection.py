"""Detection measures: greedy matching and average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import pieces
from .tables import kept
from .timegrid import objects_at


def greedy_matches(objects: DataFrame, detections: DataFrame, keys: list[str], least_iou: float = 0.5) -> DataFrame:
    """detections with tp (0 or 1) and gt_id: by falling confidence, each takes the first free object of its class (by
    confidence, then id) with an IoU over least_iou. The order is a fold over a frame's candidates; no UDF."""
    gt = objects.select(*keys, "class_id", F.col("traj_id").alias("gt_id"), F.col("conf").alias("gt_conf"), *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")))
    both = detections.join(gt, [*keys, "class_id"]).filter(g.iou(g.box("o_"), g.box()) > least_iou)
    rank = F.struct((-F.col("conf")).alias("less"), "det_id", (-F.col("gt_conf")).alias("gt_less"), "gt_id")
    start = F.struct(F.array().cast("array<struct<det_id:bigint,gt_id:bigint>>").alias("pairs"))
    free = lambda s, x: ~F.exists(s["pairs"], lambda p: (p["det_id"] == x["det_id"]) | (p["gt_id"] == x["gt_id"]))
    pair = lambda x: F.struct(x["det_id"].cast("bigint").alias("det_id"), x["gt_id"].cast("bigint").alias("gt_id"))
    fold = F.aggregate(F.array_sort(F.collect_list(rank)), start, lambda s, x: F.when(free(s, x), F.struct(F.array_append(s["pairs"], pair(x)).alias("pairs"))).otherwise(s), lambda s: s["pairs"])
    taken = both.groupBy(*keys).agg(fold.alias("pairs")).select(*keys, F.explode("pairs").alias("p")).select(*keys, "p.det_id", "p.gt_id")
    return detections.join(taken, [*keys, "det_id"], "left").withColumn("tp", F.col("gt_id").isNotNull().cast("int"))


def precision_recall(matched: DataFrame, n_objects: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """The curve: for each detection, by falling confidence, cumulative hits and false ones, precision and recall.

    Sums run over one list for each `by` (a run and class); equal confidences are ordered by `ties`. The list is dealt into
    ranges of this order (column `piece`), however many detections one class or confidence has.
    """
    order = [F.col("conf").desc(), *ties]
    ranges = kept(pieces.by_range(matched, *by, *order), "curve")
    before = {f"{n}_before": F.sum(n).over(pieces.earlier(by)) for n in ("hits", "false")}
    cut = pieces.carry(ranges, by, {"hits": F.sum("tp"), "false": F.sum(1 - F.col("tp"))}, before)
    here = pieces.up_to_here(by, *order)
    sums = {"tps": F.sum("tp").over(here) + F.coalesce("hits_before", F.lit(0)), "fps": F.sum(1 - F.col("tp")).over(here) + F.coalesce("false_before", F.lit(0))}
    curve = cut.withColumns(sums).drop(*before).join(n_objects, by)
    return curve.withColumns({"precision": F.col("tps") / (F.col("tps") + F.col("fps")), "recall": F.col("tps") / F.col("n_objects")})


def average_precision(curve: DataFrame, by: list[str], ties: list[str], least_objects: int = 5, thresholds: tuple[float, ...] = (0.25, 0.3)) -> DataFrame:
    """ap (the area under the falling envelope), and precision and recall of all detections and of those from each threshold
    on; null for under least_objects objects. `curve` is that of precision_recall."""
    # the greatest precision from here on: a running maximum from the end, as a frame of all that follows takes the square of the rows
    from_end = pieces.up_to_here(by, F.col("conf").asc(), *(F.col(t).desc() for t in ties))
    curve = pieces.carry(curve, by, {"top": F.max("precision")}, {"top_behind": F.max("top").over(pieces.later(by))})
    envelope = F.greatest(F.max("precision").over(from_end), "top_behind")
    gained = F.col("tp") / F.col("n_objects")
    parts = curve.withColumn("part", envelope * gained)
    at = {}
    for t in thresholds:
        name, from_ = f"th{round(t * 100)}", F.col("conf") >= t
        hits = F.sum(F.when(from_, F.col("tp")))
        at |= {f"p_{name}": F.try_divide(hits, F.count_if(from_)), f"r_{name}": hits / F.first("n_objects")}
    out = parts.groupBy(*by).agg(F.sum("part").alias("ap"), (F.sum("tp") / F.count("*")).alias("p"), F.max("recall").alias("r"), F.first("n_objects").alias("n_objects"), *(c.alias(n) for n, c in at.items()))
    enough = F.col("n_objects") >= least_objects
    return out.select(*by, "n_objects", *(F.when(enough, F.col(c)).alias(c) for c in ["ap", "p", "r", *at]))


def confidence_axis(matched: DataFrame, n_objects: DataFrame, by: list[str], points: int = 1000) -> DataFrame:
    """The curve on an even axis of confidences: by, k, least_conf (k / (points - 1)), and precision and recall of the detections that
    have so much or more; 1 and 0 where there are none. Each `by` of n_objects has all points.

    A detection counts for all points up to its confidence, so counts by its last point and their sums from the end are
    enough: no list of detections is sorted, and no window is longer than the axis.
    """
    last = F.greatest(F.lit(0), F.least(F.lit(points - 1), F.floor(F.col("conf") * (points - 1)))).cast("int")
    counted = matched.groupBy(*by, last.alias("k")).agg(F.sum("tp").alias("hits"), F.count("*").alias("n"))
    axis = n_objects.select(*by, "n_objects", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).join(counted, [*by, "k"], "left")
    from_here = Window.partitionBy(*by).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = axis.withColumns({c: F.coalesce(F.sum(c).over(from_here), F.lit(0)) for c in ("hits", "n")})
    precision, recall = F.coalesce(F.try_divide("hits", "n"), F.lit(1.0)), F.coalesce(F.try_divide("hits", "n_objects"), F.lit(0.0))
    return summed.select(*by, "k", (F.col("k") / (points - 1)).alias("least_conf"), precision.alias("precision"), recall.alias("recall"))


def match_at_detections(frames: DataFrame, objects: DataFrame, processed: DataFrame, detections: DataFrame, keys: list[str], least_iou: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Detections (keys, t, det_id, class_id, conf, box) with tp and gt_id, and the truth that they were held against: objects
    interpolated to the times (keys, t) of `processed`, the frames that were looked at, with or without detections."""
    truth = kept(objects_at(processed, frames, objects, keys), "truth")
    return greedy_matches(truth, detections, [*keys, "t"], least_iou), truth


def class_measures(matched: DataFrame, truth: DataFrame, by: list[str], classes: list[str], ties: list[str], least_objects: int = 5, least_detections: int = 6, points: int = 1000, thresholds: tuple[float, ...] = (0.25, 0.3)) -> DataFrame:
    """A row for each `by` (a run) of the truth and each class: class_name, n_objects, ap, p and r of all detections, and p_thXX
    and r_thXX, the axis at int(points * threshold).

    Rates are null for classes with less than least_objects true objects, and for runs with less than least_detections
    detections. Detections of other classes than those named play no part.
    """
    whole = [*by, "class_id"]
    named = lambda df: df.filter(F.col("class_id").between(0, len(classes) - 1))
    matched, truth = kept(named(matched), "matched"), named(truth)
    every = truth.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(len(classes) - 1))).alias("class_id"))
    n = every.join(truth.groupBy(*whole).agg(F.count("*").alias("n_objects")), whole, "left").fillna(0, ["n_objects"])
    enough = n.join(matched.groupBy(*by).agg(F.count("*").alias("run_detections")), by, "left")
    out = average_precision(precision_recall(matched, n, whole, ties), whole, ties, least_objects, ()).drop("n_objects")
    axis = confidence_axis(matched, n, whole, points)
    at = {f"{c}_th{round(t * 100)}": F.max(F.when(F.col("k") == int(points * t), F.col(name))) for t in thresholds for c, name in (("p", "precision"), ("r", "recall"))}
    picked = axis.groupBy(*whole).agg(*(c.alias(k) for k, c in at.items()))
    joined = enough.join(out, whole, "left").join(picked, whole)
    told = (F.col("n_objects") >= least_objects) & (F.col("run_detections") >= least_detections)
    rates = {**{c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("ap", "p", "r")}, **{k: F.col(k) for k in at}}
    return joined.select(*by, F.get(F.array(*map(F.lit, classes)), F.col("class_id")).alias("class_name"), "n_objects", *(F.when(told, c).alias(k) for k, c in rates.items()))
