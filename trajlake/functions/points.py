"""Key points and their similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The COCO constants of the 17 body points.
SIGMAS = (0.026, 0.025, 0.025, 0.035, 0.035, 0.079, 0.079, 0.072, 0.072, 0.062, 0.062, 0.107, 0.107, 0.087, 0.087, 0.089, 0.089)


def unpack(flat: Column) -> Column:
    """Structs (x, y, conf) from x, y, conf, x, y, conf and so on."""
    n = F.floor(F.size(flat) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(flat, i * 3).alias("x"), F.get(flat, i * 3 + 1).alias("y"), F.get(flat, i * 3 + 2).alias("conf")))).otherwise(F.slice(F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("conf"))), 1, 0))


def unpacked(df: DataFrame, flat: str, index: str) -> DataFrame:
    """df with a row for each point of unpack(), its place (index) and x, y and conf in place of `flat`. The numbers are picked
    from the rows' array as they are, with no array of points between."""
    n, at = F.floor(F.size(flat) / 3).cast("int"), F.col(index) * 3
    rows = df.withColumn(index, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    return rows.withColumns({"x": F.get(flat, at), "y": F.get(flat, at + 1), "conf": F.get(flat, at + 2)}).drop(flat)


def similarity(a: Column, b: Column, area_a: Column, area_b: Column, distance_scale: float = 1.0) -> Column:
    """Object key point similarity of two arrays of 17 points: the mean of exp(-d**2 / (2 s k**2)) over the points that
    both have; null unless more than four."""
    shape = (area_a + area_b) * (0.5 * 0.53 * distance_scale**2)
    scales = F.array(*(F.lit(4 * s * s) for s in SIGMAS))  # k = 2 sigma
    near = F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), scales.alias("k")), lambda z: F.when((z["a"]["conf"] > 0) & (z["b"]["conf"] > 0), F.exp(-(F.pow(z["a"]["x"] - z["b"]["x"], 2) + F.pow(z["a"]["y"] - z["b"]["y"], 2)) / (2 * shape * z["k"] + 1e-7))))
    seen = F.filter(near, lambda v: v.isNotNull())
    total = F.aggregate(seen, F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(a) == 17) & (F.size(b) == 17) & (F.size(seen) > 4), total / (F.size(seen) + 1e-7))


def adjusted_confidence(conf: Column, point_conf: Column, weight: float) -> Column:
    """The confidence raised by weight for the sum of the points' confidences."""
    return conf + weight * F.aggregate(F.coalesce(point_conf, F.array().cast("array<double>")), F.lit(0.0), lambda s, c: s + c)


def clamped(threshold: Column) -> Column:
    """A detector's threshold within what it takes."""
    return F.greatest(F.lit(0.01), F.least(F.lit(0.95), threshold))


def tier(conf: Column, low: float, high: float, initial: float) -> Column:
    """In which pass of the association a detection may first be matched."""
    return F.when(conf > initial, "initial").when(conf > high, "high").when(conf > low, "low").otherwise("none")
