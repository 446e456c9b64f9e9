"""Boxes as four columns (x1, y1, x2, y2), all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((width > 0) & (height > 0), width * height).otherwise(width * 0)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where both are empty."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def union(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def expand(b: Box, ratio: float) -> Box:
    """The box with its sides `ratio` times as long around the same centre."""
    w, h = (b[2] - b[0]) * ((ratio - 1) / 2), (b[3] - b[1]) * ((ratio - 1) / 2)
    return b[0] - w, b[1] - h, b[2] + w, b[3] + h


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def pixels(b: Box, width: Column, height: Column) -> Box:
    """Left, top, width and height in whole pixels, cut off towards 0."""
    parts = (b[0] * width, b[1] * height, (b[2] - b[0]) * width, (b[3] - b[1]) * height)
    return tuple(p.cast("int") for p in parts)


def centre_form(b: Box) -> Box:
    """Centre, ratio of width to height, height."""
    height = b[3] - b[1]
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) / height, height


def corner_form(c: Box) -> Box:
    half = c[2] * c[3] / 2
    return c[0] - half, c[1] - c[3] / 2, c[0] + half, c[1] + c[3] / 2


def grid_cell(value: Column, n: int = 8) -> Column:
    """The cell of a normalised coordinate in a grid of n; outside points belong to the border cells."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(value * n).cast("int")))


def grid_cells(b: Box, n: int = 8) -> Column:
    """All cells (row * n + column) that the box touches."""
    columns = F.sequence(grid_cell(b[0], n), grid_cell(b[2], n))
    rows = F.sequence(grid_cell(b[1], n), grid_cell(b[3], n))
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: y * n + x)))


def grow(b: Box, points: Column, least_conf: float = 0.05) -> Box:
    """The box over itself and all points (structs x, y, conf) with a confidence over least_conf."""
    sure = F.filter(points, lambda p: p["conf"] > least_conf)
    xs, ys = F.transform(sure, lambda p: p["x"]), F.transform(sure, lambda p: p["y"])
    return F.least(b[0], F.array_min(xs)), F.least(b[1], F.array_min(ys)), F.greatest(b[2], F.array_max(xs)), F.greatest(b[3], F.array_max(ys))


def unmap(value: Column, low: Column, high: Column) -> Column:
    """A coordinate relative to a region, in the full frame."""
    return low + value * (high - low)


def detection(b: Box, class_id: Column, conf: Column, traj_id: Column) -> Column:
    """An object as a detection: box, class, confidence and id. An id that isn't a whole number fails."""
    whole = F.when(traj_id == F.floor(traj_id), traj_id.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no whole id: "), traj_id.cast("string"))).cast("long"))
    return F.struct(F.array(*b).alias("box"), class_id.alias("class_id"), conf.alias("conf"), F.when(traj_id.isNotNull(), whole).alias("traj_id"))


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share
