"""Motion: displacement fields and constant-velocity filters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .tables import kept

#: Sample points of a box (share of x1, share of y1, weight).
SAMPLES = ((0.5, 0.5, 0.5), (0.35, 0.5, 0.125), (0.65, 0.5, 0.125), (0.5, 0.35, 0.125), (0.5, 0.65, 0.125))
#: Noise weights of the filter, and its time scale.
POSITION, VELOCITY, RATIO, RATIO_VELOCITY, RATIO_NOISE, TIME_SCALE = 1 / 20, 1 / 160, 1e-2, 1e-5, 1e-1, 7.5


#: Sizes of fields, and cells of them that boxes look into, that are listed at most to leave out the others.
MOST_SIZES, MOST_CELLS = 16, 1 << 16


def shift_boxes(boxes: DataFrame, field: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Boxes moved against the frame's displacement field (keys, gw, gh, gx, gy, dx, dy): the weighted mean over five sample
    points, each looked up in its cell; a frame without a field moves nothing.

    Cells that no box of the table looks into are left out first, as far as their list is short. Boxes meet the others of
    their frame, dealt out by the frame alone, and no row is made for a point.
    """
    x1, y1, x2, y2 = g.box()

    def cell(value: Column, n: Column) -> Column:
        return F.greatest(F.lit(0), F.least(n - 1, F.floor(value * n + 0.5).cast("int")))

    points = [(cell(x1 * x + x2 * (1 - x), F.col("gw")), cell(y1 * y + y2 * (1 - y), F.col("gh")), w) for x, y, w in SAMPLES]
    sizes = kept(field.select("gw", "gh").distinct(), "sizes")
    if sizes.count() <= MOST_SIZES:
        each = F.explode(F.array(*(F.struct(gx.alias("gx"), gy.alias("gy")) for gx, gy, _ in points))).alias("at")
        cells = kept(boxes.crossJoin(F.broadcast(sizes)).select("gw", "gh", each).select("gw", "gh", "at.gx", "at.gy").distinct(), "cells")
        if cells.count() <= MOST_CELLS:
            field = field.join(F.broadcast(cells), ["gw", "gh", "gx", "gy"], "left_semi")
    looked = boxes.select(*keys, *ids, "x1", "y1", "x2", "y2").join(field.select(*keys, "gw", "gh", "gx", "gy", "dx", "dy"), keys, "left")
    weight = reduce(add, (F.when((F.col("gx") == gx) & (F.col("gy") == gy), w).otherwise(0.0) for gx, gy, w in points))
    moves = looked.select(*keys, *ids, weight.alias("w"), "dx", "dy")
    move = moves.groupBy(*keys, *ids).agg(*(F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("w") * F.col(d))), F.lit(0.0)).alias(d) for d in ("dx", "dy")))
    moved = boxes.join(move, [*keys, *ids]).withColumns({c: g.clip(F.col(c) - F.col(f"d{c[0]}")) for c in ("x1", "y1", "x2", "y2")})
    return moved.drop("dx", "dy")


class BoxFilter:
    """A constant-velocity filter of centre, ratio and height, the four coordinates at once.

    The filter's eight-dimensional matrices couple only a coordinate and its own speed, so it is four filters of two
    numbers, tied by the height in the noise: of the motion by the height before, of the measurement by the height after.
    Centre and height have the same noise, so that they share their covariance (c: place, place and speed, speed; then
    the ratio's). Plain numbers: arrays of four take several times as long.
    """

    __slots__ = ("time", "p", "v", "c")

    def __init__(self, z: Sequence[float], time: float):
        x, y, a, h = map(float, z)
        self.time, self.p, self.v = time, (x, y, a, h), (0.0, 0.0, 0.0, 0.0)
        place, speed = 2 * POSITION * h, 10 * VELOCITY * h
        self.c = (place * place, 0.0, speed * speed, RATIO * RATIO, 0.0, RATIO_VELOCITY * RATIO_VELOCITY)

    def predicted(self, time: float) -> tuple[float, float, float, float]:
        """The box at a time, without a change of the filter."""
        dt = (time - self.time) * TIME_SCALE
        (x, y, a, h), (vx, vy, va, vh) = self.p, self.v
        x, y, a, h = x + dt * vx, y + dt * vy, a + dt * va, h + dt * vh
        return x - a * h / 2, y - h / 2, x + a * h / 2, y + h / 2

    def update(self, z: Sequence[float], time: float) -> None:
        """Predict up to a time and correct by what was measured."""
        dt, (x, y, a, h), (vx, vy, va, vh), (c00, c01, c11, r00, r01, r11) = (time - self.time) * TIME_SCALE, self.p, self.v, self.c
        place, speed = POSITION * abs(h), VELOCITY * abs(h)
        x, y, a, h = x + dt * vx, y + dt * vy, a + dt * va, h + dt * vh
        c00, r00 = c00 + 2 * dt * c01 + dt * dt * c11 + place * place, r00 + 2 * dt * r01 + dt * dt * r11 + RATIO * RATIO
        c01, c11, r01, r11 = c01 + dt * c11, c11 + speed * speed, r01 + dt * r11, r11 + RATIO_VELOCITY * RATIO_VELOCITY
        place = POSITION * abs(h)
        total, ratio = c00 + place * place, r00 + RATIO_NOISE * RATIO_NOISE
        k0, k1 = (c00 / total, c01 / total) if total else (math.nan, math.nan)  # boxes without height
        q0, q1 = r00 / ratio, r01 / ratio
        zx, zy, za, zh = z
        dx, dy, da, dh = zx - x, zy - y, za - a, zh - h
        self.time, self.p, self.v = time, (x + k0 * dx, y + k0 * dy, a + q0 * da, h + k0 * dh), (vx + k1 * dx, vy + k1 * dy, va + q1 * da, vh + k1 * dh)
        self.c = (c00 - k0 * k0 * total, c01 - k0 * k1 * total, c11 - k1 * k1 * total, r00 - q0 * q0 * ratio, r01 - q0 * q1 * ratio, r11 - q1 * q1 * ratio)


def kalman_smooth(objects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frame_time and the filtered centre, ratio and height (cx, cy, a, h) of each trajectory, whose key is in `keys`:
    a fold over its boxes in order of time, each trajectory a group of its own (five numbers a frame)."""
    names = ["cx", "cy", "a", "h"]
    measured = objects.select(*keys, "frame_time", *(c.alias(n) for c, n in zip(g.centre_form(g.box()), names, strict=True)))

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_time", *names], ignore_index=True)
        z, times = rows[names].to_numpy(float).tolist(), rows.frame_time.tolist()
        state = BoxFilter(z[0], times[0])
        out = np.empty((len(z), 4))
        out[0] = z[0]
        for k in range(1, len(z)):
            state.update(z[k], times[k])
            out[k] = state.p
        rows[names] = out
        return rows

    return measured.groupBy(*keys).applyInPandas(fold, measured.schema)
