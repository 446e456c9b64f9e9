"""Time: as-of joins, interpolated lookups, grids and sampling. Keys are the columns that name a sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import lerp
from . import pieces

EPS = 1e-7


def trim(df: DataFrame, start: float, end: float, time: str = "frame_time") -> DataFrame:
    """Rows of the closed range."""
    return df.filter(F.col(time).between(start, end))


def neighbours(frames: DataFrame, keys: list[str]) -> DataFrame:
    """frames with previous_time and next_time; at the ends a frame's own time."""
    own, order = F.col("frame_time"), pieces.inside(keys, "frame_time")
    cut = pieces.carry(
        pieces.by_step(frames, "frame_time", pieces.SECONDS), keys, {"low": F.min(own), "high": F.max(own)},
        {"trajlake_before": F.last("high", True).over(pieces.earlier(keys)), "trajlake_behind": F.last("low", True).over(pieces.later(keys))},
    )
    times = {"previous_time": F.coalesce(F.lag(own).over(order), "trajlake_before", own), "next_time": F.coalesce(F.lead(own).over(order), "trajlake_behind", own)}
    return cut.withColumns(times).drop(pieces.PIECE, "trajlake_before", "trajlake_behind")


def with_time_before(frames: DataFrame, keys: list[str], order: str = "frame_idx") -> DataFrame:
    """frames with `before`, the time of the frame before in the order of frame numbers; null at the first."""
    last = F.max(F.struct(order, "frame_time"))["frame_time"]
    cut = pieces.carry(pieces.by_step(frames, order, pieces.FRAMES), keys, {"high": last}, {"trajlake_before": F.last("high").over(pieces.earlier(keys))})
    return cut.withColumn("before", F.coalesce(F.lag("frame_time").over(pieces.inside(keys, order)), "trajlake_before")).drop(pieces.PIECE, "trajlake_before")


def out_of_order(frames: DataFrame, keys: list[str], order: str = "frame_idx") -> DataFrame:
    """Frames whose time isn't later than that of the frame before."""
    return with_time_before(frames, keys, order).filter("frame_time <= before")


def extent(frames: DataFrame, keys: list[str]) -> DataFrame:
    """first_time, last_time and duration, which is the last time."""
    return frames.groupBy(*keys).agg(F.min("frame_time").alias("first_time"), F.max("frame_time").alias("last_time"), F.max("frame_time").alias("duration"))


def eval_divisor(rate: Column, least_rate: float, start: int = 1) -> Column:
    """The largest divisor of the rate, from `start` on, that keeps it at least_rate or more."""
    return F.greatest(F.lit(start), F.floor(rate / least_rate).cast("int"))


def time_grid(spans: DataFrame, keys: list[str], step: Column, max_duration: float = 1000.0, closed: bool = False) -> DataFrame:
    """A row (keys, k, t) for each step of [first_time, min(last_time, first_time + max_duration)); closed: the end too."""
    end = F.least(F.col("last_time"), F.col("first_time") + max_duration)
    count = (F.col("end") - F.col("first_time")) / F.col("step")
    last = F.floor(count + 1e-9) if closed else F.ceil(count - 1e-9) - 1
    wide = spans.withColumns({"step": step.cast("double"), "end": end}).withColumn("last", last.cast("long")).filter("last >= 0")
    return wide.select(*keys, "first_time", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("k")).select(*keys, "k", (F.col("first_time") + F.col("k") * F.col("step")).alias("t"))


def _around(grid: DataFrame, frames: DataFrame, keys: list[str], usable: Column) -> DataFrame:
    """The grid rows (keys, t), each with the usable frames (frame_idx, frame_time) around it: `back`, the last one up to
    1e-7 after t, and `ahead`, the first one behind that; null where there is none. first_frame and last_frame are the ends
    of the sequence, usable or not.

    Grid and frames are one union, cut into pieces of time. A piece is sorted up and down; a frame that starts at each
    row anew would take the square of the rows.
    """
    stamp = F.struct("frame_idx", "frame_time")
    points = grid.select(*keys, "t", (F.col("t") + EPS).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(frames.select(stamp.alias("s")).schema[0].dataType).alias("frame"), F.lit(False).alias("usable"))
    marks = frames.select(*keys, F.lit(None).cast("double").alias("t"), F.col("frame_time").alias("at"), F.lit(2).alias("side"), stamp.alias("frame"), usable.alias("usable"))
    seen, placed = F.when(F.col("usable"), F.col("frame")), F.when(F.col("usable"), F.struct("at", "frame"))
    parts = {"low": F.min(placed)["frame"], "high": F.max(placed)["frame"], "first": F.min("frame"), "last": F.max("frame")}
    before, behind = pieces.earlier(keys), pieces.later(keys)
    carried = {"frame_before": F.last("high", True).over(before), "frame_behind": F.last("low", True).over(behind)}
    carried |= {"first_frame": F.least(F.min("first").over(before), "first", F.min("first").over(behind)), "last_frame": F.greatest(F.max("last").over(before), "last", F.max("last").over(behind))}
    cut = pieces.carry(pieces.by_step(points.unionByName(marks), "at", pieces.SECONDS), keys, parts, carried)
    up = pieces.up_to_here(keys, "at", "side", "frame")
    down = pieces.up_to_here(keys, *(F.col(c).desc() for c in ("at", "side", "frame")))
    found = {"back": F.coalesce(F.last(seen, True).over(up), "frame_before"), "ahead": F.coalesce(F.last(seen, True).over(down), "frame_behind")}
    return cut.withColumns(found).filter("side = 1").select(*keys, "t", *found, "first_frame", "last_frame")


def asof(grid: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """For each grid time the last frame before t + 1e-7 (else the first): frame_idx and frame_time, by one shuffle of both
    sides."""
    found = _around(grid, frames, keys, F.lit(True)).withColumn("found", F.coalesce("back", "ahead"))
    return found.select(*keys, "t", "found.frame_idx", "found.frame_time")


def nearest(grid: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """For each grid time the nearest frame; of two the earlier."""
    around = _around(grid, frames, keys, F.lit(True))
    closer = F.col("back").isNull() | (F.abs(F.col("ahead.frame_time") - F.col("t")) < F.abs(F.col("back.frame_time") - F.col("t")))
    found = F.when(F.col("ahead").isNotNull() & closer, F.col("ahead")).otherwise(F.col("back"))
    return around.withColumn("found", found).select(*keys, "t", "found.frame_idx", "found.frame_time")


def frame_at(grid: DataFrame, frames: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """columns of the frame that is nearest to each grid time: an image path, or whether it was tracked."""
    return nearest(grid, frames, keys).join(frames.select(*keys, "frame_idx", *columns), [*keys, "frame_idx"])


def bracket(grid: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """The tracked frames around each grid time: left (the last one not after t, else the first frame) and right (the first
    one behind left, else the last frame), with `share`, where t lies between them (0 to 1)."""
    both = _around(grid, frames, keys, F.col("tracked"))
    both = both.withColumns({"left": F.coalesce("back", "first_frame"), "right": F.col("ahead")})
    behind = F.when(F.col("right.frame_idx") > F.col("left.frame_idx"), F.col("right"))
    both = both.withColumn("right", F.coalesce(behind, F.col("last_frame")))
    gap = F.col("right.frame_time") - F.col("left.frame_time") + EPS
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("left.frame_time")) / gap))
    return both.select(*keys, "t", F.col("left.frame_idx").alias("left_idx"), F.col("left.frame_time").alias("left_time"), F.col("right.frame_idx").alias("right_idx"), F.col("right.frame_time").alias("right_time"), share.alias("share"))


def interpolated_parts(left: Column, right: Column, share: Column) -> dict[str, Column]:
    """The parts of an object between two frames, from its structs in both (subbox, subbox_conf, pose_pos, pose_conf, face_pos,
    face_conf, face_jpeg, clip_jpeg, face_embedding, clip_embedding; missing ones null).

    A sub-box goes in a line where both have one, else it is the nearer frame's. Points of equal number go in a line and
    their confidences are multiplied; of unequal number, a pose is the longer one, a face the nearer one that has points.
    Pictures and embeddings come from the nearer frame.
    """
    near_left = share < 0.5
    nearer = lambda n: F.when(near_left, left[n]).otherwise(right[n])
    between = lambda a, b: F.zip_with(a, b, lambda x, y: lerp(x, y, share))
    out, both = {}, left["subbox"].isNotNull() & right["subbox"].isNotNull()
    out["subbox"] = F.when(both, between(left["subbox"], right["subbox"])).otherwise(nearer("subbox"))
    out["subbox_conf"] = F.when(both, lerp(left["subbox_conf"], right["subbox_conf"], share)).otherwise(nearer("subbox_conf"))
    for part in ("pose", "face"):
        n, m = (F.coalesce(F.size(side[f"{part}_pos"]), F.lit(0)) for side in (left, right))
        first = n >= m if part == "pose" else (near_left & (n > 0)) | (m <= 0)
        for name, joined in ((f"{part}_pos", lambda a, b: F.zip_with(a, b, between)), (f"{part}_conf", lambda a, b: F.zip_with(a, b, lambda x, y: x * y))):
            out[name] = F.when((n == m) & (n > 0), joined(left[name], right[name])).when(first, left[name]).otherwise(right[name])
    return out | {n: nearer(n) for n in ("face_jpeg", "clip_jpeg", "face_embedding", "clip_embedding")}


PARTS = ["subbox", "subbox_conf", "pose_pos", "pose_conf", "face_pos", "face_conf", "face_jpeg", "clip_jpeg", "face_embedding", "clip_embedding"]


def objects_at(grid: DataFrame, frames: DataFrame, objects: DataFrame, keys: list[str], least_conf: float = 0.0001, hold: float = 0.1) -> DataFrame:
    """The objects of each grid time: those of the bracketing frames, interpolated where both have the trajectory.

    Near an end (share under 0.01 or over 0.99) the end's objects are taken whole. Between, a trajectory that only one side has
    is taken from the nearer side if that is under `hold` seconds off. Class and id come from the left. Where objects have
    the columns of PARTS, all of them, these are interpolated too (interpolated_parts).
    """
    around = bracket(grid, frames, keys)
    values = ["class_id", "conf", "x1", "y1", "x2", "y2"]
    parts = PARTS if set(PARTS) <= set(objects.columns) else []
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.col(f"{n}_idx").alias("frame_idx")) for n in ("left", "right")))).alias("s")
    usable = objects.filter((F.col("conf") >= least_conf) & F.col("class_id").isNotNull()).select(*keys, "frame_idx", "traj_id", F.struct(*values, *parts).alias("o"))
    at = [*keys, "t", "left_time", "right_time", "share"]
    found = around.select(*at, sides).select(*at, "s.side", "s.frame_idx").join(usable, [*keys, "frame_idx"])
    both = found.groupBy(*at, "traj_id").agg(*(F.max(F.when(F.col("side") == n, F.col("o"))).alias(n) for n in ("left", "right")))
    share, left, right = F.col("share"), F.col("left").isNotNull(), F.col("right").isNotNull()
    near_left = (share <= 0.5) & (F.col("t") - F.col("left_time") < hold)
    near_right = ~near_left & (share >= 0.5) & (F.col("right_time") - F.col("t") < hold)
    source = (
        F.when(share > 0.99, F.when(right, "right")).when(share < 0.01, F.when(left, "left"))
        .when(left & right, "both").when(left & near_left, "left").when(right & near_right, "right")
    )

    def value(name: str) -> Column:
        a, b = F.col(f"left.{name}"), F.col(f"right.{name}")
        middle = a if name == "class_id" else lerp(a, b, share)
        return chosen(middle, name)

    def chosen(middle: Column, name: str) -> Column:
        return F.when(F.col("source") == "both", middle).when(F.col("source") == "left", F.col(f"left.{name}")).otherwise(F.col(f"right.{name}")).alias(name)

    whole = interpolated_parts(F.col("left"), F.col("right"), share) if parts else {}
    return both.withColumn("source", source).filter("source IS NOT NULL").select(*keys, "t", "traj_id", *(value(v) for v in values), *(chosen(c, n) for n, c in whole.items()))


def every_nth(frames: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Frames n, 2n and so on of each sequence."""
    cut = pieces.carry(pieces.by_step(frames, "frame_time", pieces.SECONDS), keys, {"frames": F.count("*")}, {"trajlake_frames": F.sum("frames").over(pieces.earlier(keys))})
    rank = F.row_number().over(pieces.inside(keys, "frame_time")) + F.coalesce("trajlake_frames", F.lit(0))
    return cut.withColumn("trajlake_rank", rank).filter(F.col("trajlake_rank") % n == 0).drop("trajlake_rank", "trajlake_frames", pieces.PIECE)


def _taken(times: np.ndarray, interval: float, last: float) -> list[float]:
    """Of sorted times, each that is `interval` or more after the last one taken."""
    out, at = [], -1
    while (at := max(at + 1, int(np.searchsorted(times - last, interval)))) < len(times):
        last = float(times[at])
        out.append(last)
    return out


def at_interval(frames: DataFrame, keys: list[str], interval: float) -> DataFrame:
    """The first frame of each sequence, and then each that is `interval` or more after the last one taken.

    What a piece of time takes depends on the last frame taken before it, and only by the first frame that it takes itself,
    one of those in its first `interval`. So each piece says for each of these where it would end, one short list for each
    sequence is walked from piece to piece, and all pieces are then read with the end before them.
    """
    width = max(pieces.SECONDS, interval)
    cut = pieces.by_step(frames.select(*keys, F.col("frame_time").cast("double")).filter("frame_time IS NOT NULL"), "frame_time", width)
    kinds = dict(cut.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def ends(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(rows.frame_time.to_numpy())
        end = np.empty(len(times))
        for k in range(len(times) - 1, -1, -1):
            after = max(k + 1, int(np.searchsorted(times - times[k], interval)))
            end[k] = end[after] if after < len(times) else times[k]
        firsts = min(len(times), int(np.searchsorted(times, times[0] + interval, "right")) + 1)
        return pd.DataFrame([[*key, times[:firsts].tolist(), end[:firsts].tolist()]], columns=[*keys, pieces.PIECE, "firsts", "ends"])

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        last, out = -np.inf, []
        for r in rows.sort_values(pieces.PIECE).itertuples():
            out.append([*key, r.trajlake_piece, last])
            k = int(np.searchsorted(np.asarray(r.firsts) - last, interval)) if last > -np.inf else 0
            last = r.ends[k] if k < len(r.firsts) else last
        return pd.DataFrame(out, columns=[*keys, pieces.PIECE, "last"])

    def read(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        taken = _taken(np.sort(rows.frame_time.to_numpy()), interval, rows["last"].iloc[0])
        return pd.DataFrame([[*key[:-1], t] for t in taken], columns=[*keys, "frame_time"])

    lists = cut.groupBy(*keys, pieces.PIECE).applyInPandas(ends, f"{named}, {pieces.PIECE} long, firsts array<double>, ends array<double>")
    before = lists.groupBy(*keys).applyInPandas(walk, f"{named}, {pieces.PIECE} long, last double")
    return cut.join(before, [*keys, pieces.PIECE]).groupBy(*keys, pieces.PIECE).applyInPandas(read, f"{named}, frame_time double")
