"""CLEAR-MOT events and measures.

A frame's pairs inside the gate are matched one to one: pairs of the last match first, the rest by most pairs and least
distance. Where no object and no prediction of a component has two pairs in one frame, that needs no sequential code: a
window gives each object's last partner. Only the other components go through a fold in pandas, each a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assignment import assign, assign_lists
from .components import pair_components
from .folds import fold
from .pairs import iou_pairs
from .tables import drop, kept
from .timegrid import nearest


#: Rows that are Python objects at one time.
ROWS_AT_ONCE = 1 << 16


def fold_matches(group: pd.DataFrame, last: dict[int, int] | None = None) -> pd.DataFrame:
    """Events (frame_idx, type, oid, hid, d) of one component's pairs, frame by frame. `last` holds each object's last
    partner, and is carried on."""
    last, out = {} if last is None else last, []
    frames, oids, hids, ds = (group[c].to_numpy() for c in ("frame_idx", "oid", "hid", "d"))
    order = np.lexsort((hids, oids, frames))
    frames, oids, hids, ds = frames[order], oids[order], hids[order], ds[order].astype(float)
    starts = np.flatnonzero(np.append(True, frames[1:] != frames[:-1])) if len(order) else np.zeros(0, int)
    at = 0
    while at < len(order):
        upto = np.searchsorted(starts, at + ROWS_AT_ONCE)
        to = int(starts[upto]) if upto < len(starts) else len(order)
        part = frames[at:to], oids[at:to], hids[at:to], ds[at:to]
        out.append(_clear(*part, last) if _all_clear(*part[:3]) else _by_frame(*part, last))
        at = to
    return pd.concat(out) if out else pd.DataFrame({"frame_idx": frames, "type": np.zeros(0, object), "oid": oids, "hid": hids, "d": ds})


def _all_clear(frames: np.ndarray, oids: np.ndarray, hids: np.ndarray) -> bool:
    """Whether no object and no prediction has two pairs in a frame; rows are in order of frame and object."""
    if oids.dtype.kind != "i" or hids.dtype.kind != "i" or ((frames[1:] == frames[:-1]) & (oids[1:] == oids[:-1])).any():
        return False
    order = np.lexsort((hids, frames))
    return not ((np.diff(frames[order]) == 0) & (np.diff(hids[order]) == 0)).any()


def _clear(frames: np.ndarray, oids: np.ndarray, hids: np.ndarray, ds: np.ndarray, last: dict[int, int]) -> pd.DataFrame:
    """Events of pairs of which all are matched."""
    order = np.lexsort((frames, oids))
    o, h = oids[order], hids[order]
    first = np.append(True, o[1:] != o[:-1])
    before = np.append(0, h[:-1])
    before[first] = [last.get(x, y) for x, y in zip(o[first].tolist(), h[first].tolist(), strict=True)]
    ends = np.append(o[1:] != o[:-1], True)
    last.update(zip(o[ends].tolist(), h[ends].tolist(), strict=True))
    switch = np.empty(len(order), bool)
    switch[order] = h != before
    return pd.DataFrame({"frame_idx": frames, "type": np.where(switch, "SWITCH", "MATCH").astype(object), "oid": oids, "hid": hids, "d": ds})


def _by_frame(frames: np.ndarray, oids: np.ndarray, hids: np.ndarray, ds: np.ndarray, last: dict[int, int]) -> pd.DataFrame:
    starts = np.flatnonzero(np.append(True, frames[1:] != frames[:-1])).tolist()
    number, o_all, h_all, d_all, out = frames.tolist(), oids.tolist(), hids.tolist(), ds.tolist(), []
    for low, high in zip(starts, [*starts[1:], len(number)], strict=True):
        pairs = list(zip(o_all[low:high], h_all[low:high], strict=True))
        near = dict(zip(pairs, d_all[low:high], strict=True))
        left, right = {o for o, _ in pairs}, {h for _, h in pairs}
        if len(left) == len(right) == len(pairs):  # nothing to choose
            found = dict(pairs)
        else:
            found, used = {}, set()
            for o in sorted(left):
                h = last.get(o)
                if (o, h) in near and h not in used:
                    found[o] = h
                    used.add(h)
            rows, columns = sorted(left - found.keys()), sorted(right - used)
            cost = [[near.get((o, h), math.inf) for h in columns] for o in rows]
            found |= {rows[r]: columns[c] for r, c in (assign_lists(cost) if len(rows) * len(columns) <= 256 else assign(np.array(cost).reshape(len(rows), len(columns))))}
        for o, h in sorted(found.items()):
            out.append((number[low], "SWITCH" if last.get(o, h) != h else "MATCH", o, h, near[o, h]))
            last[o] = h
    columns = zip(*out, strict=True) if out else [()] * 5
    return pd.DataFrame({n: np.array(c, k) for (n, k), c in zip((("frame_idx", frames.dtype), ("type", object), ("oid", oids.dtype), ("hid", hids.dtype), ("d", float)), columns, strict=True)})


def matches(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """MATCH and SWITCH events of gated pairs (keys, frame_idx, oid, hid, d)."""
    frame, columns = [*keys, "frame_idx"], [*keys, "frame_idx", "type", "oid", "hid", "d"]
    before = F.lag("hid").over(Window.partitionBy(*keys, "oid").orderBy("frame_idx"))
    kind = F.when(before != F.col("hid"), "SWITCH").otherwise("MATCH")
    counted = [pairs.groupBy(*frame, side).agg(F.count("*").alias("n"), F.min("oid").alias("one")).filter("n > 1").select(*keys, F.col("one").alias("oid")) for side in ("oid", "hid")]
    double = kept(counted[0].unionByName(counted[1]).distinct(), "double")
    if double.isEmpty():  # nothing to choose in any frame
        return pairs.withColumn("type", kind).select(*columns)
    labels = kept(pair_components(pairs, keys), "components")
    unclear = labels.join(double, [*keys, "oid"]).select(*keys, "component").distinct()
    labelled = pairs.join(labels, [*keys, "oid", "hid"])
    clear = labelled.join(unclear, [*keys, "component"], "left_anti").withColumn("type", kind)

    def start(_: tuple) -> Callable[[pd.DataFrame], pd.DataFrame]:
        last = {}
        return lambda rows: fold_matches(rows, last)

    folded = fold(labelled.join(unclear, [*keys, "component"], "left_semi"), [*keys, "component"], ["frame_idx"], ["frame_idx", "oid", "hid", "d"], start, "frame_idx long, type string, oid long, hid long, d double")
    return clear.select(*columns).unionByName(folded.select(*columns))


def events(objects: DataFrame, predictions: DataFrame, keys: list[str], max_distance: float = 0.45, pairs: DataFrame | None = None) -> DataFrame:
    """keys, frame_idx, type (MATCH, SWITCH, MISS or FP), oid, hid and d of every object and prediction. pairs: those of
    iou_pairs(), where they are there already."""
    frame = [*keys, "frame_idx"]
    if pairs is None:
        pairs = kept(iou_pairs(objects, predictions, frame, max_distance), "pairs")
    return _with_others(objects, predictions, kept(matches(pairs, keys), "matches"), keys)  # which is read three times


def kept_events(objects: DataFrame, predictions: DataFrame, keys: list[str], max_distance: float = 0.45) -> DataFrame:
    """events() written as a table, for several readers; what it is made from is deleted."""
    pairs = kept(iou_pairs(objects, predictions, [*keys, "frame_idx"], max_distance), "pairs")
    found = kept(matches(pairs, keys), "matches")
    drop(pairs)
    log = kept(_with_others(objects, predictions, found, keys), "log")
    drop(found)
    return log


def _with_others(objects: DataFrame, predictions: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """found, and MISS and FP of the objects and predictions without a match."""
    frame = [*keys, "frame_idx"]
    nothing = F.lit(None).cast("long")
    missed = objects.select(*frame, F.col("traj_id").alias("oid")).join(found, [*frame, "oid"], "left_anti").select(*frame, F.lit("MISS").alias("type"), "oid", nothing.alias("hid"), F.lit(None).cast("double").alias("d"))
    false = predictions.select(*frame, F.col("traj_id").alias("hid")).join(found, [*frame, "hid"], "left_anti").select(*frame, F.lit("FP").alias("type"), nothing.alias("oid"), "hid", F.lit(None).cast("double").alias("d"))
    return found.unionByName(missed).unionByName(false)


def frame_scores(log: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each event by frame, and the frame's MOTA; without objects the divisor is 1e-7, and mota_or_null is null."""
    kinds = {"MATCH": "num_match", "MISS": "num_miss", "FP": "num_fp", "SWITCH": "num_switch"}
    counted = log.groupBy(*keys, "frame_idx").agg(*(F.count_if(F.col("type") == k).alias(v) for k, v in kinds.items()), F.count("oid").alias("num_gt"))
    wrong = F.col("num_miss") + F.col("num_fp") + F.col("num_switch")
    divisor = F.when(F.col("num_gt") > 0, F.col("num_gt").cast("double")).otherwise(F.lit(1e-7))
    return counted.withColumns({"mota": 1 - wrong / divisor, "mota_or_null": F.when(F.col("num_gt") > 0, 1 - wrong / divisor)})


def coverage(log: DataFrame, keys: list[str]) -> DataFrame:
    """By object: frames, frames tracked, the share, and its class (mostly_tracked from 0.8, partially from 0.2)."""
    seen = F.count_if(F.col("type") != "MISS")
    out = log.filter("oid IS NOT NULL").groupBy(*keys, "oid").agg(F.count("*").alias("frames"), seen.alias("tracked"), F.count_if(F.col("type") == "MATCH").alias("matched"))
    share = F.col("tracked") / F.col("frames")
    return out.withColumns({"share": share, "coverage": F.when(share >= 0.8, "mostly_tracked").when(share >= 0.2, "partially_tracked").otherwise("mostly_lost")})


def fragmentations(log: DataFrame, keys: list[str]) -> DataFrame:
    """By object: how often its tracking stops and starts again."""
    order = Window.partitionBy(*keys, "oid").orderBy("frame_idx")
    tracked = F.col("type") != "MISS"
    seen = log.filter("oid IS NOT NULL").select(*keys, "oid", "frame_idx", tracked.alias("tracked")).withColumns({"before": F.lag("tracked").over(order), "earlier": F.max("tracked").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    return seen.groupBy(*keys, "oid").agg(F.count_if(F.col("tracked") & ~F.col("before") & F.col("earlier")).alias("fragmentations"))


def never_matched(log: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Ids of `side` ("hid": false-positive trajectories, "oid": missed objects) that have no MATCH; a SWITCH isn't one."""
    return log.filter(F.col(side).isNotNull()).groupBy(*keys, side).agg(F.count_if(F.col("type") == "MATCH").alias("n")).filter("n = 0").select(*keys, side)


def fitness(mota, fp_tracks, fp_per_frame):
    return mota - 0.0005 * fp_tracks - 0.002 * fp_per_frame


def ratios(df: DataFrame) -> DataFrame:
    """The measures that are divided by numbers of objects or frames, and the fitness."""
    eps = 1e-7
    unique, col = F.col("num_unique_objects") + eps, F.col
    df = df.withColumns({f"{m}_frac": col(m) / unique for m in ("mostly_tracked", "partially_tracked", "mostly_lost2", "missed", "fp_tracks")})
    df = df.withColumns({
        "fp_per_frame": col("num_false_positives") / (col("num_frames") + eps), "fn_per_obj": col("num_misses") / (col("num_objects") + eps),
        "switch_per_obj": col("num_switches") / unique, "frag_per_obj": col("num_fragmentations") / unique,
    })
    return df.withColumn("fitness", fitness(col("mota"), col("fp_tracks"), col("fp_per_frame")))


def measures(log: DataFrame, keys: list[str], identities: DataFrame | None = None) -> DataFrame:
    """A row for each sequence with all counts, rates and ratios. Frames without events aren't counted."""
    kinds = {"MATCH": "num_matches", "SWITCH": "num_switches", "FP": "num_false_positives", "MISS": "num_misses"}
    base = log.groupBy(*keys).agg(F.countDistinct("frame_idx").alias("num_frames"), F.count("oid").alias("num_objects"), F.count("hid").alias("num_predictions"), *(F.count_if(F.col("type") == k).alias(v) for k, v in kinds.items()), F.avg("d").alias("motp"))
    by_object = coverage(log, keys).join(fragmentations(log, keys), [*keys, "oid"]).groupBy(*keys).agg(
        F.count("*").alias("num_unique_objects"), *(F.count_if(F.col("coverage") == c).alias(c) for c in ("mostly_tracked", "partially_tracked", "mostly_lost")),
        F.count_if(F.col("matched") == 0).alias("missed"), F.sum("fragmentations").alias("num_fragmentations"),
    )
    by_traj = never_matched(log, keys, "hid").groupBy(*keys).agg(F.count("*").alias("fp_tracks"))
    out = base.join(by_object, keys, "left").join(by_traj, keys, "left").fillna(0, ["num_unique_objects", "mostly_tracked", "partially_tracked", "mostly_lost", "missed", "num_fragmentations", "fp_tracks"])
    hits = F.col("num_matches") + F.col("num_switches")
    out = out.withColumns({
        "recall": F.try_divide(hits, F.col("num_objects")), "precision": F.try_divide(hits, F.col("num_predictions")),
        "mota": 1 - F.try_divide(F.col("num_misses") + F.col("num_false_positives") + F.col("num_switches"), F.col("num_objects")),
        "mostly_lost2": F.col("mostly_lost") - F.col("missed"),
    })
    if identities is not None:
        out = out.join(identities.select(*keys, "idtp"), keys, "left").fillna(0, ["idtp"])
        out = out.withColumns({"idfn": F.col("num_objects") - F.col("idtp"), "idfp": F.col("num_predictions") - F.col("idtp")})
        out = out.withColumns({"idf1": F.try_divide(2 * F.col("idtp"), 2 * F.col("idtp") + F.col("idfp") + F.col("idfn")), "idp": F.try_divide(F.col("idtp"), F.col("num_predictions")), "idr": F.try_divide(F.col("idtp"), F.col("num_objects"))})
    return ratios(out)


def event_label(kind: Column) -> Column:
    """What an event is called in a picture."""
    names = {"MATCH": "OK", "MISS": "MISS", "FP": "FP", "SWITCH": "SW", "TRANSFER": "TRANS", "MIGRATE": "MIG", "ASCEND": "ASC"}
    return F.coalesce(*(F.when(kind == k, v) for k, v in names.items()))


def label_objects(objects: DataFrame, log: DataFrame, frames: DataFrame, keys: list[str], side: str) -> DataFrame:
    """objects (frame_time, traj_id) with the label of their event in the log's nearest frame; null where it has none.

    `frames` gives the log's frames their frame_time. side: "oid" for true objects, "hid" for predictions. An object with
    several events in a frame has a row for each.
    """
    times = objects.select(*keys, F.col("frame_time").alias("t")).distinct()
    near = nearest(times, frames.select(*keys, "frame_idx", "frame_time"), keys).select(*keys, F.col("t").alias("frame_time"), F.col("frame_idx").alias("log_frame"))
    told = log.filter(F.col(side).isNotNull()).select(*keys, F.col("frame_idx").alias("log_frame"), F.col(side).alias("traj_id"), event_label(F.col("type")).alias("label"))
    return objects.join(near, [*keys, "frame_time"], "left").join(told, [*keys, "log_frame", "traj_id"], "left").drop("log_frame")
