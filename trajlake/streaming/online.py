"""Association, rate limits and online events as Structured Streaming: state for each sequence.

Without a delay, rows are taken as they arrive; a micro-batch must hold whole frames. With a delay (seconds), rows wait in the
state until the watermark, that far behind the latest frame, has passed them, so that frames may come in any order within
it. A row at or before its sequence's last frame that was taken is late: counted in the column `late`, not used (rows behind
the watermark are dropped before by Spark, which counts them as numRowsDroppedByWatermark). A sequence
silent for `idle` seconds (of frame time with a delay, else of the clock) has its state dropped.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.associate import COLUMNS, OUT, PARAMS, Associator
from ..operators.clearmot import fold_matches


#: Seconds that event times lie after frame times: a stream's first watermark is 0, and rows at it are dropped.
SHIFT = 1_000_000
#: Rows of a result that become an Arrow table at one time, and pairs of boxes that are compared.
ROWS_AT_ONCE = 1 << 16


def _run(df: DataFrame, key: str, start: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], out: str, delay: float | None, idle: float | None) -> DataFrame:
    """step(state, rows) gives the rows of the result without key and late; it may change the state that start() made."""
    kind = GroupStateTimeout.EventTimeTimeout if delay is not None else GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    if delay is not None:
        df = df.withColumn("event_ts", F.timestamp_seconds(F.col("frame_time") + SHIFT)).withWatermark("event_ts", f"{delay} seconds")

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inner, late, last, wait = pickle.loads(bytes(state.get[0])) if state.exists else (start(), 0, -math.inf, None)
        if state.hasTimedOut and delay is None:
            state.remove()
            return
        rows = None if state.hasTimedOut else pd.concat(list(parts))
        if rows is not None:
            fresh = rows[rows.frame_time > last]
            late += len(rows) - len(fresh)
            wait = fresh if wait is None else pd.concat([wait, fresh])
        mark = state.getCurrentWatermarkMs() / 1000 - SHIFT if delay is not None else math.inf
        ready, wait = wait[wait.frame_time <= mark], wait[wait.frame_time > mark]
        if len(ready):
            last = max(last, float(ready.frame_time.max()))
            found = step(inner, ready)
            found.insert(0, key, group[0])
            found["late"] = late
            for k in range(0, len(found), ROWS_AT_ONCE):
                yield found.iloc[k : k + ROWS_AT_ONCE]
            del found
        if delay is not None and idle and not len(wait) and mark >= last + idle:
            state.remove()
            return
        state.update((pickle.dumps((inner, late, last, wait)),))
        if delay is not None and (len(wait) or idle):
            state.setTimeoutTimestamp(int((max(wait.frame_time.min() if len(wait) else last + idle, mark) + SHIFT) * 1000) + 1)
        elif delay is None and idle:
            state.setTimeoutDuration(int(idle * 1000))

    return df.groupBy(key).applyInPandasWithState(fold, f"{key} {dict(df.dtypes)[key]}, {out}, late long", "state binary", "append", kind)


def associate_stream(detections: DataFrame, key: str = "seq_id", params: dict | None = None, delay: float | None = None, idle: float | None = None) -> DataFrame:
    """key, the columns of associate() and late (rows so far)."""
    chosen = PARAMS | (params or {})
    return _run(detections, key, lambda: Associator(chosen), lambda associator, rows: associator.frames(rows[COLUMNS]), OUT, delay, idle)


def rate_limited(frames: DataFrame, interval: float, key: str = "seq_id", delay: float | None = None, idle: float | None = None) -> DataFrame:
    """Frames at least `interval` after the last one taken: key, frame_idx, frame_time and late."""

    def step(state: dict, rows: pd.DataFrame) -> pd.DataFrame:
        taken = []
        for row in rows.sort_values("frame_time").itertuples():
            if row.frame_time - state["last"] >= interval:
                state["last"] = row.frame_time
                taken.append((row.frame_idx, row.frame_time))
        return pd.DataFrame(taken, columns=["frame_idx", "frame_time"])

    return _run(frames, key, lambda: {"last": -math.inf}, step, "frame_idx long, frame_time double", delay, idle)


def matches_stream(pairs: DataFrame, key: str = "seq_id", delay: float | None = None, idle: float | None = None) -> DataFrame:
    """MATCH and SWITCH events of gated pairs (key, frame_idx, frame_time, oid, hid, d), and late; the state is each object's
    last partner."""
    return _run(pairs, key, dict, lambda last, rows: fold_matches(rows, last), "frame_idx long, type string, oid long, hid long, d double", delay, idle)


BOX = ["x1", "y1", "x2", "y2"]
#: Sides of the log, as numbers: strings would take most of a worker's memory.
OBJECT, PREDICTION, TICK = 0, 1, 2
EVENTS = "frame_idx long, type string, oid long, hid long, d double"


def frame_events(last: dict[int, int], rows: pd.DataFrame, max_distance: float) -> pd.DataFrame:
    """All events (EVENTS) of whole frames (side, frame_idx, traj_id, box): what fold_matches() matches, a MISS for each other
    object and an FP for each other prediction. `last` holds each object's last partner, and is carried on."""
    objects, predictions = ({c: rows[c].to_numpy(k)[order] for c, k in (("frame_idx", np.int64), ("traj_id", np.int64), *((b, float) for b in BOX))} for order in (_ordered(rows, s) for s in (OBJECT, PREDICTION)))
    low, high = (np.searchsorted(predictions["frame_idx"], objects["frame_idx"], side) for side in ("left", "right"))
    before = np.append(0, np.cumsum(high - low))  # pairs in the frames of the objects before
    near, at = [], 0
    while at < len(low):  # frames in which about so many pairs meet
        to = max(at + 1, int(np.searchsorted(before, before[at] + ROWS_AT_ONCE)))
        n = (high - low)[at:to]
        o = np.repeat(np.arange(at, min(to, len(low))), n)
        h = np.arange(len(o)) - np.repeat(np.cumsum(n) - n, n) + low[o]
        apart = 1 - _overlaps([objects[b][o] for b in BOX], [predictions[b][h] for b in BOX])
        some = apart <= max_distance
        near.append(pd.DataFrame({"frame_idx": objects["frame_idx"][o[some]], "oid": objects["traj_id"][o[some]], "hid": predictions["traj_id"][h[some]], "d": apart[some]}))
        at = to
    found = fold_matches(pd.concat(near) if near else pd.DataFrame({"frame_idx": np.zeros(0, np.int64), "oid": np.zeros(0, np.int64), "hid": np.zeros(0, np.int64), "d": np.zeros(0)}), last)
    out = [found]
    for side, name, kind in ((objects, "oid", "MISS"), (predictions, "hid", "FP")):
        matched = pd.MultiIndex.from_arrays([found.frame_idx, found[name]])
        free = ~pd.MultiIndex.from_arrays([side["frame_idx"], side["traj_id"]]).isin(matched)
        out.append(pd.DataFrame({"frame_idx": side["frame_idx"][free], "type": kind, name: pd.array(side["traj_id"][free], "Int64")}))
    return pd.concat([x for x in out if len(x)] or out[:1]).reindex(columns=["frame_idx", "type", "oid", "hid", "d"]).astype({"oid": "Int64", "hid": "Int64", "d": float})


def _ordered(rows: pd.DataFrame, side: int) -> np.ndarray:
    """The places of a side's rows in order of frame, id and box."""
    own = (rows.side.to_numpy() == side).nonzero()[0]
    return own[np.lexsort([rows[c].to_numpy(float)[own] for c in reversed(BOX)] + [rows[c].iloc[own].to_numpy(np.int64) for c in ("traj_id", "frame_idx")])]


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """iou_matrix() of boxes side by side."""
    common = np.clip(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0, None) * np.clip(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0, None)
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return np.divide(common, whole, out=np.zeros_like(common), where=whole > 0)


def events_stream(objects: DataFrame, predictions: DataFrame, key: str = "seq_id", max_distance: float = 0.45, delay: float | None = None, idle: float | None = None, ticks: DataFrame | None = None) -> DataFrame:
    """The whole event log of two streams (key, frame_idx, frame_time, traj_id, box): key, EVENTS and late, equal to events().

    Both sides share one watermark: a frame is closed, and its MISS and FP are told, when that has passed it, in whatever
    order objects and predictions came. ticks (key, frame_time) are frames in which nothing was seen or predicted: they move the
    watermark and have no events, so that the last frames are closed as well. Without a delay a micro-batch must hold
    whole frames of both sides. Rows without an id or frame have no events.
    """
    columns = [key, "frame_idx", "frame_time", "traj_id", *BOX]
    both = objects.select(*columns, F.lit(OBJECT).alias("side")).unionByName(predictions.select(*columns, F.lit(PREDICTION).alias("side")))
    both = both.filter("traj_id IS NOT NULL AND frame_idx IS NOT NULL")
    if ticks is not None:
        both = both.unionByName(ticks.select(key, "frame_time", F.lit(TICK).alias("side")), allowMissingColumns=True)
    return _run(both, key, dict, lambda last, rows: frame_events(last, rows, max_distance), EVENTS, delay, idle)
