"""Association as a stream whose state is a map with an entry for each trajectory.

Where online.associate_stream keeps a sequence as one value that is written whole with each batch, here a trajectory, a frame that
waits and the sequence's counters are entries of their own, so that a batch writes what has changed, entries are as large as
a trajectory, and a query's progress tells how many there are (state_size). Timers of event time close the waiting frames
and forget silent sequences. Results equal those of associate() and associate_stream().

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass, see PROVIDER.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.associate import COLUMNS, OUT, PARAMS, Associator, Trajectory
from ..operators.motion import BoxFilter
from .online import SHIFT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRAJECTORY = "place int, box array<double>, conf double, class_id int, state string, time double, p array<double>, v array<double>, c array<double>, seen double, observations int, missed int, parts binary"
SEQUENCE = "started long, last_time double, late long"


def as_entry(place: int, t: Trajectory) -> tuple:
    f = t.filter
    kept = (None, None, None, None) if f is None else (f.time, list(f.p), list(f.v), list(f.c))
    return (place, list(map(float, t.box)), t.conf, t.class_id, t.state, *kept, t.seen, t.observations, t.missed, pickle.dumps(t.parts))


def from_entry(number: int, entry: tuple) -> Trajectory:
    _, box, conf, class_id, state, time, p, v, c, seen, observations, missed, parts = entry
    own = None
    if time is not None:
        own = BoxFilter.__new__(BoxFilter)
        own.time, own.p, own.v, own.c = time, tuple(p), tuple(v), tuple(c)
    return Trajectory(number, tuple(box), conf, class_id, state, own, seen, observations, missed, pickle.loads(bytes(parts)))


class Association(StatefulProcessor):
    def __init__(self, params: dict, key: str, delay: float | None, idle: float | None):
        self.params, self.key, self.delay, self.idle = params, key, delay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trajectories = handle.getMapState("trajectories", "number long", TRAJECTORY)
        self.waiting = handle.getMapState("waiting", "frame_time double", "rows binary")
        self.sequence = handle.getValueState("sequence", SEQUENCE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, last, late = self.sequence.get() if self.sequence.exists() else (0, -math.inf, 0)
        found = pd.concat(list(rows))[COLUMNS]
        fresh = found[found.frame_time > last]
        late += len(found) - len(fresh)
        self.sequence.update((started, last, late))
        if self.delay is None:
            yield from self._taken(key, fresh)
            return
        for time, frame in fresh.groupby("frame_time"):
            before = pickle.loads(bytes(self.waiting.getValue((time,))[0])) if self.waiting.containsKey((time,)) else None
            self.waiting.updateValue((time,), (pickle.dumps(frame if before is None else pd.concat([before, frame])),))
        yield from self._closed(key, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._closed(key, timerValues)

    def _closed(self, key: tuple, timers) -> Iterator[pd.DataFrame]:
        """The waiting frames that the watermark has passed; and the next timer."""
        mark = timers.getCurrentWatermarkInMs() / 1000 - SHIFT
        times = sorted(t for (t,) in self.waiting.keys())
        ready = [t for t in times if t <= mark]
        frames = [pickle.loads(bytes(self.waiting.getValue((t,))[0])) for t in ready]
        for t in ready:
            self.waiting.removeKey((t,))
        if frames:
            yield from self._taken(key, pd.concat(frames))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        last = self.sequence.get()[1] if self.sequence.exists() else -math.inf
        waits = times[len(ready) :]
        if not waits and self.idle and mark >= last + self.idle:
            for state in (self.trajectories, self.waiting, self.sequence):
                state.clear()
        elif waits or self.idle:
            self.handle.registerTimer(int((max(waits[0] if waits else last + self.idle, mark) + SHIFT) * 1000) + 1)

    def _taken(self, key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        started, last, late = self.sequence.get()
        entries = sorted(((entry[0], number[0], entry) for number, entry in self.trajectories.iterator()), key=lambda x: x[:2])
        associator = Associator(self.params, [from_entry(n, e) for _, n, e in entries], started, last)
        out = associator.frames(rows)
        left = {t.number for t in associator.trajectories}
        for _, number, _ in entries:
            if number not in left:
                self.trajectories.removeKey((number,))
        for place, t in enumerate(associator.trajectories):
            self.trajectories.updateValue((t.number,), as_entry(place, t))
        self.sequence.update((associator.started, associator.last_time, late))
        out.insert(0, self.key, key[0])
        out["late"] = late
        yield out

    def close(self) -> None:
        pass


def associate_keyed(detections: DataFrame, key: str = "seq_id", params: dict | None = None, delay: float | None = None, idle: float | None = None) -> DataFrame:
    """key, the columns of associate() and late, as associate_stream() gives them; idle only with a delay."""
    spark = detections.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"state by keys needs spark.sql.streaming.stateStore.providerClass = {PROVIDER}")
    rows = detections.select(key, *COLUMNS)
    if delay is not None:
        rows = rows.withColumn("event_ts", F.timestamp_seconds(F.col("frame_time") + SHIFT)).withWatermark("event_ts", f"{delay} seconds")
    out = f"{key} {dict(detections.dtypes)[key]}, {OUT}, late long"
    return rows.groupBy(key).transformWithStateInPandas(Association(PARAMS | (params or {}), key, delay, idle), out, "Append", "None" if delay is None else "EventTime")


def state_size(progress: dict) -> dict[str, int]:
    """Entries, bytes and removed entries of a query's state, from its progress (StreamingQuery.lastProgress)."""
    states = progress["stateOperators"]
    return {n: sum(s[k] for s in states) for n, k in (("entries", "numRowsTotal"), ("bytes", "memoryUsedBytes"), ("removed", "numRowsRemoved"))}
