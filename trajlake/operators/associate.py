"""Association of detections to trajectories: what is sequential within one sequence, as a step function over one frame.

Batch and stream share `Associator.step`. In batch, a sequence is first cut wherever so many processed frames lack a usable
detection that no trajectory survives; the parts are folded as groups of their own, and trajectory ids are (part, number).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import SIGMAS
from ..functions.vectors import total
from . import pieces
from .assignment import assign, assign_lists
from .folds import fold
from .motion import SAMPLES, BoxFilter
from .tables import kept

#: Default parameters of the association.
PARAMS = {
    "kf_weight": 0.5, "kf_warmup": 1.0, "kp_weight": 0.5, "kp_distance_scale": 1.0, "face_weight": 0.5, "fuse_scores": 0.5, "sim_weight": 0.0, "pose_conf": 0.0, "traj_initial_thr": 0.6, "traj_high_thr": 0.4, "traj_low_thr": 0.1,
    "match_thr_initial": 0.3, "match_thr_high": 0.25, "match_thr_low": 0.2, "new_traj_thr": 0.3, "immediate_confirm_thr": 0.5, "traj_buffer_seconds": 2.0, "delete_dup_iou": 0.7,
}
#: Frames without a match after which a trajectory is lost, and after which a lost trajectory ends.
LOST_AFTER, END_AFTER = 2, 10
NEW, TRACKED, LOST = "New", "Tracked", "Lost"


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    common = np.clip(high - low, 0, None).prod(axis=2)
    size = [(x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) for x in (a, b)]
    whole = size[0][:, None] + size[1][None, :] - common
    return np.divide(common, whole, out=np.zeros_like(common), where=whole > 0)


#: What a detection may have besides its box: a face's box, 17 points as x, y, conf and so on, an embedding and attributes.
EXTRAS = ("subbox", "pose", "reid", "attr")
#: A frame's displacement field: columns, rows, and the displacements row by row.
FIELD = ("gw", "gh", "field_dx", "field_dy")
#: The passes of matching; a column select_<pass> says which detections take part in it, in place of its threshold.
PASSES = ("initial", "high", "low")
SELECTS = tuple(f"select_{p}" for p in PASSES)
SURE = 0.05
KEEP = 0.5


def moved_points(points: np.ndarray, field: tuple | None) -> np.ndarray:
    """Points (n, 2) moved against the field, each by its cell."""
    if field is None:
        return points
    gw, gh, dx, dy = field
    cells = [np.clip((points[:, k] * n + 0.5).astype(int), 0, n - 1) for k, n in ((0, gw), (1, gh))]
    at = cells[1] * gw + cells[0]
    return np.clip(points - np.stack([dx[at], dy[at]], axis=1), 0, 1)


def moved_boxes(boxes: np.ndarray, field: tuple | None) -> np.ndarray:
    """Boxes (n, 4) moved against the weighted mean of the field at five sample points."""
    if field is None or not len(boxes):
        return boxes
    gw, gh, dx, dy = field
    move = np.zeros((len(boxes), 2))
    for x, y, weight in SAMPLES:
        where = np.stack([boxes[:, 0] * x + boxes[:, 2] * (1 - x), boxes[:, 1] * y + boxes[:, 3] * (1 - y)], axis=1)
        at = np.clip((where[:, 1] * gh + 0.5).astype(int), 0, gh - 1) * gw + np.clip((where[:, 0] * gw + 0.5).astype(int), 0, gw - 1)
        move += weight * np.stack([dx[at], dy[at]], axis=1)
    return np.clip(boxes - np.tile(move, 2), 0, 1)


def stacked(values: list, width: int) -> np.ndarray:
    """Rows of `width` numbers; NaN for what is missing or of another length."""
    return np.array([v if v is not None and len(v) == width else np.full(width, np.nan) for v in values], float).reshape(len(values), width)


def point_similarity(new: np.ndarray, old: np.ndarray, areas: np.ndarray, scale: float) -> np.ndarray:
    """Object key point similarity of poses (n, 17, 3) and (m, 17, 3); NaN unless both see more than four common points."""
    seen = (new[:, None, :, 2] > 0) & (old[None, :, :, 2] > 0)
    apart = ((new[:, None, :, :2] - old[None, :, :, :2]) ** 2).sum(axis=3)
    width = 2 * (0.5 * 0.53 * scale**2) * areas[:, :, None] * (2 * np.array(SIGMAS)) ** 2 + 1e-7
    near, n = np.where(seen, np.exp(-np.where(seen, apart, 0) / width), 0).sum(axis=2), seen.sum(axis=2)
    return np.where(n > 4, near / (n + 1e-7), np.nan)


def measured(box: Sequence[float]) -> tuple[float, float, float, float]:
    """Centre, ratio and height of a box."""
    x1, y1, x2, y2 = map(float, box)
    h = y2 - y1
    return (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / h if h else 0.0, h


def overlap(a: Sequence[float], b: Sequence[float]) -> float:
    """iou_matrix() of two boxes."""
    (x1, y1, x2, y2), (u1, v1, u2, v2) = a, b
    wide = (x2 if x2 < u2 else u2) - (x1 if x1 > u1 else u1)
    if wide > 0:
        high = (y2 if y2 < v2 else v2) - (y1 if y1 > v1 else v1)
        if high > 0:
            common = wide * high
            whole = (x2 - x1) * (y2 - y1) + (u2 - u1) * (v2 - v1) - common
            return common / whole if whole > 0 else 0.0
    return 0.0


def chosen(hits: list[tuple[int, int, float]], rows: int, columns: int) -> list[tuple[int, int, float]]:
    """Those pairs (row, column, score over 0, in order) of a matrix that are matched one to one with the largest sum."""
    if len(hits) == 1 or len({h[0] for h in hits}) == len(hits) == len({h[1] for h in hits}):  # nothing to choose
        return hits
    cost, scores = [[0.0] * columns for _ in range(rows)], {(r, c): score for r, c, score in hits}
    for (r, c), score in scores.items():
        cost[r][c] = -score
    return [(*pair, scores[pair]) for pair in assign_lists(cost) if pair in scores]


@dataclass(slots=True)
class Trajectory:
    number: int
    box: Sequence[float]
    conf: float
    class_id: int
    state: str
    #: None where its weight is 0 and nobody asks for predictions.
    filter: BoxFilter | None
    seen: float
    observations: int = 1
    missed: int = 0
    parts: dict = field(default_factory=dict)


@dataclass
class Associator:
    """All trajectories of one sequence. step() takes a frame's detections and gives the rows of its trajectories."""

    params: dict = field(default_factory=lambda: dict(PARAMS))
    trajectories: list[Trajectory] = field(default_factory=list)
    started: int = 0
    last_time: float = -np.inf
    #: In place of scores(): (associator, boxes, confs, parts, trajectories, time, least, field) -> matrix, 0 where no match may be.
    pair_score: Callable | None = None
    #: (boxes, boxes of trajectories) -> matrix of the pairs that are to be scored at all.
    blocking: Callable | None = None
    #: By pass: which trajectories take part in it, in place of all (initial) or those that aren't lost (high, low).
    trajectory_selectors: dict[str, Callable[[Trajectory], bool]] = field(default_factory=dict)
    #: Where a list, step() adds (number, box, box moved by the field, box of the filter) of each trajectory before its frame.
    predictions: list | None = None

    def moved(self, trajectories: list[Trajectory], field: tuple | None, pose: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The trajectories' boxes moved by the field, with poses grown over their sure points, and the moved poses."""
        flow, m = moved_boxes(np.array([t.box for t in trajectories]), field), len(trajectories)
        if not pose:
            return flow, None
        poses = stacked([t.parts.get("pose") for t in trajectories], 51).reshape(m, 17, 3)
        known = ~np.isnan(poses[:, 0, 0])
        poses[known, :, :2] = moved_points(poses[known, :, :2].reshape(-1, 2), field).reshape(-1, 17, 2)
        sure = (poses[:, :, 2] > SURE)[:, :, None]
        low, high = (np.where(sure, poses[:, :, :2], x) for x in (np.inf, -np.inf))
        return np.concatenate([np.minimum(flow[:, :2], low.min(axis=1)), np.maximum(flow[:, 2:], high.max(axis=1))], axis=1), poses

    def scores(self, boxes: np.ndarray, confs: np.ndarray, parts: dict, trajectories: list[Trajectory], time: float, least: float, field: tuple | None = None) -> np.ndarray:
        """Weighted mean of the overlap with each trajectory's box, moved by the field and grown over its sure points (and of
        the faces' overlap), the overlap with its predicted box and the points' similarity, with the embeddings' likeness
        added; 0 below `least`, by confidence."""
        p, n, m = self.params, len(boxes), len(trajectories)
        ahead = np.array([t.filter.predicted(time) for t in trajectories])
        old = {k: [t.parts.get(k) for t in trajectories] for k in parts}
        flow, poses = self.moved(trajectories, field, "pose" in parts)
        weight = np.array([0.0 if t.observations < 2 else p["kf_weight"] * (1 - max(0.1, 1 / t.observations) ** p["kf_warmup"]) for t in trajectories])
        seen, kf = iou_matrix(boxes, flow), iou_matrix(boxes, ahead)
        if "subbox" in parts:
            faces = stacked(old["subbox"], 4)
            known = ~np.isnan(faces[:, 0])
            faces[known] = moved_boxes(faces[known], field)
            seen = seen + p["face_weight"] * iou_matrix(stacked(parts["subbox"], 4), faces)
        score, divisor = seen + kf * weight, np.broadcast_to(1 + weight, (n, m))
        if "pose" in parts:
            size = [(x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) for x in (boxes, flow)]
            points = point_similarity(stacked(parts["pose"], 51).reshape(n, 17, 3), poses, size[0][:, None] + size[1][None, :], p["kp_distance_scale"])
            use = ~np.isnan(points) & (seen + kf != 0)
            score, divisor = score + np.where(use, points * p["kp_weight"], 0), divisor + np.where(use, p["kp_weight"], 0)
        score = score / divisor
        if "reid" in parts:
            score = score + p["sim_weight"] * self._likeness(parts["reid"], old["reid"])
        return np.where(score < least, 0, score) * (confs ** p["fuse_scores"])[:, None]

    def _likeness(self, new: list, old: list) -> np.ndarray:
        """Cosines of embeddings less the frame's mean (self.mean); 0 where one is missing."""

        def unit(values: list) -> np.ndarray:
            less = stacked(values, len(self.mean)) - self.mean
            norms = np.linalg.norm(less, axis=1, keepdims=True)
            return np.nan_to_num(np.divide(less, norms, out=less.copy(), where=norms > 0))

        return unit(new) @ unit(old).T

    def step(self, time: float, boxes: np.ndarray, confs: np.ndarray, classes: np.ndarray, parts: dict[str, list] | None = None, field: tuple | None = None, selected: dict[str, np.ndarray] | None = None) -> list[tuple]:
        """(number, class, conf, x1, y1, x2, y2, then the parts) of every tracked object. selected: by pass, which detections
        take part in it."""
        p, parts = self.params, parts or {}
        for t in self.trajectories:
            t.filter = t.filter or BoxFilter(measured(t.box), t.seen)
        raised = confs + p["pose_conf"] * np.nansum(stacked(parts["pose"], 51)[:, 2::3], axis=1) if "pose" in parts else confs
        order = np.lexsort((boxes[:, 1], boxes[:, 0], -raised)) if len(boxes) else np.zeros(0, int)
        boxes, confs, classes, raised = boxes[order], confs[order], classes[order], raised[order]
        parts, selected = {k: [v[i] for i in order] for k, v in parts.items()}, {k: v[order] for k, v in (selected or {}).items()}
        if vectors := [v for v in [*parts.get("reid", []), *(t.parts.get("reid") for t in self.trajectories)] if v is not None]:
            self.mean = np.mean(vectors, axis=0)
        elif "reid" in parts:
            self.mean = np.zeros(0)
        free, waiting, alive = np.ones(len(boxes), bool), list(self.trajectories), []
        if self.predictions is not None and waiting:
            flow, _ = self.moved(waiting, field, any("pose" in t.parts for t in waiting))
            self.predictions += [(t.number, *map(float, t.box), *map(float, f), *map(float, t.filter.predicted(time))) for t, f in zip(waiting, flow, strict=True)]
        for name, all_states in zip(PASSES, (False, True, True), strict=True):
            dets = np.flatnonzero(free & (selected[name] if name in selected else raised > p[f"traj_{name}_thr"]))
            olds = [t for t in waiting if (self.trajectory_selectors[name](t) if name in self.trajectory_selectors else all_states or t.state != LOST)]
            if not len(dets) or not olds:
                continue
            some = {k: [v[d] for d in dets] for k, v in parts.items()}
            score = (self.pair_score or Associator.scores)(self, boxes[dets], confs[dets], some, olds, time, p[f"match_thr_{name}"], field)
            if self.blocking:
                score = np.where(self.blocking(boxes[dets], np.array([t.box for t in olds])), score, 0)
            hits = score > 0
            clear = hits.sum(axis=0).max() <= 1 and hits.sum(axis=1).max() <= 1  # nothing to choose
            for d, o in zip(*np.nonzero(hits), strict=True) if clear else assign(np.where(hits, -score, 0.0)):
                if score[d, o] > 0:
                    trajectory, k = olds[o], dets[d]
                    trajectory.filter.update(measured(boxes[k]), time)
                    trajectory.box, trajectory.conf, trajectory.class_id, trajectory.seen = boxes[k], float(confs[k]), int(classes[k]), time
                    trajectory.parts = self._blended({n: v[k] for n, v in parts.items()}, trajectory.parts)
                    trajectory.observations, trajectory.missed = trajectory.observations + 1, 0
                    if name != "low" or trajectory.state == LOST:
                        trajectory.state = TRACKED
                    free[k] = False
                    waiting.remove(trajectory)
                    alive.append(trajectory)
        for k in np.flatnonzero(free & (raised > p["new_traj_thr"])):
            state = TRACKED if raised[k] > p["immediate_confirm_thr"] else NEW
            alive.append(Trajectory(self.started, boxes[k], float(confs[k]), int(classes[k]), state, BoxFilter(measured(boxes[k]), time), time, parts={n: v[k] for n, v in parts.items()}))
            self.started += 1
        for trajectory in waiting:
            trajectory.missed += 1
            if (time - trajectory.seen < p["traj_buffer_seconds"] and trajectory.missed < END_AFTER) or trajectory.state == TRACKED:
                alive.append(trajectory)
        for trajectory in alive:
            if trajectory.state == TRACKED and trajectory.missed >= LOST_AFTER:
                trajectory.state = LOST
        self.trajectories, self.last_time = self._without_duplicates(alive), time
        return [(t.number, t.class_id, t.conf, *map(float, t.box), *(t.parts.get(n) for n in parts)) for t in self.trajectories if t.state == TRACKED]

    def plain_step(self, time: float, found: list[tuple], rule: tuple, ahead: list | None = None) -> list[Trajectory]:
        """step() where detections are boxes alone (confidence, box, class, confidence as scores are weighted by it; in order
        of confidence, x1 and y1) and nothing is plugged in: the same numbers one by one, as arrays of a frame's few boxes
        take many times as long. ahead gets the rows of `predictions`. Gives the tracked trajectories."""
        passes, start, sure, buffer, duplicate, kf_weight, warmup, filtered = rule
        olds, alive = self.trajectories, []
        free, waiting, near = list(range(len(found))), list(range(len(olds))), None
        if ahead is not None:
            ahead += [(t.number, *t.box, *t.box, *t.filter.predicted(time)) for t in olds]
        if free and waiting:
            sides = []
            for t in olds:
                x1, y1, x2, y2 = t.box
                weight = kf_weight * (1 - max(0.1, 1 / t.observations) ** warmup) if kf_weight and t.observations > 1 else 0.0
                sides.append((x1, y1, x2, y2, (x2 - x1) * (y2 - y1), weight, t.filter.predicted(time) if weight else None))
            near = []
            for _, box, _, _ in found:
                u1, v1, u2, v2 = box
                size, scores = (u2 - u1) * (v2 - v1), []
                near.append(scores)
                for o, (x1, y1, x2, y2, area, weight, expected) in enumerate(sides):
                    score = 0.0
                    wide = (u2 if u2 < x2 else x2) - (u1 if u1 > x1 else x1)
                    if wide > 0:
                        high = (v2 if v2 < y2 else y2) - (v1 if v1 > y1 else y1)
                        if high > 0:
                            common = wide * high
                            whole = size + area - common
                            if whole > 0:
                                score = common / whole
                    if weight:
                        score = (score + overlap(box, expected) * weight) / (1 + weight)
                    if score > 0:
                        scores.append((o, score))
            for name, over, least, lost_too in passes:
                rows = [d for d in free if found[d][0] > over]
                if not rows or not waiting:
                    continue
                columns = [o for o in waiting if lost_too or olds[o].state != LOST]
                at = {o: c for c, o in enumerate(columns)}
                hits = [(r, at[o], score) for r, d in enumerate(rows) for o, score in near[d] if o in at and not score < least and score * found[d][3] > 0]
                if not hits:
                    continue
                hits = [(r, c, score * found[rows[r]][3]) for r, c, score in hits]
                for r, c, _ in chosen(hits, len(rows), len(columns)):
                    d, o = rows[r], columns[c]
                    t, (conf, box, kind, _) = olds[o], found[d]
                    if filtered:
                        t.filter.update(measured(box), time)
                    t.box, t.conf, t.class_id, t.seen, t.parts = box, conf, kind, time, {}
                    t.observations, t.missed = t.observations + 1, 0
                    if name != "low" or t.state == LOST:
                        t.state = TRACKED
                    alive.append(t)
                    free.remove(d)
                    waiting.remove(o)
        for d in free:
            conf, box, kind, _ = found[d]
            if conf > start:
                alive.append(Trajectory(self.started, box, conf, kind, TRACKED if conf > sure else NEW, BoxFilter(measured(box), time) if filtered else None, time))
                self.started += 1
        for o in waiting:
            t = olds[o]
            t.missed += 1
            if t.state == TRACKED:
                if t.missed >= LOST_AFTER:
                    t.state = LOST
                alive.append(t)
            elif time - t.seen < buffer and t.missed < END_AFTER:
                alive.append(t)
        tracked = [t for t in alive if t.state == TRACKED]
        if duplicate < 1.5:  # no overlap is larger
            lost = [t for t in alive if t.state == LOST]
            hits = [(r, c, score) for r, t in enumerate(tracked) for c, o in enumerate(lost) if (score := overlap(t.box, o.box)) >= duplicate] if lost else []
            if hits and duplicate > 0:
                gone = {lost[c].number for _, c, _ in chosen(hits, len(tracked), len(lost))}
                alive = [t for t in alive if t.number not in gone]
            elif hits:
                alive = self._without_duplicates(alive)
        self.trajectories, self.last_time = alive, time
        return tracked

    @staticmethod
    def _blended(new: dict, old: dict) -> dict:
        """A detection's parts in its trajectory: attributes lean to the larger value, embeddings are averaged over time."""
        both = {n for n in new if new[n] is not None and old.get(n) is not None}
        if "attr" in both:
            a, b = np.array(new["attr"], float), np.array(old["attr"], float)
            new["attr"] = (np.maximum(a, b) * 0.9 + np.minimum(a, b) * 0.1).tolist()
        if "reid" in both:
            new["reid"] = (KEEP * np.array(new["reid"], float) + (1 - KEEP) * np.array(old["reid"], float)).tolist()
        return new

    def _without_duplicates(self, trajectories: list[Trajectory]) -> list[Trajectory]:
        live, lost = [t for t in trajectories if t.state == TRACKED], [t for t in trajectories if t.state == LOST]
        if live and lost:
            overlap = iou_matrix(np.array([t.box for t in live]), np.array([t.box for t in lost]))
            gone = {lost[c].number for r, c in assign(np.where(overlap >= self.params["delete_dup_iou"], -overlap, 0.0)) if overlap[r, c] >= self.params["delete_dup_iou"]}
            trajectories = [t for t in trajectories if t.number not in gone]
        return trajectories

    def frames(self, rows: pd.DataFrame, ahead: list | None = None) -> pd.DataFrame:
        """Step through rows (COLUMNS, and EXTRAS and FIELD where there are some); a row without a box is a frame without
        detections. Frames not after the last one are left out. ahead: a list that gets tables of PREDICTED, a row for each
        trajectory before each frame."""
        if self.pair_score is None and self.blocking is None and not self.trajectory_selectors and rows.columns.isin(COLUMNS).all():
            return self.plain_frames(rows, ahead)
        extras = [c for c in EXTRAS if c in rows.columns]
        time, frame = rows.frame_time.to_numpy(float), rows.frame_idx.to_numpy(np.int64)
        order = np.lexsort((frame, time))
        time, frame = time[order], frame[order]
        conf, classes = rows.conf.to_numpy(float)[order], rows.class_id.fillna(0).to_numpy(int)[order]
        boxes = rows[["x1", "y1", "x2", "y2"]].to_numpy(float)[order]
        parts = {c: [rows[c].iloc[k] for k in order] for c in extras}
        fields = [rows[c].iloc[order].tolist() for c in FIELD] if set(FIELD) <= set(rows.columns) else None
        selects = {c.removeprefix("select_"): rows[c].fillna(False).to_numpy(bool)[order] for c in SELECTS if c in rows.columns}
        starts = np.flatnonzero(np.append(True, (time[1:] != time[:-1]) | (frame[1:] != frame[:-1]))) if len(order) else np.zeros(0, int)
        out = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            if time[lo] > self.last_time:
                some = np.arange(lo, hi)[~np.isnan(conf[lo:hi])]
                motion = None
                if fields and fields[2][lo] is not None:
                    motion = int(fields[0][lo]), int(fields[1][lo]), np.asarray(fields[2][lo], float), np.asarray(fields[3][lo], float)
                self.predictions = None if ahead is None else []
                found = self.step(float(time[lo]), boxes[some], conf[some], classes[some], {c: [v[k] for k in some] for c, v in parts.items()}, motion, {c: v[some] for c, v in selects.items()})
                out += [(int(frame[lo]), float(time[lo]), *row) for row in found]
                if ahead is not None:
                    ahead.append(columns_of([(int(frame[lo]), float(time[lo]), *row) for row in self.predictions], PREDICTED))
        return pd.DataFrame(out, columns=["frame_idx", "frame_time", "traj_id", "class_id", "conf", "x1", "y1", "x2", "y2", *extras])

    def plain_frames(self, rows: pd.DataFrame, ahead: list | None = None) -> pd.DataFrame:
        """frames() by plain_step()."""
        p = self.params
        filtered = bool(p["kf_weight"]) or ahead is not None
        for t in self.trajectories:
            t.filter = t.filter or (BoxFilter(measured(t.box), t.seen) if filtered else None)
        passes = [(n, p[f"traj_{n}_thr"], p[f"match_thr_{n}"], lost_too) for n, lost_too in zip(PASSES, (False, True, True), strict=True)]
        rule = passes, p["new_traj_thr"], p["immediate_confirm_thr"], p["traj_buffer_seconds"], p["delete_dup_iou"], p["kf_weight"], p["kf_warmup"], filtered
        time, frame, conf = rows.frame_time.to_numpy(float), rows.frame_idx.to_numpy(np.int64), rows.conf.to_numpy(float)
        x1, y1 = rows.x1.to_numpy(float), rows.y1.to_numpy(float)
        order = np.lexsort((y1, x1, -conf, frame, time))
        starts = np.flatnonzero(np.append(True, (np.diff(time[order]) != 0) | (np.diff(frame[order]) != 0))) if len(order) else np.zeros(0, int)
        ends = np.append(starts[1:], len(order))
        found, told = [], []
        for low in range(0, len(starts), FRAMES_AT_ONCE):  # lists of a few frames, arrays of all
            some = order[starts[low] : ends[min(low + FRAMES_AT_ONCE, len(starts)) - 1]]
            sure = np.nan_to_num(conf[some])
            boxes = zip(x1[some].tolist(), y1[some].tolist(), rows.x2.to_numpy(float)[some].tolist(), rows.y2.to_numpy(float)[some].tolist(), strict=True)
            classes = rows.class_id.iloc[some].fillna(0).to_numpy(int).tolist()
            each = list(zip(sure.tolist(), boxes, classes, (sure ** p["fuse_scores"]).tolist(), strict=True))
            first, out, expected = starts[low], [], []
            there = np.append(0, np.cumsum(~np.isnan(conf[some])))  # the others are last in their frame
            at, to = starts[low : low + FRAMES_AT_ONCE] - first, ends[low : low + FRAMES_AT_ONCE] - first
            for now, number, lo, hi in zip(time[some[at]].tolist(), frame[some[at]].tolist(), at.tolist(), (at + there[to] - there[at]).tolist(), strict=True):
                if now > self.last_time:
                    before = [] if ahead is not None else None
                    out += [(number, now, t.number, t.class_id, t.conf, *t.box) for t in self.plain_step(now, each[lo:hi], rule, before)]
                    if before:
                        expected += [(number, now, *row) for row in before]
            found.append(columns_of(out, OUT_NAMES))
            if ahead is not None:
                ahead.append(columns_of(expected, PREDICTED))
        return pd.concat(found) if found else columns_of([], OUT_NAMES)


OUT = "frame_idx long, frame_time double, traj_id long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
#: Where a trajectory was last, where the field moves it, and where its filter expects it.
SIDES = ("from", "flow", "filter")
PREDICTED = ["frame_idx", "frame_time", "traj_id", *(f"{s}_{c}" for s in SIDES for c in ("x1", "y1", "x2", "y2"))]
COLUMNS = ["frame_idx", "frame_time", "class_id", "conf", "x1", "y1", "x2", "y2"]
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
#: Frames whose rows are Python objects at one time.
FRAMES_AT_ONCE = 4096


def columns_of(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """A table of rows of numbers, whole ones in frame_idx, traj_id and class_id."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pd.DataFrame({n: np.array(c, np.int64 if n in ("frame_idx", "traj_id", "class_id") else float) for n, c in zip(names, columns, strict=True)})


def with_segments(frames: DataFrame, detections: DataFrame, keys: list[str], least_conf: float, pose_conf: float = 0.0) -> DataFrame:
    """Each frame left-joined to its detections, with the part of the sequence it is in: a new part begins with the first
    usable detection after END_AFTER + LOST_AFTER or more frames without one. Columns of EXTRAS and SELECTS (detections) and FIELD
    (frames) go along."""
    motion, extras = [c for c in FIELD if c in frames.columns], [c for c in (*EXTRAS, *SELECTS) if c in detections.columns]
    joined = frames.select(*keys, "frame_idx", "frame_time", *motion).join(detections.select(*keys, "frame_idx", "class_id", "conf", "x1", "y1", "x2", "y2", *extras), [*keys, "frame_idx"], "left")
    joined = kept(joined, "joined")  # read twice, and the detections behind it may take a sort
    conf = F.col("conf")
    if "pose" in extras:
        conf = conf + pose_conf * F.coalesce(total(F.filter("pose", lambda _, i: i % 3 == 2)), F.lit(0.0))
    wanted = reduce(or_, (F.coalesce(c, F.lit(False)) for c in (conf > least_conf, *(F.col(s) for s in SELECTS if s in extras))))
    usable = joined.groupBy(*keys, "frame_idx", "frame_time").agg(F.max(wanted).alias("usable"))
    order = ("frame_time", "frame_idx")
    numbered = pieces.carry(pieces.by_step(usable, "frame_time", pieces.SECONDS), keys, {"frames": F.count("*")}, {"frames_before": F.sum("frames").over(pieces.earlier(keys))})
    n = F.row_number().over(pieces.inside(keys, *order)) + F.coalesce("frames_before", F.lit(0))
    numbered = kept(numbered.select(*keys, *order, "usable", pieces.PIECE, n.alias("n")), "frames")
    used = F.when(F.col("usable"), F.col("n"))
    cut = pieces.carry(numbered, keys, {"used": F.max(used)}, {"used_before": F.max("used").over(pieces.earlier(keys))})
    before = F.coalesce(F.last(used, True).over(pieces.inside(keys, *order).rowsBetween(Window.unboundedPreceding, -1)), "used_before")
    starts = cut.withColumn("starts", F.coalesce((F.col("usable") & (F.col("n") - before > END_AFTER + LOST_AFTER)).cast("int"), F.lit(0))).drop("used_before")
    if starts.filter("starts = 1").isEmpty():  # each sequence is one part
        return joined.withColumn("segment", F.lit(0).cast("long"))
    cut = pieces.carry(starts, keys, {"parts": F.sum("starts")}, {"parts_before": F.sum("parts").over(pieces.earlier(keys))})
    parts = cut.withColumn("segment", F.sum("starts").over(pieces.up_to_here(keys, *order)) + F.coalesce("parts_before", F.lit(0)))
    return joined.join(parts.select(*keys, "frame_idx", "segment"), [*keys, "frame_idx"])


def walked(rows: DataFrame, by: list[str], start: Callable[[tuple], Associator], used: list[str], schema: str, ahead: bool = False) -> DataFrame:
    """by without its last, the segment, and what Associator.frames() gives for `used` (ahead: predictions in place of it), traj_id
    as segment << 32 | number."""

    def begin(key: tuple) -> Callable[[pd.DataFrame], pd.DataFrame]:
        walker = start(key)

        def walk(group: pd.DataFrame) -> pd.DataFrame:
            before = [] if ahead else None
            out = walker.frames(group, before)
            if ahead:
                out = pd.concat(before) if before else columns_of([], PREDICTED)
            out["traj_id"] += int(key[-1]) << 32
            return out

        return walk

    return fold(rows, by, ["frame_time", "frame_idx"], used, begin, schema)


def associate(frames: DataFrame, detections: DataFrame, keys: list[str], params: dict | None = None, split: bool = True, pair_score: Callable | None = None, blocking: Callable | None = None, selectors: dict[str, Column] | None = None, trajectory_selectors: dict[str, Callable[[Trajectory], bool]] | None = None) -> DataFrame:
    """Trajectories of all sequences: keys, frame_idx, frame_time, traj_id, class_id, conf, box, and those of EXTRAS that
    detections have. pair_score, blocking and trajectory_selectors: see Associator. selectors: by pass (PASSES), a predicate
    over the detections' columns for those that take part in it.

    traj_id is segment << 32 | number. split=False folds whole sequences, with equal trajectories but for their ids.
    """
    settings = PARAMS | (params or {})
    least = min(settings[k] for k in ("traj_initial_thr", "traj_high_thr", "traj_low_thr", "new_traj_thr"))
    if selectors:
        detections = detections.withColumns({f"select_{name}": c for name, c in selectors.items()})
    rows = with_segments(frames, detections, keys, least, settings["pose_conf"])
    if not split:
        rows = rows.withColumn("segment", F.lit(0).cast("long"))

    def start(_: tuple) -> Associator:
        return Associator(settings, pair_score=pair_score, blocking=blocking, trajectory_selectors=trajectory_selectors or {})

    kinds = dict(rows.dtypes)
    extras = [c for c in EXTRAS if c in kinds]
    used = [*COLUMNS, *extras, *(c for c in (*FIELD, *SELECTS) if c in kinds)]
    return walked(rows, [*keys, "segment"], start, used, ", ".join([OUT, *(f"{c} array<double>" for c in extras)]))


def predict(frames: DataFrame, detections: DataFrame, keys: list[str], params: dict | None = None) -> DataFrame:
    """What associate() expects before each frame: keys, frame_idx, frame_time, traj_id and three boxes of every trajectory
    alive, lost ones too: its last one (from_x1 and so on), the one moved by the displacement field and grown over its sure points (flow_)
    and the filter's (filter_). Regions of the next detection come from these (frames.regions_ahead)."""
    settings = PARAMS | (params or {})
    least = min(settings[k] for k in ("traj_initial_thr", "traj_high_thr", "traj_low_thr", "new_traj_thr"))
    rows = with_segments(frames, detections, keys, least, settings["pose_conf"])
    kinds = dict(rows.dtypes)
    used = [*COLUMNS, *(c for c in (*EXTRAS, *FIELD, *SELECTS) if c in kinds)]

    boxes = ", ".join(f"{c} double" for c in PREDICTED[3:])
    return walked(rows, [*keys, "segment"], lambda _: Associator(settings), used, f"frame_idx long, frame_time double, traj_id long, {boxes}", ahead=True)


#: Associators by name; each is (frames, detections, keys, params) -> trajectories. Add to it to plug in another.
ASSOCIATORS: dict[str, Callable[..., DataFrame]] = {"kalman_iou": associate}


def associator(name: str) -> Callable[..., DataFrame]:
    return ASSOCIATORS[name]
