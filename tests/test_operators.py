import itertools
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import rows_of
from trajlake.functions import geometry as g
from trajlake.functions import labels, points, vectors
from trajlake.functions.vectors import running_blend
from trajlake.operators import associate, clearmot, detection, identity, motion, rollup, sweep, timegrid
from trajlake.operators import frames as frames_ops
from trajlake.operators.assignment import assign, assign_lists, best_pairs
from trajlake.plans import catalogue
from trajlake.sources import annotations
from trajlake.streaming import keyed, online

BOX = "x1 double, y1 double, x2 double, y2 double"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_equals_brute_force(rows, columns, random):
    cost = np.array([[random.choice([math.inf, random.uniform(-2, 2)]) for _ in range(columns)] for _ in range(rows)])
    best = (0, 0.0)
    for k in range(min(rows, columns) + 1):
        for rs in itertools.combinations(range(rows), k):
            for cs in itertools.permutations(range(columns), k):
                total = sum(cost[r, c] for r, c in zip(rs, cs, strict=True))
                if math.isfinite(total):
                    best = min(best, (-k, total))
    found = assign(cost)
    assert len({r for r, _ in found}) == len(found) == len({c for _, c in found}) == -best[0]
    assert sum(cost[r, c] for r, c in found) == pytest.approx(best[1])


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.floats(0.1, 1), st.sampled_from([1, 3, 1000]), st.integers(0, 2**32))
def test_auction_equals_the_solver(rows, columns, share, most, seed):
    r = np.random.default_rng(seed)
    gain = np.where(r.random((rows, columns)) < share, r.integers(0, most + 1, (rows, columns)), -1)
    left, right = np.nonzero(gain >= 0)
    found = best_pairs(left + 100, right * 7, gain[left, right])
    assert len(set(left[found])) == len(found) == len(set(right[found]))
    whole = np.maximum(gain, 0)
    assert gain[left[found], right[found]].sum() == sum(whole[p] for p in assign(-whole.astype(float)))


def test_auction_of_a_large_component():
    """50,000 ids in one sparse component; the choice is proved best by the sum of one that is planted."""
    r, n = np.random.default_rng(1), 25_000
    order = r.permutation(n)
    left = np.concatenate([np.arange(n), np.arange(n), r.integers(0, n, 2 * n)])
    right = np.concatenate([order, np.roll(order, 1), r.integers(0, n, 2 * n)])
    gain = np.concatenate([np.full(n, 50), r.integers(0, 50, n), r.integers(0, 50, 2 * n)])  # none is over 50
    _, keep = np.unique(left * n + right, return_index=True)
    found = best_pairs(left[keep], right[keep], gain[keep])
    assert len(found) == n and gain[keep][found].sum() == 50 * n


def boxes(spark, rows):
    """(seq, frame, trajectory, left) as boxes of width 10 and height 10."""
    data = [(s, f, t, float(x), 0.0, float(x) + 10, 10.0) for s, f, t, x in rows]
    return spark.createDataFrame(data, f"seq_id long, frame_idx long, traj_id long, {BOX}")


def test_last_match_wins_over_a_closer_new_one(spark):
    gt = boxes(spark, [(0, 0, 1, 0), (0, 1, 1, 0)])
    pred = boxes(spark, [(0, 0, 10, 1), (0, 1, 10, 2), (0, 1, 11, 0)])
    log = rows_of(clearmot.events(gt, pred, ["seq_id"]).select("frame_idx", "type", "oid", "hid"))
    assert (1, 10, 1, "MATCH") in log and (1, 11, None, "FP") in log


def test_switch_miss_and_fragmentation(spark):
    gt = boxes(spark, [(0, f, 1, 0) for f in range(4)])
    pred = boxes(spark, [(0, 0, 10, 0), (0, 2, 10, 0), (0, 3, 11, 0)])
    log = clearmot.events(gt, pred, ["seq_id"])
    assert [r.type for r in log.orderBy("frame_idx").collect()] == ["MATCH", "MISS", "MATCH", "SWITCH"]
    m = clearmot.measures(log, ["seq_id"], identity.identity_matches(spark.createDataFrame([(0, 1, 10), (0, 1, 10), (0, 1, 11)], "seq_id long, oid long, hid long"), ["seq_id"])).first()
    assert (m.num_fragmentations, m.num_switches, m.idtp, m.fp_tracks, m.partially_tracked) == (1, 1, 2, 1, 1)
    assert m.mota == pytest.approx(1 - 2 / 4) and m.idf1 == pytest.approx(4 / 7)


def test_perfect_prediction(spark):
    gt = boxes(spark, [(s, f, t, 20 * t) for s in range(2) for f in range(3) for t in range(3)])
    for m in clearmot.measures(clearmot.events(gt, gt, ["seq_id"]), ["seq_id"]).collect():
        assert (m.mota, m.num_switches, m.recall, m.precision, m.motp) == (1, 0, 1, 1, 0)


def test_identity_is_one_to_one(spark):
    pairs = spark.createDataFrame([(0, o, h) for o, h, n in ((1, 10, 5), (1, 11, 4), (2, 10, 4)) for _ in range(n)], "seq_id long, oid long, hid long")
    assert identity.identity_matches(pairs, ["seq_id"]).first().idtp == 8


def test_empty_tables(spark):
    none = boxes(spark, [])
    assert clearmot.events(none, none, ["seq_id"]).count() == 0
    assert clearmot.measures(clearmot.events(none, none, ["seq_id"]), ["seq_id"]).count() == 0


def test_greedy_takes_the_first_free_object(spark):
    schema = f"f long, class_id int, conf double, {BOX}"
    gt = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0, 10.0, 10.0, 1), (0, 0, 0.9, 1.0, 0.0, 11.0, 10.0, 2)], schema + ", traj_id long")
    det = spark.createDataFrame([(0, 0, 0.8, 1.0, 0.0, 11.0, 10.0, 1), (0, 0, 0.7, 0.0, 0.0, 10.0, 10.0, 2), (0, 1, 0.9, 0.0, 0.0, 10.0, 10.0, 3)], schema + ", det_id long")
    found = {r.det_id: r.gt_id for r in detection.greedy_matches(gt, det, ["f"]).collect()}
    assert found == {1: 1, 2: 2, 3: None}


@pytest.mark.parametrize(("t", "trajectories"), [(0.0, {1: 0.0, 2: 5.0}), (0.05, {1: 5.0, 2: 5.0}), (0.45, {1: 45.0, 3: 9.0}), (0.2, {1: 20.0}), (0.5, {1: 50.0, 3: 9.0}), (9.0, {1: 50.0, 3: 9.0})])
def test_interpolation_rules(spark, t, trajectories):
    frames = spark.createDataFrame([(0, 0, 0.0, True), (0, 1, 0.25, False), (0, 2, 0.5, True)], "seq_id long, frame_idx long, frame_time double, tracked boolean")
    objects = spark.createDataFrame([(0, 0, 1, 0, 1.0, 0.0, 0.0, 1.0, 1.0), (0, 0, 2, 0, 1.0, 5.0, 0.0, 1.0, 1.0), (0, 2, 1, 0, 1.0, 50.0, 0.0, 1.0, 1.0), (0, 2, 3, 0, 1.0, 9.0, 0.0, 1.0, 1.0)], f"seq_id long, frame_idx long, traj_id long, class_id int, conf double, {BOX}")
    grid = spark.createDataFrame([(0, t)], "seq_id long, t double")
    found = {r.traj_id: round(r.x1, 3) for r in timegrid.objects_at(grid, frames, objects, ["seq_id"]).collect()}
    assert found == trajectories


def test_kalman_equals_dense_matrices(spark):
    random = np.random.default_rng(3)
    z = np.column_stack([np.cumsum(random.normal(0.01, 0.005, 12)) + 0.3, np.cumsum(random.normal(0, 0.005, 12)) + 0.4, np.full(12, 0.1), np.full(12, 0.2) + random.normal(0, 0.01, 12)])
    times = np.cumsum(random.uniform(0.02, 0.2, 12))
    rows = [(1, float(t), float(x - w / 2), float(y - h / 2), float(x + w / 2), float(y + h / 2)) for t, (x, y, w, h) in zip(times, z, strict=True)]
    found = motion.kalman_smooth(spark.createDataFrame(rows, f"traj_id long, frame_time double, {BOX}"), ["traj_id"]).orderBy("frame_time").collect()
    m = np.array([[x, y, w / h, h] for x, y, w, h in z])
    pos, vel = lambda h: np.array([h / 20, h / 20, 1e-2, h / 20]), lambda h: np.array([h / 160, h / 160, 1e-5, h / 160])
    state = np.concatenate([m[0], np.zeros(4)])
    cov = np.diag(np.concatenate([[m[0, 3] / 10, m[0, 3] / 10, 1e-2, m[0, 3] / 10], [m[0, 3] / 16, m[0, 3] / 16, 1e-5, m[0, 3] / 16]]) ** 2)
    see = np.eye(4, 8)
    for k in range(1, 12):
        step = np.eye(8)
        step[:4, 4:] = np.eye(4) * (times[k] - times[k - 1]) * 7.5
        noise = np.diag(np.concatenate([pos(abs(state[3])), vel(abs(state[3]))]) ** 2)
        state, cov = step @ state, step @ cov @ step.T + noise
        r = np.diag(np.array([*pos(abs(state[3]))[:2], 1e-1, pos(abs(state[3]))[3]]) ** 2)
        gain = cov @ see.T @ np.linalg.inv(see @ cov @ see.T + r)
        state, cov = state + gain @ (m[k] - see @ state), cov - gain @ see @ cov
        assert np.allclose([found[k].cx, found[k].cy, found[k].a, found[k].h], state[:4], atol=1e-9)
    one = motion.BoxFilter(associate.measured(np.array(rows[0][2:])), times[0])
    for k in range(1, 12):
        one.update(associate.measured(np.array(rows[k][2:])), times[k])
    assert np.allclose(one.p, state[:4], atol=1e-9)


def test_split_and_whole_association_agree(spark):
    frames = spark.createDataFrame([(0, f, f / 10) for f in range(60)], "seq_id long, frame_idx long, frame_time double")
    shown = [f for f in range(60) if f < 15 or f > 40]
    detections = spark.createDataFrame([(0, f, 0, 0.9, 0.1 + f / 500, 0.1, 0.3 + f / 500, 0.5) for f in shown], f"seq_id long, frame_idx long, class_id int, conf double, {BOX}")
    columns = ["frame_idx", "conf", "x1", "x2"]
    split, whole = (associate.associate(frames, detections, ["seq_id"], split=s) for s in (True, False))
    assert rows_of(split.select(*columns)) == rows_of(whole.select(*columns))
    assert split.select("traj_id").distinct().count() == whole.select("traj_id").distinct().count() == 2


def test_grow_and_cells(spark):
    row = spark.createDataFrame([(0.2, 0.2, 0.3, 0.3)], BOX)
    points = F.array(F.struct(F.lit(0.9).alias("x"), F.lit(0.1).alias("y"), F.lit(0.5).alias("conf")), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.01).alias("conf")))
    assert tuple(row.select(*g.grow(g.box(), points)).first()) == (0.2, 0.1, 0.9, 0.3)
    assert row.select(g.grid_cells(g.box()).alias("c")).first().c == [9, 10, 17, 18]


def test_pooled_needs_two_data_sets(spark):
    one = {c: 1 for c in rollup.SUMMED} | {c: 0.5 for c in rollup.AVERAGED} | {"motp": 0.25, "ds_key": "a", "test_key": "t", "grp": None}
    schema = ", ".join([*(f"{c} long" for c in rollup.SUMMED), *(f"{c} double" for c in rollup.AVERAGED), "motp double", "ds_key string", "test_key string", "grp string"])
    single = spark.createDataFrame([one], schema)
    assert rollup.pooled(single).count() == 0
    both = rollup.pooled(spark.createDataFrame([one, one | {"ds_key": "b"}], schema)).collect()
    assert [(r.ds_key, r.num_objects, r.fp_tracks_frac) for r in both] == [("_overall", 2, 0.5)]


def test_latest_and_work_list(spark):
    done = spark.createDataFrame([("a", "t", "h", "mota", 0.1, 1), ("a", "t", "h", "mota", 0.2, 2)], "ds_key string, test_key string, config_hash string, metric string, value double, computed_at long")
    assert rollup.latest(done).first().value == 0.2


def test_coordinate_descent_finds_the_top():
    space = {"a": {"min": -10, "max": 10, "step": 0.5, "initial": -3}, "b": {"min": 0, "max": 4, "step": 0.5, "initial": 4}}
    asked = []

    def evaluate(vectors):
        asked.extend(tuple(v.values()) for v in vectors)
        return [-((v["a"] - 2) ** 2) - (v["b"] - 1) ** 2 for v in vectors]

    vector, value = sweep.coordinate_descent(space, evaluate)
    assert vector == {"a": 2, "b": 1} and value == 0
    assert len(asked) == len(set(asked)) and all(0 <= b <= 4 for _, b in asked)
    with pytest.raises(ValueError):
        sweep.search_space({"a": {"min": 0, "max": 1, "step": 1}}, {"a": 3})


SPACE = {"a": {"min": -5, "max": 5, "step": 0.25, "initial": 0}, "b": {"min": 0, "max": 4, "step": 0.5, "initial": 4}, "c": {"min": 0, "max": 1, "step": 0.125, "initial": 0.5}}


def hill(v):
    return -((v["a"] - 2) ** 2) - (v["b"] - 1) ** 2 - abs(v["c"] - 0.125) * (1 + v["b"])


def test_search_goes_on_where_it_stopped(spark, tmp_path):
    """The walk of coordinate_descent, stopped by its rounds, then by a failure, then to its end; no vector is scored twice."""
    asked, calls = [], []

    def evaluate(candidates):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        rows = candidates.collect()
        asked.extend(tuple(sorted(r.vector.items())) for r in rows)
        scores = [(r.candidate, s, hill(r.vector) - (s == "validation")) for r in rows for s in ("train", "validation", "test")]
        return spark.createDataFrame(scores, "candidate string, split string, score double")

    path = f"{tmp_path}/search"
    assert sweep.search(spark, path, SPACE, evaluate, most_rounds=2).agg(F.max("round")).first()[0] == 1
    with pytest.raises(RuntimeError):
        sweep.search(spark, path, SPACE, evaluate)
    state = sweep.search(spark, path, SPACE, evaluate)
    done = len(calls)
    again = sweep.search(spark, path, SPACE, evaluate)
    assert len(calls) == done and again.count() == state.count() and len(asked) == len(set(asked))
    vector, value = sweep.coordinate_descent(SPACE, lambda vs: [hill(v) for v in vs])
    top = sweep.best_vectors(state).first()
    assert top.vector == vector and top.train == value and top.validation == value - 1
    assert {r.split for r in state.select("split").distinct().collect()} == {"train", "validation"}
    assert all(SPACE[n]["min"] <= x <= SPACE[n]["max"] for v in asked for n, x in v)


def test_sweep_of_splits_equals_sweeps_of_their_sequences(spark):
    rows = spark.createDataFrame(moving_boxes(2, 30), DETECTIONS)
    frames, found = rows.select("seq_id", "frame_idx", "frame_time").distinct(), rows.filter("conf IS NOT NULL")
    truth = found.withColumn("traj_id", F.round((F.col("x1") - 0.002 * F.col("frame_idx")) * 5).cast("long"))
    splits = spark.createDataFrame([(0, "train"), (1, "validation"), (0, "all"), (1, "all")], "seq_id long, split string")
    tries = spark.createDataFrame([("x", {"new_traj_thr": 0.3}), ("y", {"new_traj_thr": 0.8})], "candidate string, vector map<string, double>")
    scores = {(r.candidate, r.split): r.score for r in sweep.evaluator(frames, found, truth, ["seq_id"], splits)(tries).collect()}
    assert len(scores) == 6 and len(set(scores.values())) > 2
    for split, some in (("train", "seq_id = 0"), ("validation", "seq_id = 1"), ("all", "true")):
        one = sweep.sweep({"x": {"new_traj_thr": 0.3}}, frames.filter(some), found.filter(some), truth.filter(some), ["seq_id"]).first()
        assert scores["x", split] == pytest.approx(one.fitness)


def test_results_reports_and_search_logs_are_written(spark, tmp_path):
    results = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 2.0)], "ds_key string, test_key string, mota double")
    marked = spark.createDataFrame([("b", True), ("a", False)], "ds_key string, no_cache boolean")
    for _ in range(2):
        annotations.append_results(results, f"{tmp_path}/results", marked)
    assert rows_of(spark.read.parquet(f"{tmp_path}/results")) == [(("a"), 1.0, "t")] * 2
    annotations.write_report(results.orderBy("ds_key"), f"{tmp_path}/report")
    assert [p.read_text() for p in (tmp_path / "report").glob("*.csv")] == ["ds_key,test_key,mota\na,t,1.0\nb,t,2.0\n"]
    for k in range(2):
        annotations.search_log(spark.createDataFrame([(k, "v", 0.5, "train")], "iteration int, vector string, score double, split string"), f"{tmp_path}/log")
    assert sorted(r.iteration for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [0, 1]


def test_corpus_is_converted(spark, tmp_path):
    folder = tmp_path / "mot" / "S1"
    (folder / "gt").mkdir(parents=True)
    (folder / "seqinfo.ini").write_text("[Sequence]\nname=S1\nimDir=img1\nframeRate=10\nseqLength=4\nimWidth=100\nimHeight=200\nimExt=.jpg\n")
    (folder / "gt" / "gt.txt").write_text("1,7,10,20,30,40,1,1,1\n2,7,11,20,30,40,0,4,1\n")
    annotations.convert_mot(spark, str(tmp_path / "mot"), str(tmp_path / "out"))
    read = annotations.read_native(spark, f"{tmp_path}/out/file=S1/*.txt", large=True)
    assert read[1].count() == 3 and sorted((r.frame_idx, r.class_id, r.x1) for r in read[2].collect()) == [(0, 0, 0.1), (1, 1, 0.11)]


def test_labels_collected_from_a_table(spark):
    rows = spark.createDataFrame([(0, "people", 1.0, 1.0, 10.0, 20.0), (1, "person", 11.0, 21.0, 10.0, 20.0), (2, "bike", 1.0, 1.0, 50.0, 50.0)], "k long, label string, left double, top double, width double, height double").withColumns({"im_width": F.lit(100), "im_height": F.lit(200)})
    found = {r.label: (r.class_id, r.x1, r.y2) for r in annotations.normalise_boxes(rows).collect()}
    assert found == {"person": (0, 0.1, 0.2), "bike": (1, 0.0, 0.25), "people": (2, 0.0, 0.1)}
    assert {r.class_id for r in annotations.normalise_boxes(rows, ["people", "person"]).collect()} == {0, 1, -1}


def test_registry_and_small_columns(spark):
    assert associate.associator("kalman_iou") is associate.associate
    row = spark.range(1).select(labels.seconds_ago(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:01:30").cast("timestamp")).alias("s"), *(c.alias(n) for c, n in zip(g.corner_form((F.lit(5.0), F.lit(6.0), F.lit(0.5), F.lit(4.0))), "abcd", strict=True))).first()
    assert row.s == 90 and (row.a, row.b, row.c, row.d) == (4.0, 4.0, 6.0, 8.0)


def test_selectors_stand_in_for_thresholds(spark):
    """A predicate over columns equals the threshold it is written for; another leaves detections out of the passes."""
    rows = spark.createDataFrame(moving_boxes(3, 45), DETECTIONS)
    frames, found = rows.select("seq_id", "frame_idx", "frame_time").distinct(), rows.filter("conf IS NOT NULL").withColumn("good", F.col("x1") < 0.5)
    run = lambda **more: rows_of(associate.associate(frames, found, ["seq_id"], **more).select("seq_id", "frame_idx", "conf", "x1"))
    plain = run()
    same = {name: F.col("conf") > associate.PARAMS[f"traj_{name}_thr"] for name in associate.PASSES}
    assert run(selectors=same) == plain and run(trajectory_selectors={"initial": lambda t: t.state != associate.LOST}) == plain
    best = run(selectors={name: c & F.col("good") for name, c in same.items()}, params={"new_traj_thr": 0.3})
    assert best != plain
    walks = {r.traj_id: r.n for r in associate.associate(frames, found.filter("NOT good"), ["seq_id"], selectors={name: F.lit(False) for name in associate.PASSES}).groupBy("traj_id", "seq_id").agg(F.count("*").alias("n")).collect()}
    assert walks and max(walks.values()) <= 2  # nothing is matched: each goes after its first frame without a match


# --- regions ahead


def test_parts_go_into_regions_and_back(spark):
    rows = spark.createDataFrame([(0, 0, [0.2, 0.3, 0.4, 0.6], [[0.25, 0.5], [0.3, 0.4]], None, 0.2, 0.3, 0.4, 0.6), (0, 1, None, [], [[0.5, 0.5]], 0.1, 0.1, 0.2, 0.2)], f"seq_id long, frame_idx long, subbox array<double>, pose_pos array<array<double>>, face_pos array<array<double>>, {BOX}")
    regions = spark.createDataFrame([(0, 0, 0.1, 0.2, 0.6, 0.7)], f"seq_id long, frame_idx long, {BOX}")
    keys = ["seq_id", "frame_idx"]
    inner = frames_ops.map_parts(rows, regions, keys)
    assert inner.columns == rows.columns
    first = inner.filter("frame_idx = 0").first()
    assert first.subbox == pytest.approx([0.2, 0.2, 0.6, 0.8]) and first.pose_pos[0] == pytest.approx([0.3, 0.6]) and first.face_pos is None
    assert rows_of(frames_ops.unmap_parts(inner, regions, keys)) == rows_of(rows)  # without a region they stay


def test_predictions_equal_those_of_a_plain_walk(spark):
    """The boxes that a plain walk over the frames has before each of them, and their union with the motion."""
    rows = moving_boxes(8, 30)
    whole = spark.createDataFrame(rows, DETECTIONS)
    frames = whole.select("seq_id", "frame_idx", "frame_time").distinct().withColumns({"gw": F.lit(2), "gh": F.lit(2), "field_dx": F.array(*map(F.lit, [0.01, 0.0, 0.02, 0.0])), "field_dy": F.array(*[F.lit(-0.01)] * 4)})
    found = associate.predict(frames, whole.filter("conf IS NOT NULL"), ["seq_id"]).collect()
    field, want = (2, 2, np.array([0.01, 0.0, 0.02, 0.0]), np.full(4, -0.01)), {}
    for seq in range(2):
        walk = associate.Associator()
        for frame in range(20):  # up to the gap, where a new part begins
            own = [r for r in rows if r[:2] == (seq, frame) and r[4] is not None]
            time = frame / 8
            for t in walk.trajectories:
                want[seq, frame, t.number] = (*t.box, *associate.moved_boxes(t.box[None], field)[0], *t.filter.predicted(time))
            walk.step(time, np.array([r[5:] for r in own]).reshape(-1, 4), np.array([r[4] for r in own]), np.zeros(len(own), int), None, field)
    told = {(r.seq_id, r.frame_idx, r.traj_id): tuple(r)[4:] for r in found if r.frame_idx < 20}
    assert told.keys() == want.keys() and all(told[k] == pytest.approx(want[k]) for k in want)
    ahead = spark.createDataFrame(found)
    motion = spark.createDataFrame([(0, 5, 0.9, 0.95, 0.97, 0.99), (7, 0, 0.5, 0.5, 0.51, 0.9)], f"seq_id long, frame_idx long, {BOX}")
    regions = {(r.seq_id, r.frame_idx): tuple(r)[2:] for r in frames_ops.regions_ahead(ahead, motion, ["seq_id", "frame_idx"], 0.5).collect()}
    assert regions[7, 0] == pytest.approx((0.4875, 0.4, 0.5225, 1.0))  # a width of 0.05 at least, within the frame
    boxes_ = np.array([b for k, v in want.items() if k[:2] == (0, 5) for b in (v[4:8], v[8:])] + [(0.9, 0.95, 0.97, 0.99)])
    low, high = boxes_[:, :2].min(axis=0), boxes_[:, 2:].max(axis=0)
    assert regions[0, 5] == pytest.approx((*np.clip(low - (high - low) / 4, 0, 1), *np.clip(high + (high - low) / 4, 0, 1)))


# --- appending


def test_appended_frames_are_later_than_all_before(spark, tmp_path):
    """Late and equal times in their own table, whichever batch they come in; a batch that is given again adds nothing."""
    from trajlake.sources import append

    ddl, path, told = "seq_id long, frame_idx long, frame_time double", str(tmp_path / "t"), []
    batches = [[(0, 0, 0.0), (0, 1, 1.0), (0, 2, 0.5), (None, 0, 3.0)], [(0, 3, 1.0), (0, 4, 2.0), (1, 0, 0.1), (None, 1, 2.0), (0, 5, None)], [(0, 6, 2.0), (0, 7, 2.5), (1, 1, 0.1), (1, 2, 0.2), (1, 2, 0.2)]]
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        append.append_frames(stream, path, f"{tmp_path}/c", ["seq_id"], callback=lambda b, a, r: told.append((b, a.count(), r.count())), availableNow=True).awaitTermination()
    assert told == [(0, 3, 1), (1, 2, 3), (2, 2, 3)]
    before = [rows_of(append.appended(spark, path, n)) for n in ("accepted", "rejected")]
    append.append_batch(spark.createDataFrame(batches[2], ddl), 2, path, ["seq_id"])
    assert [rows_of(append.appended(spark, path, n)) for n in ("accepted", "rejected")] == before
    assert sorted((r.seq_id, r.frame_idx) for r in append.appended(spark, path).collect() if r.seq_id is not None) == [(0, 0), (0, 1), (0, 4), (0, 7), (1, 0), (1, 2)]


def test_mot_files(spark, tmp_path):
    folder = tmp_path / "S1"
    (folder / "gt").mkdir(parents=True)
    (folder / "seqinfo.ini").write_text("[Sequence]\nname=S1\nimDir=img1\nframeRate=10\nseqLength=4\nimWidth=100\nimHeight=200\nimExt=.jpg\n")
    (folder / "gt" / "gt.txt").write_text("1,7,10,20,30,40,1,1,1\n2,7,11,20,30,40,0,4,1\n4,8,1,2,3,4,1,9,1\n")
    sequences, frames, objects = annotations.read_mot(spark, str(tmp_path))
    assert sequences.first().classes == ["person", "vehicle", "other"]
    assert [(r.frame_idx, r.frame_time, r.image_path[-14:]) for r in frames.orderBy("frame_idx").collect()] == [(0, 0.0, "mg1/000001.jpg"), (1, 0.1, "mg1/000002.jpg"), (2, 0.2, "mg1/000003.jpg")]
    found = [(r.frame_idx, r.traj_id, r.class_id, r.conf, r.x1, r.y2) for r in objects.orderBy("frame_idx").collect()]
    assert found == [(0, 7, 0, 1.0, 0.1, 0.3), (1, 7, 1, 1.0, 0.11, 0.3)]


def test_native_round_trip(spark, tmp_path):
    sequences = spark.createDataFrame([("a b", 25.0, 64, 48, ["person"])], "seq string, frame_rate double, width int, height int, classes array<string>")
    frames = spark.createDataFrame([("a b", 0, 0.0, True, None), ("a b", 1, 0.04, False, None), ("a b", 2, 0.08, True, "p")], "seq string, frame_idx long, frame_time double, tracked boolean, image_path string")
    objects = spark.createDataFrame([("a b", 0, 5, 0, 0.5, 0.0, 0.1, 0.2, 0.3)], f"seq string, frame_idx long, traj_id long, class_id int, conf double, {BOX}")
    text = annotations.native_documents(sequences, frames, objects).first()
    assert text.file == "a-b"
    (tmp_path / "a-b.json").write_text(text.document)
    s, f, o, d, r = annotations.read_native(spark, f"{tmp_path}/*.json")
    assert s.first().width == 64
    assert rows_of(f.select("frame_idx", "frame_time", "tracked")) == rows_of(frames.select("frame_idx", "frame_time", "tracked"))
    assert rows_of(o.select("traj_id", "conf", "x1", "y1", "x2", "y2")) == rows_of(objects.select("traj_id", "conf", "x1", "y1", "x2", "y2"))
    assert d.count() == r.count() == 0


def test_large_files_are_written_in_lines_and_read_in_parts(spark, tmp_path):
    """Braces, quotes and backslashes in strings; blocks of 600 bytes, so that frames and strings lie across them."""
    hard = ["p", '}{"', "\\", '\\"}', "{[", "é}}", None]
    sequences = spark.createDataFrame([("a b", 25.0, 64, 48, ["per}son", '"{']), ("c", 5.0, 6, 4, [])], "seq string, frame_rate double, width int, height int, classes array<string>")
    frames = spark.createDataFrame([(s, k, k / 25, k % 5 != 3, hard[k % len(hard)]) for s, n in (("a b", 60), ("c", 3)) for k in range(n)], "seq string, frame_idx long, frame_time double, tracked boolean, image_path string")
    objects = spark.createDataFrame([("a b", k, t, 0, 0.5, 0.0, 0.1, 0.2, k / 64) for k in range(60) if k % 5 != 3 for t in range(k % 4)], f"seq string, frame_idx long, traj_id long, class_id int, conf double, {BOX}")
    annotations.write_native(sequences, frames, objects, f"{tmp_path}/out")
    written = {p.parent.name[5:]: p for p in (tmp_path / "out").rglob("*.txt")}
    documents = {r.file: r.document for r in annotations.native_documents(sequences, frames, objects).collect()}
    assert {k: p.read_text().replace("\n", "") for k, p in written.items()} == documents
    (tmp_path / "in").mkdir()
    for k, text in documents.items():  # in one line, and spread over many
        (tmp_path / "in" / f"{k}.json").write_text(text)
        (tmp_path / "in" / f"{k}-spread.json").write_text(written[k].read_text())
    block = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        from trajlake.sources.split_json import top_objects

        assert spark.read.option("lineSep", "}").text(f"{tmp_path}/in/*.json").rdd.getNumPartitions() > 20
        parts = annotations.read_native(spark, f"{tmp_path}/in/*.json", large=True)
        assert top_objects(spark, f"{tmp_path}/in/c.json").count() == 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    for found, whole in zip(parts, annotations.read_native(spark, f"{tmp_path}/in/*.json"), strict=True):
        assert found.columns == whole.columns and rows_of(found) == rows_of(whole)
    assert parts[2].count() == 2 * objects.count()


# --- events where a frame leaves a choice


def brute_events(pairs):
    """Frame by frame: last partners first, then of all one-to-one choices the largest, and of these the nearest."""
    last, out = {}, []
    for frame in sorted({f for f, *_ in pairs}):
        near = {(o, h): d for f, o, h, d in pairs if f == frame}
        taken = {}
        for o in sorted({o for o, _ in near}):
            if (o, last.get(o)) in near and last[o] not in taken.values():
                taken[o] = last[o]
        rest = [(o, h) for o, h in near if o not in taken and h not in taken.values()]
        choices = [c for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if len({o for o, _ in c}) == len(c) == len({h for _, h in c})]
        best = min(choices, key=lambda c: (-len(c), sum(near[x] for x in c)))
        for o, h in {**taken, **dict(best)}.items():
            out.append((frame, "SWITCH" if last.get(o, h) != h else "MATCH", o, h))
            last[o] = h
    return sorted(out)


def test_ambiguous_frames_equal_brute_force(spark):
    r = np.random.default_rng(11)
    rows, want = [], []
    for seq in range(4):
        pairs = []
        for f in range(12):
            for o in range(4):
                for h in range(4):
                    if r.random() < (0.3 if seq else 0.0) or (o == h and seq == 0):
                        pairs.append((f, o, 10 + h, float(r.random() * 0.4)))
        rows += [(seq, *x) for x in pairs]
        want += [(seq, *x) for x in brute_events(pairs)]
    df = spark.createDataFrame(rows, "seq_id long, frame_idx long, oid long, hid long, d double")
    found = clearmot.matches(df, ["seq_id"]).select("seq_id", "frame_idx", "type", "oid", "hid").collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_labels_of_the_nearest_frame(spark):
    objects = spark.createDataFrame([(0, 0.24, 1), (0, 0.26, 1), (0, 0.9, 2)], "seq_id long, frame_time double, traj_id long")
    log = spark.createDataFrame([(0, 0, "MATCH", 1, 10), (0, 1, "SWITCH", 1, 11), (0, 1, "FP", None, 12)], "seq_id long, frame_idx long, type string, oid long, hid long")
    frames = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.5)], "seq_id long, frame_idx long, frame_time double")
    found = clearmot.label_objects(objects, log, frames, ["seq_id"], "oid").collect()
    assert sorted((r.frame_time, r.traj_id, r.label) for r in found) == [(0.24, 1, "OK"), (0.26, 1, "SW"), (0.9, 2, None)]


# --- all parts of an object


def test_interpolation_of_parts(spark):
    kinds = "subbox: array<double>, subbox_conf: double, pose_pos: array<array<double>>, pose_conf: array<double>, face_pos: array<array<double>>, face_conf: array<double>, face_jpeg: string, clip_jpeg: string, face_embedding: string, clip_embedding: string"

    def side(sub=None, pose=0, face=0, name="l"):
        at = 1.0 if name == "l" else 3.0
        points = lambda n: [[at, at]] * n
        return (sub and [sub] * 4, sub, points(pose), [0.5] * pose, points(face), [0.5] * face, name, name, name, name)

    cases = [
        (0.25, side(1.0, 2, 5), side(3.0, 2, 5, "r"), (1.5, 1.5, [[1.5, 1.5]] * 2, [0.25] * 2, [[1.5, 1.5]] * 5, "l")),
        (0.75, side(1.0, 2, 5), side(None, 1, 0, "r"), (None, None, [[1.0, 1.0]] * 2, [0.5] * 2, [[1.0, 1.0]] * 5, "r")),
        (0.25, side(None, 0, 5), side(3.0, 1, 4, "r"), (None, None, [[3.0, 3.0]], [0.5], [[1.0, 1.0]] * 5, "l")),
        (0.5, side(None, 0, 0), side(3.0, 0, 4, "r"), (3.0, 3.0, [], [], [[3.0, 3.0]] * 4, "r")),
    ]
    df = spark.createDataFrame([(k, f, a, b) for k, (f, a, b, _) in enumerate(cases)], f"k int, share double, a struct<{kinds}>, b struct<{kinds}>")
    parts = timegrid.interpolated_parts(F.col("a"), F.col("b"), F.col("share"))
    for r in df.select("k", *(c.alias(n) for n, c in parts.items())).collect():
        sub, sub_conf, pose, conf, face, name = cases[r.k][3]
        assert (r.subbox and r.subbox[0], r.subbox_conf, r.pose_pos, r.pose_conf, r.face_pos) == (sub, sub_conf, pose, conf, face), r
        assert {r.face_jpeg, r.clip_jpeg, r.face_embedding, r.clip_embedding} == {name}


def test_objects_with_parts_are_interpolated(spark):
    frames = spark.createDataFrame([(0, 0, 0.0, True), (0, 1, 1.0, True)], "seq long, frame_idx long, frame_time double, tracked boolean")
    schema = f"seq long, frame_idx long, traj_id long, class_id int, conf double, {BOX}, subbox array<double>, subbox_conf double, pose_pos array<array<double>>, pose_conf array<double>, face_pos array<array<double>>, face_conf array<double>, face_jpeg string, clip_jpeg string, face_embedding string, clip_embedding string"
    objects = spark.createDataFrame([(0, f, 7, 0, 1.0, float(f), 0.0, 2.0, 2.0, [float(f)] * 4, 0.5, None, None, None, None, "p", None, None, None) for f in (0, 1)], schema)
    r = timegrid.objects_at(spark.createDataFrame([(0, 0.5)], "seq long, t double"), frames, objects, ["seq"]).first()
    assert r.x1 == pytest.approx(0.5, abs=1e-6) and r.subbox == pytest.approx([0.5] * 4, abs=1e-6) and (r.face_jpeg, r.pose_pos, r.subbox_conf) == ("p", None, 0.5)


def test_all_parts_are_written_and_read(spark, tmp_path):
    sequences = spark.createDataFrame([("s", 10.0, ["person"])], "seq string, frame_rate double, classes array<string>")
    frames = spark.createDataFrame([("s", 0, 0.0, True, None)], "seq string, frame_idx long, frame_time double, tracked boolean, image_path string")
    objects = spark.createDataFrame(
        [("s", 0, 4, 0, 0.5, 0.1, 0.2, 0.3, 0.4, [[1.0, 2.0]], [0.5], [0.25], [0.0, 0.1, 0.2, 0.3], 0.75, (1.0, bytearray(b"\x00\xff")), (1.0, 0.5, [1.0, 2.0]))],
        f"seq string, frame_idx long, traj_id long, class_id int, conf double, {BOX}, pose_pos array<array<double>>, pose_conf array<double>, attr array<double>, subbox array<double>, subbox_conf double, face_jpeg struct<time: double, data: binary>, face_embedding struct<time: double, quality: double, data: array<float>>",
    )
    annotations.native_documents(sequences, frames, objects).select("document").coalesce(1).write.text(f"{tmp_path}/out")
    (file,) = (tmp_path / "out").glob("*.txt")
    file.rename(tmp_path / "s.json")
    r = annotations.read_native(spark, f"{tmp_path}/s.json")[2].first()
    assert r.pose_pos == [[1.0, 2.0]] and (r.pose_conf, r.attr, r.subbox, r.subbox_conf) == ([0.5], [0.25], [0.0, 0.1, 0.2, 0.3], 0.75)
    assert bytes(r.face_jpeg.data) == b"\x00\xff" and r.face_embedding.data == [1.0, 2.0] and r.clip_jpeg is None and r.face_pos is None


def test_detection_needs_a_whole_id(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "i double").select(g.detection((F.lit(0.0),) * 4, F.lit(0), F.lit(1.0), F.col("i")).alias("d"))
    assert [r.d.traj_id for r in df.collect()] == [1, None]
    bad = spark.createDataFrame([(1.5,)], "i double").select(g.detection((F.lit(0.0),) * 4, F.lit(0), F.lit(1.0), F.col("i")).alias("d"))
    with pytest.raises(Exception, match="whole id"):
        bad.collect()


# --- the association's score


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0, w) * max(0, h)
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / whole if whole > 0 else 0.0


def test_scores_equal_plain_loops():
    r = np.random.default_rng(4)
    p = associate.PARAMS | {"sim_weight": 0.3, "kp_distance_scale": 2.0}
    field = (8, 8, r.uniform(-0.05, 0.05, 64), r.uniform(-0.05, 0.05, 64))

    def shift(x, y):
        at = min(7, max(0, int(y * 8 + 0.5))) * 8 + min(7, max(0, int(x * 8 + 0.5)))
        return field[2][at], field[3][at]

    def moved_box(b):
        found = [(w, shift(b[0] * x + b[2] * (1 - x), b[1] * y + b[3] * (1 - y))) for x, y, w in motion.SAMPLES]
        dx, dy = (sum(w * d[k] for w, d in found) for k in (0, 1))
        return [min(1, max(0, v)) for v in (b[0] - dx, b[1] - dy, b[2] - dx, b[3] - dy)]

    def thing(k):
        x, y = r.uniform(0.3, 0.45, 2)
        pose = np.concatenate([[x + r.uniform(0, 0.2), y + r.uniform(0, 0.2), r.choice([0.0, 0.04, 0.6])] for _ in range(17)]).tolist()
        return np.array([x, y, x + 0.2, y + 0.3]), {"subbox": None if k % 3 == 0 else [x, y, x + 0.1, y + 0.1], "pose": None if k % 4 == 1 else pose, "reid": None if k % 5 == 2 else r.normal(size=4).tolist(), "attr": None}

    news, olds = [thing(k) for k in range(6)], []
    for k in range(5):
        box, parts = thing(k + 1)
        one = associate.Trajectory(k, box, 0.5, 0, associate.TRACKED, motion.BoxFilter(associate.measured(box), 0.0), 0.0, observations=k + 1, parts=parts)
        one.filter.update(associate.measured(box + 0.01), 0.1)
        olds.append(one)
    associator = associate.Associator(p)
    vectors = [x["reid"] for x in [*(n[1] for n in news), *(t.parts for t in olds)] if x["reid"] is not None]
    associator.mean = np.mean(vectors, axis=0)
    confs = r.uniform(0.2, 1, 6)
    parts = {k: [n[1][k] for n in news] for k in associate.EXTRAS}
    found = associator.scores(np.array([n[0] for n in news]), confs, parts, olds, 0.2, 0.3, field)
    for i, (box, new) in enumerate(news):
        for j, t in enumerate(olds):
            flow, points = moved_box(t.box), None
            if t.parts["pose"]:
                flat = t.parts["pose"]
                points = [(*(min(1, max(0, v - d)) for v, d in zip(flat[3 * q : 3 * q + 2], shift(flat[3 * q], flat[3 * q + 1]), strict=True)), flat[3 * q + 2]) for q in range(17)]
                for x, y, c in points:
                    if c > 0.05:
                        flow = [min(flow[0], x), min(flow[1], y), max(flow[2], x), max(flow[3], y)]
            seen, kf = overlap(box, flow), overlap(box, t.filter.predicted(0.2))
            if new["subbox"] and t.parts["subbox"]:
                seen += p["face_weight"] * overlap(new["subbox"], moved_box(t.parts["subbox"]))
            weight = 0 if t.observations < 2 else p["kf_weight"] * (1 - max(0.1, 1 / t.observations) ** p["kf_warmup"])
            score, divisor = seen + kf * weight, 1 + weight
            if new["pose"] and points and seen + kf != 0:
                area = 0.5 * ((box[2] - box[0]) * (box[3] - box[1]) + (flow[2] - flow[0]) * (flow[3] - flow[1])) * 0.53 * p["kp_distance_scale"] ** 2
                near = [math.exp(-((new["pose"][3 * q] - x) ** 2 + (new["pose"][3 * q + 1] - y) ** 2) / (2 * area * (2 * associate.SIGMAS[q]) ** 2 + 1e-7)) for q, (x, y, c) in enumerate(points) if c > 0 and new["pose"][3 * q + 2] > 0]
                if len(near) > 4:
                    score, divisor = score + p["kp_weight"] * sum(near) / (len(near) + 1e-7), divisor + p["kp_weight"]
            score /= divisor
            if new["reid"] and t.parts["reid"]:
                a, b = (np.array(v) - associator.mean for v in (new["reid"], t.parts["reid"]))
                score += p["sim_weight"] * float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
            assert found[i, j] == pytest.approx(0 if score < 0.3 else score * confs[i] ** p["fuse_scores"], abs=1e-9), (i, j)
    assert (found > 0).any() and (found == 0).any()


def test_parts_go_along_with_trajectories(spark):
    frames = spark.createDataFrame([(0, f, f / 10) for f in range(3)], "seq_id long, frame_idx long, frame_time double")
    rows = [(0, f, 0, 0.9, 0.1, 0.1, 0.3, 0.5, [float(f)], [1.0, float(f)]) for f in range(3)]
    det = spark.createDataFrame(rows, f"seq_id long, frame_idx long, class_id int, conf double, {BOX}, attr array<double>, reid array<double>")
    found = associate.associate(frames, det, ["seq_id"]).orderBy("frame_idx").collect()
    assert [r.attr for r in found] == [[0.0], pytest.approx([0.9]), pytest.approx([1.89])]
    assert [r.reid[1] for r in found] == [0.0, 0.5, 1.25] and len({r.traj_id for r in found}) == 1
    none = associate.associate(frames, det, ["seq_id"], blocking=lambda a, b: np.zeros((len(a), len(b)), bool)).select("traj_id").distinct().count()
    plugged = associate.associate(frames, det, ["seq_id"], pair_score=lambda self, boxes, confs, parts, olds, *rest: np.ones((len(boxes), len(olds))))
    assert none == 3 and plugged.select("traj_id").distinct().count() == 1


def test_measures_by_class(spark):
    """Two runs: one with enough detections and objects of one class only, one with too few detections."""
    r = np.random.default_rng(7)
    hits = [(0, 0, k, float(c), int(t)) for k, (c, t) in enumerate(zip(r.random(200) ** 2, r.random(200) < 0.6, strict=True))]
    hits += [(0, 1, 900, 0.5, 1), (0, 7, 901, 0.9, 0), *((1, 0, k, 0.5, 1) for k in range(5))]
    matched = spark.createDataFrame(hits, "run long, class_id int, det_id long, conf double, tp int")
    truth = spark.createDataFrame([(0, 0)] * 150 + [(0, 1)] * 4 + [(1, 0)] * 20, "run long, class_id int")
    found = {(x.run, x.class_name): x for x in detection.class_measures(matched, truth, ["run"], ["person", "face"], ["det_id"]).collect()}
    assert {k: x.n_objects for k, x in found.items()} == {(0, "person"): 150, (0, "face"): 4, (1, "person"): 20, (1, "face"): 0}
    assert all(x.ap is None and x.p_th25 is None for k, x in found.items() if k != (0, "person"))
    own, x = [h for h in hits if h[:2] == (0, 0)], found[0, "person"]
    for t in (25, 30):
        some = [h for h in own if h[3] * 999 >= t * 10]
        assert x[f"p_th{t}"] == pytest.approx(sum(h[4] for h in some) / len(some)) and x[f"r_th{t}"] == pytest.approx(sum(h[4] for h in some) / 150)
    n = spark.createDataFrame([(0, 150), (2, 3)], "run long, n_objects long")
    axis = {(a.run, a.k): (a.precision, a.recall) for a in detection.confidence_axis(matched.filter("class_id = 0"), n, ["run"], 50).collect()}
    assert len(axis) == 100 and axis[2, 0] == (1.0, 0.0)
    for k in range(50):
        some = [h for h in own if h[3] * 49 >= k]
        assert axis[0, k] == (pytest.approx(sum(h[4] for h in some) / len(some)) if some else 1.0, pytest.approx(sum(h[4] for h in some) / 150))


# --- streams


def replay(spark, tmp_path, batches, run):
    for batch in batches:
        spark.createDataFrame(batch, "seq_id long, frame_idx long, frame_time double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("seq_id long, frame_idx long, frame_time double").parquet(f"{tmp_path}/in")
        run(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.frame_idx, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_late_rows_are_counted_not_used(spark, tmp_path):
    batches = [[(0, 0, 0.0), (0, 2, 2.0)], [(0, 1, 1.0), (0, 3, 3.0)]]
    assert replay(spark, tmp_path, batches, lambda s: online.rate_limited(s, 0.5)) == [(0, 0), (2, 0), (3, 1)]


def test_rows_wait_for_the_watermark(spark, tmp_path):
    batches = [[(0, 0, 0.0), (0, 2, 2.0)], [(0, 1, 1.0), (0, 9, 9.0)], [(0, 4, 4.0), (0, 20, 20.0)], [(0, 21, 21.0)]]
    found = replay(spark, tmp_path, batches, lambda s: online.rate_limited(s, 0.5, delay=3.0))
    assert found == [(0, 0), (1, 0), (2, 0), (9, 0)]  # 4 came behind the watermark; 20 and 21 still wait


def moving_boxes(seed, frames=50):
    """(seq, frame, time, class, conf, box) of two sequences; some frames have no detections, and one gap ends all."""
    random, rows = np.random.default_rng(seed), []
    for seq in range(2):
        for frame in range(frames):
            some = [k for k in range(4) if random.random() < 0.8 and not 20 <= frame < 33]
            found = [(seq, frame, frame / 8, 0, float(random.uniform(0.2, 1)), *(np.array([0.2 * k, 0.2, 0.2 * k + 0.1, 0.5]) + frame * 0.002 + random.normal(0, 0.003, 4)).tolist()) for k in some]
            rows += found or [(seq, frame, frame / 8, None, None, None, None, None, None)]
    return rows


DETECTIONS = f"seq_id long, frame_idx long, frame_time double, class_id int, conf double, {BOX}"


def test_keyed_state_equals_the_batch(spark, tmp_path):
    """Three runs from one checkpoint, rows out of order within the delay; state counts entries and forgets what has ended."""
    rows = moving_boxes(4)
    whole = spark.createDataFrame(rows, DETECTIONS)
    names = ["seq_id", "frame_idx", "traj_id", "conf", "x1"]
    batch = associate.associate(whole.select("seq_id", "frame_idx", "frame_time").distinct(), whole.filter("conf IS NOT NULL"), ["seq_id"], split=False)
    jitter = np.random.default_rng(1).integers(0, 6, len(rows))
    shuffled = [rows[k] for k in np.argsort([r[1] + j for r, j in zip(rows, jitter, strict=True)], kind="stable")]
    cut, setting, sizes = len(rows) // 3, "spark.sql.streaming.stateStore.providerClass", []
    before = spark.conf.get(setting)
    with pytest.raises(ValueError):
        keyed.associate_keyed(whole)
    spark.conf.set(setting, keyed.PROVIDER)
    try:
        for part in (shuffled[:cut], shuffled[cut : 2 * cut], shuffled[2 * cut :], [(9, 0, 99.0, None, None, None, None, None, None)]):
            spark.createDataFrame(part, DETECTIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = keyed.associate_keyed(spark.readStream.schema(DETECTIONS).parquet(f"{tmp_path}/in"), delay=2.0, idle=5.0)
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            query.awaitTermination()
            sizes.append(keyed.state_size(query.lastProgress))
    finally:
        spark.conf.set(setting, before)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert rows_of(out.select(*names)) == rows_of(batch.select(*names)) and out.agg(F.max("late")).first()[0] == 0
    assert sizes[0]["entries"] > 10 and sizes[-1]["entries"] < sizes[0]["entries"]  # the last batch ended both sequences


def evaluated(spark, tmp_path, batches, **options):
    ddl = f"side string, seq_id long, frame_idx long, frame_time double, traj_id long, {BOX}"
    for batch in batches:
        spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        one = {s: stream.filter(F.col("side") == s) for s in ("object", "prediction", "tick")}
        log = online.events_stream(one["object"], one["prediction"], ticks=one["tick"], **options)
        log.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_streamed_log_equals_the_batch(spark, tmp_path):
    """Ambiguous frames, missing sides and rows out of order within the delay; the last batch comes after a restart each."""
    random, rows = np.random.default_rng(6), []
    for frame in range(60):
        for seq in range(2):
            left = random.permutation(5) * 6.0
            rows += [("object", seq, frame, frame / 4, t, x, 0.0, x + 10, 10.0) for t, x in enumerate(left[: random.integers(0, 5)].tolist())]
            rows += [("prediction", seq, frame, frame / 4, 50 + (t + frame // 20) % 5, x + float(random.integers(-3, 4)), 0.0, x + 10, 10.0) for t, x in enumerate(left[: random.integers(0, 5)].tolist())]
    ddl = f"side string, seq_id long, frame_idx long, frame_time double, traj_id long, {BOX}"
    whole = spark.createDataFrame(rows, ddl)
    batch = clearmot.events(whole.filter("side = 'object'"), whole.filter("side = 'prediction'"), ["seq_id"])
    ticks = [("tick", s, None, 99.0, None, None, None, None, None) for s in range(2)]
    jitter = random.integers(0, 8, len(rows))
    shuffled = [rows[k] for k in np.argsort([r[2] + j for r, j in zip(rows, jitter, strict=True)], kind="stable")]
    cut = len(rows) // 3
    log = evaluated(spark, tmp_path, [shuffled[:cut], shuffled[cut : 2 * cut], shuffled[2 * cut :] + ticks], delay=3.0)
    names = ["seq_id", "frame_idx", "type", "oid", "hid", "d"]
    assert rows_of(log.select(*names)) == rows_of(batch.select(*names))
    assert {r.type for r in log.select("type").collect()} == {"MATCH", "SWITCH", "MISS", "FP"} and log.agg(F.max("late")).first()[0] == 0


def test_open_frames_wait_and_late_rows_are_counted(spark, tmp_path):
    box = (0.0, 0.0, 10.0, 10.0)
    batches = [[("object", 0, 0, 0.0, 1, *box), ("object", 0, 8, 8.0, 1, *box)], [("prediction", 0, 0, 0.0, 7, *box), ("prediction", 0, 8, 8.0, 7, *box), ("tick", 0, None, 12.0, None, None, None, None, None)], [("tick", 0, None, 20.0, None, None, None, None, None)]]
    found = [(r.frame_idx, r.type, r.oid, r.hid) for r in evaluated(spark, tmp_path, batches, delay=2.0).orderBy("frame_idx").collect()]
    assert found == [(0, "MISS", 1, None), (8, "MATCH", 1, 7)]  # the prediction of frame 0 came behind the watermark


def test_silent_sequences_are_forgotten(spark, tmp_path):
    batches = [[(0, 0, 0.0)], [(1, 30, 30.0)], [(0, 1, 40.0)], [(1, 60, 60.0)]]
    found = replay(spark, tmp_path, batches, lambda s: online.rate_limited(s, 50.0, delay=1.0, idle=5.0))
    assert found == [(0, 0), (1, 0), (30, 0)]  # 1 lies under 50 s behind 0, but comes after a silence


def test_pieces_equal_whole_sequences(spark):
    random = np.random.default_rng(5)
    times = np.unique(np.round(np.concatenate([random.uniform(0, 20, 40), random.uniform(150, 420, 60), [64.0, 128.0, 192.0]]), 3))
    frames = spark.createDataFrame([(0, k, float(t), bool(k % 3)) for k, t in enumerate(times)], "seq_id long, frame_idx long, frame_time double, tracked boolean")
    ask = [-5.0, *np.round(random.uniform(-1, 500, 80), 3).tolist(), *times[::7].tolist()]
    grid = spark.createDataFrame([(0, float(t)) for t in ask], "seq_id long, t double")
    back = lambda t, rows: max((k for k in rows if times[k] <= t + 1e-7), default=None)
    ahead = lambda t, rows: min((k for k in rows if times[k] > t + 1e-7), default=None)
    every, tracked = range(len(times)), [k for k in range(len(times)) if k % 3]
    first = lambda *found: next(k for k in found if k is not None)
    assert {(r.t, r.frame_idx) for r in timegrid.asof(grid, frames, ["seq_id"]).collect()} == {(t, first(back(t, every), 0)) for t in ask}
    near = {(r.t, r.frame_idx) for r in timegrid.nearest(grid, frames, ["seq_id"]).collect()}
    assert near == {(t, min(every, key=lambda k: (abs(times[k] - t), k))) for t in ask}
    around = {(r.t, r.left_idx, r.right_idx) for r in timegrid.bracket(grid, frames, ["seq_id"]).collect()}
    wanted = set()
    for t in ask:
        left, right = first(back(t, tracked), 0), ahead(t, tracked)
        wanted.add((t, left, right if right is not None and right > left else len(times) - 1))
    assert around == wanted
    beside = {r.frame_idx: (r.previous_time, r.next_time) for r in timegrid.neighbours(frames, ["seq_id"]).collect()}
    assert beside == {k: (times[max(k - 1, 0)], times[min(k + 1, len(times) - 1)]) for k in every}
    assert {r.frame_idx for r in timegrid.every_nth(frames, ["seq_id"], 5).collect()} == set(range(4, len(times), 5))
    for interval in (0.0, 0.4, 7.0, 100.0):
        taken, last = [], -math.inf
        for t in times.tolist():
            if t - last >= interval:
                taken.append(t)
                last = t
        assert sorted(r.frame_time for r in timegrid.at_interval(frames, ["seq_id"], interval).collect()) == taken
    bent = frames.withColumn("frame_idx", F.col("frame_idx") * 100).withColumn("frame_time", F.when(F.col("frame_idx") % 2000 == 0, -1.0).otherwise(F.col("frame_time")))
    assert sorted(r.frame_idx for r in timegrid.out_of_order(bent, ["seq_id"]).collect()) == list(range(2000, 100 * len(times), 2000))


def test_pieces_without_rows(spark):
    frames = spark.createDataFrame([], "seq_id long, frame_idx long, frame_time double, tracked boolean")
    grid = spark.createDataFrame([(0, 1.0)], "seq_id long, t double")
    assert [r.frame_idx for r in timegrid.asof(grid, frames, ["seq_id"]).collect()] == [None]
    assert timegrid.at_interval(frames, ["seq_id"], 1.0).count() == timegrid.neighbours(frames, ["seq_id"]).count() == 0


def test_curve_and_blend_in_ranges(spark):
    random = np.random.default_rng(7)
    rows = [(c, k, float(random.integers(0, 4) / 4), int(random.integers(0, 2))) for c in (0, 1) for k in range(150)]
    matched = spark.createDataFrame(rows, "class_id long, det_id long, conf double, tp int").repartition(7)
    n = spark.createDataFrame([(0, 120), (1, 90)], "class_id long, n_objects long")
    found = {r.class_id: r.ap for r in detection.average_precision(detection.precision_recall(matched, n, ["class_id"], ["det_id"]), ["class_id"], ["det_id"]).collect()}
    for c, objects in ((0, 120), (1, 90)):
        hits = np.array([tp for _, _, tp in sorted((-conf, k, tp) for cc, k, conf, tp in rows if cc == c)])
        precision = np.cumsum(hits) / np.arange(1, len(hits) + 1)
        assert math.isclose(found[c], sum(precision[k:].max() * hits[k] / objects for k in range(len(hits))), abs_tol=1e-9)
    vectors = spark.createDataFrame([(c, k, [float(c + k % 5), float(k)]) for c in (0, 1) for k in range(90)], "label long, vec_id long, embedding array<double>")
    blends = {r.label: r.blend for r in frames_ops.running_embedding(vectors, ["label"], "embedding", "vec_id").collect()}
    listed = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])
    folded = {r.label: r.blend for r in vectors.groupBy("label").agg(running_blend(listed).alias("blend")).collect()}
    assert all(np.allclose(blends[c], folded[c], atol=1e-9) for c in (0, 1))
    for c in (0, 1):
        state = np.array([float(c), 0.0])
        for k in range(1, 90):
            state = 0.5 * state + 0.5 * np.array([c + k % 5, k])
        assert np.allclose(blends[c], state, atol=1e-9)
    before = {(r.label, r.vec_id): r.previous for r in frames_ops.with_previous(vectors, ["label"], "embedding", "vec_id").collect()}
    assert all(v == (None if k == 0 else [float(c + (k - 1) % 5), float(k - 1)]) for (c, k), v in before.items()) and len(before) == 180


def test_binary_rounding_keeps_the_sign_of_zero(spark):
    """What SQL's round gives for binary numbers; the product of the third is exactly half."""
    values = [-2e-7, 2e-7, 1.0000005, -1.0000005, 0.0, -0.0, 0.1234565, float("nan"), float("inf")]
    want = [math.copysign(math.floor(abs(v) * 1e6 + 0.5) / 1e6, v) if math.isfinite(v) else v for v in values]
    found = [r.r for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(vectors.rounded(F.col("v"), 6).alias("r")).collect()]
    assert list(map(str, found)) == list(map(str, want))
    assert str(found[0]) == "-0.0"


def crowded(random, frames):
    """Boxes of five lanes that move, leave their lane, go missing and have no height."""
    out = []
    for f in range(frames):
        n = int(random.integers(0, 7))
        out += [(f, f / 8, None, *[math.nan] * 5)] * (n == 0)
        for _ in range(n):
            x, y = random.integers(0, 5) * 0.14 + random.integers(-3, 4) / 64, 0.2 + random.integers(-2, 3) / 64
            out.append((f, f / 8, int(random.integers(0, 2)), random.integers(1, 64) / 64, x, y, x + 0.1 + random.integers(0, 3) / 64, y + (0.4 if random.random() > 0.01 else 0.0)))
    return pd.DataFrame(out, columns=associate.COLUMNS)


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("params", [{}, catalogue.LANES, {"delete_dup_iou": 0.3, "kf_weight": 1.3, "kf_warmup": 0.4}, {"fuse_scores": 1.0, "match_thr_low": 0.0, "delete_dup_iou": 0.0}, {"traj_buffer_seconds": 0.5, "match_thr_initial": 0.05, "match_thr_high": 0.05, "delete_dup_iou": 0.1}])
def test_plain_steps_equal_steps_by_arrays(params):
    """The same rows and predictions, bit by bit, as by step(), which a blocking that blocks nothing calls for."""
    rows = crowded(np.random.default_rng(len(params)), 300)
    tables = {}
    for name, blocking in (("plain", None), ("arrays", lambda a, b: np.ones((len(a), len(b)), bool))):
        walk, ahead = associate.Associator(associate.PARAMS | params, blocking=blocking), []
        found = [walk.frames(part, ahead) for _, part in rows.groupby(rows.frame_idx // 70)]
        tables[name] = pd.concat(found).to_numpy(float), pd.concat(ahead).to_numpy(float)
    assert all(np.array_equal(a, b, equal_nan=True) and len(a) > 100 for a, b in zip(tables["plain"], tables["arrays"], strict=True))


def test_small_assignment_has_the_steps_of_the_large_one():
    random = np.random.default_rng(3)
    for _ in range(300):
        cost = -random.integers(0, 4, random.integers(1, 7, 2)) / 4  # many ties
        assert assign_lists(cost.tolist()) == assign(cost)


def test_a_long_sequence_is_folded_batch_by_batch(spark):
    """Frames that lie across Arrow batches, two groups in a task, null keys: as whole tables, never more than a batch at once."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = crowded(np.random.default_rng(5), 200)
    table = [(s, *(None if isinstance(v, float) and math.isnan(v) else v for v in r)) for s in ("a", None) for r in rows.itertuples(index=False)]
    whole = spark.createDataFrame(table, f"seq string, frame_idx long, frame_time double, class_id double, conf double, {BOX}").withColumns({"class_id": F.col("class_id").cast("int"), "segment": F.lit(3).cast("long")})
    sizes = spark.sparkContext.accumulator(0)

    class Counted(associate.Associator):
        def frames(self, rows, ahead=None):
            if len(rows) > 13 + 7:
                sizes.add(1)
            return super().frames(rows, ahead)

    before = spark.conf.get(setting)
    spark.conf.set(setting, "13")
    try:
        found = associate.walked(whole, ["seq", "segment"], lambda _: Counted(dict(associate.PARAMS)), associate.COLUMNS, associate.OUT).collect()
    finally:
        spark.conf.set(setting, before)
    want = associate.Associator(dict(associate.PARAMS)).frames(rows)
    for seq in ("a", None):
        assert sorted(tuple(r)[1:] for r in found if r.seq == seq) == sorted((*r[:2], r[2] + (3 << 32), *r[3:]) for r in want.itertuples(index=False, name=None))
    assert sizes.value == 0


def test_ambiguous_components_are_folded_batch_by_batch(spark):
    """The same events whatever the batches, and no table of a whole component in a worker."""
    random, setting = np.random.default_rng(8), "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(f, o, 50 + h, float(random.integers(0, 5)) / 8) for f in range(150) for o in range(4) for h in range(4) if random.random() < 0.4]
    pairs = spark.createDataFrame([(s, *r) for s in (0, 1) for r in rows], "seq_id long, frame_idx long, oid long, hid long, d double")
    before, whole = spark.conf.get(setting), clearmot.fold_matches
    sizes = spark.sparkContext.accumulator(0)

    def counted(group, last=None):
        if len(group) > 11 + 16:
            sizes.add(1)
        return whole(group, last)

    spark.conf.set(setting, "11")
    clearmot.fold_matches = counted
    try:
        found = rows_of(clearmot.matches(pairs, ["seq_id"]))
    finally:
        spark.conf.set(setting, before)
        clearmot.fold_matches = whole
    want = whole(pd.DataFrame(rows, columns=["frame_idx", "oid", "hid", "d"]))
    assert found == sorted(((r[4], r[0], r[3], r[2], s, r[1]) for s in (0, 1) for r in want.itertuples(index=False, name=None)), key=repr)
    assert sizes.value == 0


def test_points_are_picked_without_arrays_of_them(spark):
    """Rows as by unpack(), of every length; the plan evaluates nothing for each number of the array but what is picked."""
    rows = spark.createDataFrame([(k, None if k == 9 else [float(v) for v in range(k)]) for k in range(10)], "k int, flat array<double>")
    found = points.unpacked(rows, "flat", "at")
    want = [(k, i, *(float(3 * i + j) for j in range(3))) for k in range(9) for i in range(k // 3)]
    assert sorted(map(tuple, found.collect())) == want
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in catalogue.unpack_points(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_field_is_dealt_out_by_frame(spark):
    """Cells that are missing, a frame without a field, and no shuffle of a cell's key."""
    boxes = spark.createDataFrame([(0, f, t, 0.1 * t, 0.2, 0.1 * t + 0.3, 0.6) for f in (0, 1) for t in range(5)], f"seq_id long, frame_idx long, traj_id long, {BOX}")
    cells = {(x, y): ((x - y) / 64, (x + y) / 128) for x in range(4) for y in range(4) if (x, y) != (1, 2)}
    field = spark.createDataFrame([(0, 0, 4, 4, *at, *move) for at, move in cells.items()], "seq_id long, frame_idx long, gw int, gh int, gx int, gy int, dx double, dy double")
    shifted = motion.shift_boxes(boxes, field, ["seq_id", "frame_idx"], ["traj_id"])
    for r in shifted.collect():
        box, dx, dy = (0.1 * r.traj_id, 0.2, 0.1 * r.traj_id + 0.3, 0.6), 0.0, 0.0
        for x, y, w in motion.SAMPLES if r.frame_idx == 0 else ():
            at = tuple(max(0, min(3, int((box[k] * s + box[k + 2] * (1 - s)) * 4 + 0.5))) for k, s in ((0, x), (1, y)))
            dx, dy = dx + w * cells.get(at, (0, 0))[0], dy + w * cells.get(at, (0, 0))[1]
        assert (r.x1, r.y1, r.x2, r.y2) == pytest.approx([min(1, max(0, v)) for v in (box[0] - dx, box[1] - dy, box[2] - dx, box[3] - dy)])
    assert "hashpartitioning(seq_id" in (plan := shifted._jdf.queryExecution().executedPlan().toString()) and "gx" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(")[1:])


def test_large_tables_are_replayed_in_more_batches(spark, monkeypatch):
    counts, rows = [], spark.range(90).select(F.col("id").alias("frame_idx"), (F.col("id") / 8).alias("frame_time"))
    monkeypatch.setattr(catalogue, "BATCH_ROWS", 10)

    def run(stream):
        counts.append(1)
        return stream

    assert sorted(r.frame_idx for r in catalogue._replayed(spark, rows, "stream", run).collect()) == list(range(90)) and len(counts) == 9


def test_events_of_frames_in_parts(monkeypatch):
    """All pairs of a frame meet, however few at a time; no object is asked frame by frame."""
    random = np.random.default_rng(4)
    rows = pd.DataFrame([(s, f, t, x := float(random.integers(0, 40)), 0.0, x + 10, 10.0) for f in range(40) for s in (0, 1) for t in range(random.integers(0, 6))], columns=["side", "frame_idx", "traj_id", "x1", "y1", "x2", "y2"])
    whole = online.frame_events({}, rows, 0.45)
    monkeypatch.setattr(online, "ROWS_AT_ONCE", 5)
    parts = online.frame_events({}, rows.sample(frac=1, random_state=1), 0.45)
    key = ["frame_idx", "type", "oid", "hid"]
    assert whole.sort_values(key).reset_index(drop=True).equals(parts.sort_values(key).reset_index(drop=True))
    assert (whole.type != "FP").sum() == (rows.side == 0).sum() and whole.hid.notna().sum() == (rows.side == 1).sum()


def test_kept_log_leaves_only_itself(spark, tmp_path, monkeypatch):
    """A table of events for several readers: pairs and matches are gone once it is written."""
    from trajlake.operators import tables

    places = iter(range(99))
    monkeypatch.setattr(tables, "new_path", lambda spark, name: f"{tmp_path}/{name}-{next(places)}")
    rows = spark.createDataFrame([(0, f, t, 20.0 * t, 0.0, 20.0 * t + 10, 10.0) for f in range(6) for t in range(3)], f"seq_id long, frame_idx long, traj_id long, {BOX}")
    log = clearmot.kept_events(rows, rows.filter("frame_idx <> 2"), ["seq_id"])
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"double", "log"}
    assert rows_of(log) == rows_of(clearmot.events(rows, rows.filter("frame_idx <> 2"), ["seq_id"], pairs=clearmot.iou_pairs(rows, rows.filter("frame_idx <> 2"), ["seq_id", "frame_idx"])))
