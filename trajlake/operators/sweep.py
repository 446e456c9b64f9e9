"""Parameter sweeps: many candidates as one job, and a thin coordinate descent over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .associate import COLUMNS, OUT, PARAMS, Associator, walked, with_segments
from .clearmot import kept_events, measures
from .tables import _file_system, drop, kept

OUT_OF_BOUNDS = -10000.0


def search_space(space: dict[str, dict], *sections: dict) -> dict[str, dict]:
    """The space with an initial value each: its own, else that of the last section that has the name; within its bounds."""
    out = {}
    for name, entry in space.items():
        found = [s[name] for s in sections if name in s]
        start = entry.get("initial", found[-1] if found else None)
        if start is None or not entry["min"] <= start <= entry["max"]:
            raise ValueError(f"{name} has no initial value within its bounds")
        out[name] = entry | {"initial": start}
    return out


def neighbour_vectors(current: DataFrame, space: DataFrame, multiplier: float) -> DataFrame:
    """The 2 P candidates one step up or down in one parameter (name, value; space: name, low, high, step): candidate (its
    parameter and sign), name, value rounded to 3 places, and whether all of it is in bounds."""
    moves = space.select(F.col("name").alias("moved"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign"))
    rows = current.join(space, "name").crossJoin(moves)  # P x 2 P configuration rows
    value = F.bround(F.col("value") + F.when(F.col("name") == F.col("moved"), F.col("sign") * multiplier * F.col("step")).otherwise(F.lit(0.0)), 3)
    out = rows.withColumn("value", value).withColumn("candidate", F.concat("moved", F.when(F.col("sign") > 0, "+").otherwise("-")))
    return out.select("candidate", "name", "value", F.col("value").between(F.col("low"), F.col("high")).alias("in_bounds"))


def not_evaluated(candidates: DataFrame, done: DataFrame, vector: list[str]) -> DataFrame:
    return candidates.join(done, vector, "left_anti")


def sweep(candidates: dict[str, dict], frames: DataFrame, detections: DataFrame, objects: DataFrame, keys: list[str], max_distance: float = 0.45, splits: DataFrame | None = None) -> DataFrame:
    """fitness and the counts behind it for every candidate, pooled over all sequences: association, events and sums of all
    candidates and sequences run in one job. Each candidate and part of a sequence (see with_segments) is a group of its own.
    splits (keys, split): a row for each split instead, pooled over its sequences; a sequence can be in several."""
    spark = frames.sparkSession
    names = spark.createDataFrame([(c,) for c in candidates], "candidate string")
    least = min((PARAMS | c)[k] for c in candidates.values() for k in ("traj_initial_thr", "traj_high_thr", "traj_low_thr", "new_traj_thr"))
    work = with_segments(frames, detections, keys, least).crossJoin(F.broadcast(names))  # configuration: one row for each candidate
    by = ["candidate", *keys]

    trajectories = walked(work, [*by, "segment"], lambda key: Associator(PARAMS | candidates[key[0]]), COLUMNS, OUT)
    gt = objects.crossJoin(F.broadcast(names))
    trajectories = kept(trajectories, "sweep")  # read several times from here on
    log = kept_events(gt, trajectories, by, max_distance)
    drop(trajectories)
    scores = measures(log, by)
    pool = ["candidate"]
    if splits is not None:
        scores, pool = scores.join(splits.select(*keys, "split"), keys), ["candidate", "split"]
    sums = scores.groupBy(*pool).agg(*(F.sum(c).alias(c) for c in ("num_objects", "num_misses", "num_false_positives", "num_switches", "fp_tracks", "num_frames")))
    mota = 1 - (F.col("num_misses") + F.col("num_false_positives") + F.col("num_switches")) / (F.col("num_objects") + 1e-7)
    sums = sums.withColumns({"mota": mota, "fp_per_frame": F.col("num_false_positives") / (F.col("num_frames") + 1e-7)})
    return sums.withColumn("fitness", F.col("mota") - 0.0005 * F.col("fp_tracks") - 0.002 * F.col("fp_per_frame"))


def best(scores: DataFrame, name: str = "candidate", value: str = "fitness") -> DataFrame:
    return scores.agg(F.max_by(name, value).alias(name), F.max(value).alias(value))


def improvement_shares(log: DataFrame) -> DataFrame:
    """Of the gain in a search log (name, delta), the share of each parameter."""
    total = log.filter("delta > 0").groupBy("name").agg(F.sum("delta").alias("gain"))
    return total.crossJoin(total.agg(F.sum("gain").alias("all"))).select("name", "gain", F.try_divide("gain", "all").alias("share"))


def coordinate_descent(space: dict[str, dict], evaluate: Callable[[list[dict]], list[float]], start: float = 4.0, stop: float = 0.5, gains: int = 3, on_step: Callable[[dict, float], None] = lambda v, s: None) -> tuple[dict, float]:
    """Walk one parameter at a time while it gets strictly better: up first, then down; on to the next after `gains` gains or
    a failure; halve the multiplier when a whole round has brought nothing. `evaluate` scores a list of vectors in one job;
    vectors out of bounds are not run."""
    names, seen = list(space), {}

    def scores(vectors: list[dict]) -> list[float]:
        key = lambda v: tuple(v[n] for n in names)
        inside = [v for v in vectors if all(space[n]["min"] <= v[n] <= space[n]["max"] for n in names)]
        new = [v for v in inside if key(v) not in seen]
        if new:
            seen.update(zip(map(key, new), evaluate(new), strict=True))
        return [seen.get(key(v), OUT_OF_BOUNDS) for v in vectors]

    now = {n: round(space[n]["initial"], 3) for n in names}
    value, multiplier, at, won, step, last = scores([now])[0], start, 0, 0, 0, 0
    while multiplier >= stop:
        name = names[at % len(names)]
        tries = [now | {name: round(now[name] + sign * multiplier * space[name]["step"], 3)} for sign in (1, -1)]
        found = scores(tries)
        better = next((k for k in (0, 1) if found[k] > value), None)
        step += 1
        if better is not None:
            now, value, last, won = tries[better], found[better], step, won + 1
            on_step(now, value)
        if better is None or won >= gains:
            at, won = at + 1, 0
        if step > last + len(names) + 1:
            multiplier, last = multiplier / 2, step
    return now, value


class RoundsUsedUp(Exception):
    pass


def evaluator(frames: DataFrame, detections: DataFrame, objects: DataFrame, keys: list[str], splits: DataFrame, max_distance: float = 0.45) -> Callable[[DataFrame], DataFrame]:
    """For search(): the fitness of a round's candidates on the splits train and validation, all in one sweep."""

    def evaluate(candidates: DataFrame) -> DataFrame:
        vectors = {r.candidate: r.vector for r in candidates.collect()}  # the candidates of one round
        return sweep(vectors, frames, detections, objects, keys, max_distance, splits).select("candidate", "split", F.col("fitness").alias("score"))

    return evaluate


STATE = "round long, candidate string, vector map<string, double>, split string, score double, better boolean"


def search(spark: SparkSession, path: str, space: dict[str, dict], evaluate: Callable[[DataFrame], DataFrame], validate: bool = True, start: float = 4.0, stop: float = 0.5, gains: int = 3, most_rounds: int | None = None) -> DataFrame:
    """coordinate_descent() with its state as a table at `path` (STATE): it goes on from there after it was stopped or killed.

    A round tries the neighbours that the walk can come to next, up and down, of all parameters at once; those in the table
    already are left out (anti join by vector), the others are scored in one job. evaluate takes candidates (candidate,
    vector) and gives scores (candidate, split, score), for the split `train` and, with validate, `validation`: the walk
    follows train alone. Vectors out of bounds are never run. Each round is one append of its rows, the last thing that it
    does, so that a round that was cut off is done again. Gives the table; `better` rows beat the best vector before their
    round. most_rounds ends a call after so many rounds in all.
    """
    names = list(space)
    key = lambda v: tuple(v[n] for n in names)
    known: dict[tuple, dict[str, float]] = {}
    rounds = 0
    where, files = _file_system(spark, path)
    if files.exists(where):
        for row in spark.read.schema(STATE).parquet(path).collect():  # some dozens of vectors a round: the walk's own log
            known.setdefault(key(row.vector), {})[row.split] = row.score
            rounds = max(rounds, row["round"] + 1)

    def scored(vectors: list[dict], best: float) -> list[float]:
        nonlocal rounds
        inside = {key(v): v for v in vectors if all(space[n]["min"] <= v[n] <= space[n]["max"] for n in names)}
        new = {k: v for k, v in inside.items() if k not in known}
        if new:
            if most_rounds is not None and rounds >= most_rounds:
                raise RoundsUsedUp
            frame = spark.createDataFrame([(f"{rounds}-{i}", v) for i, v in enumerate(new.values())], "candidate string, vector map<string, double>")
            found = kept(evaluate(frame).select("candidate", "split", F.col("score").cast("double")), "scores")
            splits = ["train", "validation"] if validate else ["train"]
            rows = found.filter(F.col("split").isin(splits)).join(F.broadcast(frame), "candidate")  # the candidates of one round
            rows.select(F.lit(rounds).cast("long").alias("round"), "candidate", "vector", "split", "score", ((F.col("split") == "train") & (F.col("score") > best)).alias("better")).write.mode("append").parquet(path)
            for row in rows.collect():
                known.setdefault(key(row.vector), {})[row.split] = row.score
            rounds += 1
        return [known[key(v)].get("train", OUT_OF_BOUNDS) if key(v) in known else OUT_OF_BOUNDS for v in vectors]

    def around(now: dict, multiplier: float) -> list[dict]:
        return [now | {n: round(now[n] + sign * multiplier * space[n]["step"], 3)} for n in names for sign in (1, -1)]

    now = {n: round(float(space[n]["initial"]), 3) for n in names}
    try:
        value, multiplier, at, won, step, last = scored([now], -float("inf"))[0], start, 0, 0, 0, 0
        while multiplier >= stop:
            name = names[at % len(names)]
            tries = [now | {name: round(now[name] + sign * multiplier * space[name]["step"], 3)} for sign in (1, -1)]
            if any(key(v) not in known for v in tries):
                scored(around(now, multiplier), value)
            found = scored(tries, value)
            better = next((k for k in (0, 1) if found[k] > value), None)
            step += 1
            if better is not None:
                now, value, last, won = tries[better], found[better], step, won + 1
            if better is None or won >= gains:
                at, won = at + 1, 0
            if step > last + len(names) + 1:
                multiplier, last = multiplier / 2, step
    except RoundsUsedUp:
        pass
    return spark.read.schema(STATE).parquet(path)


def best_vectors(state: DataFrame) -> DataFrame:
    """vector, train and validation (null without) of a search's table, best first by train, of equal ones the earliest."""
    each = state.groupBy("round", "candidate").agg(F.first("vector").alias("vector"), *(F.max(F.when(F.col("split") == s, F.col("score"))).alias(s) for s in ("train", "validation")))
    return each.orderBy(F.col("train").desc_nulls_last(), "round", "candidate").select("vector", "train", "validation")
