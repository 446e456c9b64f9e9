"""Suites of tests: what to run, and pooled and mean results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clearmot import ratios

SUMMED = ["num_frames", "num_objects", "num_predictions", "num_matches", "num_switches", "num_false_positives", "num_misses", "num_unique_objects", "mostly_tracked", "partially_tracked", "mostly_lost", "mostly_lost2", "missed", "num_fragmentations", "fp_tracks", "idtp", "idfp", "idfn"]
AVERAGED = ["mostly_tracked_frac", "partially_tracked_frac", "mostly_lost2_frac", "missed_frac", "fp_tracks_frac"]


def pooled(results: DataFrame) -> DataFrame:
    """For each test, over all data sets (`_overall`) and over each group (`__ovr` and its name): counts summed, rates from the
    sums, motp weighted by idtp, the listed shares averaged over all rows. Only tests of more than one data set; rows
    without a group are in `_overall` alone. Recall, precision, idp and idr come from the pooled counts too."""
    several = results.select("ds_key").distinct().limit(2).agg((F.count("*") > 1).alias("several"))
    n_rows = F.count("*")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMMED]
    means = [(F.coalesce(F.sum(c), F.lit(0.0)) / n_rows).alias(f"mean_{c}") for c in AVERAGED]
    weighted = F.coalesce(F.sum(F.col("motp") * F.col("idtp")), F.lit(0.0)).alias("weighted")
    rolled = results.rollup("test_key", "grp").agg(F.grouping("test_key").alias("no_test"), F.grouping("grp").alias("no_group"), *sums, *means, weighted)
    rolled = rolled.filter("no_test = 0 AND (no_group = 1 OR grp IS NOT NULL)").join(F.broadcast(several), F.col("several"))  # one row
    eps, col = 1e-7, F.col
    rolled = rolled.withColumns({
        "ds_key": F.when(col("no_group") == 1, F.lit("_overall")).otherwise(F.concat(F.lit("__ovr"), col("grp").cast("string"))),
        "idf1": 2 * col("idtp") / (2 * col("idtp") + col("idfp") + col("idfn") + eps), "idp": F.try_divide(col("idtp"), col("idtp") + col("idfp")), "idr": F.try_divide(col("idtp"), col("idtp") + col("idfn")),
        "mota": 1 - (col("num_false_positives") + col("num_misses") + col("num_switches")) / (col("num_objects") + eps), "motp": col("weighted") / (col("idtp") + eps),
        "recall": F.try_divide(col("num_matches") + col("num_switches"), col("num_objects")), "precision": F.try_divide(col("num_matches") + col("num_switches"), col("num_predictions")),
    })
    return ratios(rolled).withColumns({c: F.col(f"mean_{c}") for c in AVERAGED}).drop("no_test", "no_group", "weighted", "several", *(f"mean_{c}" for c in AVERAGED))


def with_pooled(results: DataFrame) -> DataFrame:
    """The report's rows: all results, their pooled rows and their means, with nulls where one lacks a column."""
    averages = means(long_form(results.withColumn("grp", F.col("grp").cast("string")), ["ds_key", "grp", "test_key"]))
    metrics = [c for c, kind in results.dtypes if c not in ("ds_key", "grp", "test_key") and kind in ("int", "bigint", "double", "float")]
    wide = averages.groupBy("ds_key", "test_key").pivot("metric", metrics).agg(F.first("value"))
    return results.unionByName(pooled(results), allowMissingColumns=True).unionByName(wide, allowMissingColumns=True)


def merged(base: Column, over: Column) -> Column:
    """Two settings as one map; where both have a name, that of `over`. A null map is empty."""
    base, over = (F.coalesce(m, F.create_map().cast("map<string,double>")) for m in (base, over))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def long_form(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric and value of every numeric column."""
    values = [c for c, kind in results.dtypes if c not in keys and kind in ("int", "bigint", "double", "float")]
    return results.select(*keys, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(keys, values, "metric", "value")


def means(results: DataFrame) -> DataFrame:
    """Arithmetic means of a long table (ds_key, grp, test_key, metric, value) by test and metric, over all (`_arithmean`) and
    by group (`__mean(` and its name `)`). Without any value: 0."""
    rolled = results.rollup("test_key", "metric", "grp").agg(F.grouping("metric").alias("g1"), F.grouping("grp").alias("g2"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))
    named = rolled.filter("g1 = 0 AND (g2 = 1 OR grp IS NOT NULL)")
    key = F.when(F.col("g2") == 1, F.lit("_arithmean")).otherwise(F.concat(F.lit("__mean("), F.col("grp").cast("string"), F.lit(")")))
    return named.select(key.alias("ds_key"), "test_key", "metric", "value")


def expand_tests(tests: DataFrame, rates: list[float]) -> DataFrame:
    """A test for each frame rate (below 0: taken as the interval itself, else 1 / (rate + 0.01)), named `, {rate}fps`;
    tests with an interval of their own stay as they are."""
    own = tests.filter("min_interval IS NOT NULL")
    rate = F.explode(F.array(*(F.lit(float(r)) for r in rates))).alias("rate") if rates else None
    if rate is None:
        return tests
    spread = tests.filter("min_interval IS NULL").select("*", rate)
    spread = spread.withColumns({"min_interval": F.when(F.col("rate") < 0, F.col("rate")).otherwise(1 / (F.col("rate") + 0.01)), "test_key": F.concat("test_key", F.lit(", "), F.regexp_replace(F.col("rate").cast("string"), r"\.0$", ""), F.lit("fps"))})
    return own.unionByName(spread.drop("rate"))


def tests_to_run(datasets: DataFrame, tests: DataFrame, results: DataFrame, split: str | None = None) -> DataFrame:
    """All pairs of a data set and a test that have no result yet, or are to be made anew. Data sets without a split belong
    to every split. Both tables are configuration: their product is the work list."""
    chosen = datasets if split is None else datasets.filter(F.col("split").isNull() | (F.col("split") == split))
    work = chosen.crossJoin(tests)
    done = results.select("ds_key", "test_key", "config_hash").distinct()
    fresh = work.join(done, ["ds_key", "test_key", "config_hash"], "left_anti")
    again = work.filter("regenerate").join(done, ["ds_key", "test_key", "config_hash"], "left_semi")
    return fresh.unionByName(again)


def latest(results: DataFrame) -> DataFrame:
    """Of each (ds_key, test_key, config_hash, metric) the value that was computed last."""
    return results.groupBy("ds_key", "test_key", "config_hash", "metric").agg(F.max_by("value", "computed_at").alias("value"), F.max("computed_at").alias("computed_at"))


def compare_runs(scores: DataFrame, keys: list[str], value: str = "mota", base: str = "0", least: float = 0.001) -> DataFrame:
    """scores (run_id, keys, value) with the base run's value, the difference and whether it is over `least`."""
    first = scores.filter(F.col("run_id") == base).select(*keys, F.col(value).alias("base"))
    delta = F.col(value) - F.col("base")
    return scores.join(first, keys, "left").withColumns({"delta": delta, "differs": F.abs(delta) > least})


def metric_table(long: DataFrame, runs: list[str], by: list[str] | None = None) -> DataFrame:
    """A row for each metric (and each of `by`), a column for each run."""
    return long.groupBy(*(by or []), "metric").pivot("run_id", runs).agg(F.first("value"))


def report_order(results: DataFrame, label: Column, sort_key: str) -> DataFrame:
    """results with position, by data set label and then the sort key: names count thousands, as in the report."""
    names = results.select(label.alias("dataset")).distinct().withColumn("place", F.row_number().over(Window.orderBy("dataset")) - 1)
    return results.withColumn("dataset", label).join(names, "dataset").withColumn("position", F.col("place") * 1000 + F.col(sort_key)).drop("place")
