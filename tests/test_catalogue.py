import pytest
from pyspark.sql import functions as F

from tests.compare import duck, rows_of, rows_of_sql
from trajlake.plans import catalogue


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, connection, name):
    found = catalogue.QUERIES[name](spark, sf_dir)
    assert rows_of(found) == rows_of_sql(connection, catalogue.ORACLE[name])


def test_batch_and_stream_give_the_same_result(spark, sf_dir):
    columns = ["seq_id", "frame_idx", "class_id", "conf", "x1", "y1", "x2", "y2"]
    batch = rows_of(catalogue.associate_batch(spark, sf_dir).select(*columns))
    for stream in (catalogue.associate_stream(spark, sf_dir), catalogue.associate_keyed_stream(spark, sf_dir)):
        assert stream.agg({"late": "max"}).first()[0] == 0
        assert rows_of(stream.select(*columns)) == batch


def test_online_matches_equal_batch_matches(spark, sf_dir):
    columns = ["seq_id", "frame_idx", "type", "oid", "hid"]
    batch = catalogue.log(spark, sf_dir).filter("type IN ('MATCH', 'SWITCH')").select(*columns)
    assert rows_of(catalogue.online_mot_stream(spark, sf_dir).select(*columns)) == rows_of(batch)


def test_stream_rate_limit_equals_fold(spark, sf_dir):
    stream = catalogue.rate_limit_stream(spark, sf_dir).select("seq_id", "frame_time")
    assert rows_of(stream) == rows_of(catalogue.sample_min_interval(spark, sf_dir))


def test_sweep_scores_every_candidate(spark, sf_dir):
    found = {r.candidate: r.fitness for r in catalogue.sweep_scores(spark, sf_dir).collect()}
    assert set(found) == {"default", "strict", "loose"}
    assert all(-5 < f <= 1 for f in found.values())
    top = catalogue.sweep_best(spark, sf_dir).collect()
    assert [(r.candidate, r.fitness) for r in top] == [max(found.items(), key=lambda x: x[1])]


def test_lookups_go_on_after_1000_seconds(spark, tmp_path):
    spark.createDataFrame([(8 * k, 1) for k in (0, 30_000, 40_000)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = catalogue.asof_backward(spark, str(tmp_path)).groupBy("frame_idx").agg(F.count("*"), F.max("t")).collect()
    assert {tuple(r) for r in rows} == {(0, 60_000, 60_000 / 64 - 1 / 64), (30_000, 20_000, 1250 - 1 / 64)}
