import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.compare import duck, rows_of, rows_of_sql
from trajlake.llm import mixing, queries


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck(sf_dir), queries.ORACLE[name])


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_encoding_round_trips(spark, sf_dir, texts):
    rows = queries.op2_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.round_trip and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_shards_hold_every_slot_once(spark, sf_dir):
    rows = queries.op3_token_shards(spark, sf_dir).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard == r.slot // 1024 and r.byte_offset == r.slot % 1024 * 2048 for r in rows)


def test_fingerprints(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in queries.op4_fingerprint(spark, sf_dir).collect()}
    ids = sorted(texts, reverse=True)
    for i, k in enumerate(ids):
        half = len(texts[k]) // 2
        edited = texts[k][: len(texts[k]) - half] + texts[ids[(i + 1) % len(ids)]][:half]
        assert rows[k].n_chars == len(texts[k]) and rows[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[k].near_edited <= 1 and 0 <= rows[k].near_next <= 1
    prints = {(texts[k], rows[k].fingerprint) for k in ids}
    assert len(prints) == len({t for t, _ in prints}) == len({f for _, f in prints})
    better = sum(rows[k].near_edited > rows[k].near_next for k in ids)
    assert better > 0.95 * len(ids)


def test_classifier_on_held_out_rows(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    rows = queries.op7_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    kept = [r.predicted for r in rows if r.quality == 1]
    assert right > 0.94 and sum(kept) / len(kept) > 0.98
    assert all((r.predicted == 1) == (r.score >= 0.3) for r in rows)


def test_media(spark, sf_dir, texts):
    rows = queries.op9_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded)) and r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "encoding":
            assert out.columns == docs.columns
        n = out.count()
        assert 0 < n <= docs.count() and (n == docs.count() or name in ("quality classifier", "near-duplicates"))
        docs = out
    assert rows_of(corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens")) == rows_of(docs.select("doc_id", "n_tokens"))


def test_pipeline_gives_the_mixing(spark, tmp_path):
    import corpus_pipeline

    sizes = {"a": 40 * 64, "b": 10 * 64}  # parts by the square roots: 667 and 333 of 1000 slots
    rows = [(k, f"text {k}", "en", s, 6) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = corpus_pipeline.mixed(spark, docs, "")
    kept.write.parquet(f"{tmp_path}/m")
    out = corpus_pipeline.encoded(spark, spark.read.parquet(f"{tmp_path}/m"), "").collect()
    again = {r.doc_id: (r.slot, r.place) for r in mixing.mix(docs).collect()}
    assert {r.doc_id: (r.slot, r.place) for r in out} == again and len(set(again.values())) == len(rows)
    for n in range(1, 31):  # both sources have blocks left
        prefix = [r.source for r in out if r.slot < n]
        assert abs(prefix.count("a") / 64 - n * 0.667) <= 1 and abs(prefix.count("b") / 64 - n * 0.333) <= 1


def odd_documents(spark):
    rows = [(k, f"plain words number {k} with a few more to tell it from its neighbours {k * 7}", "en", "a" if k % 3 else None, 9) for k in range(30)]
    rows += [(100, None, None, None, None), (101, "", "", "", 0), (None, "a text without an id", "en", "b", 3), (102, "same row twice", "en", "b", 3), (102, "same row twice", "en", "b", 3), (103, "long " * 50_000, "xx", "c", 1)]
    clash = {c: F.lit(1) for c in ("score", "predicted", "n_words", "n_removed", "slot", "place", "block", "ids", "n_tokens", "kept", "component_id")}
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash).repartition(3)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = odd_documents(spark)
    d = f"file://{tmp_path}"
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k < 25)) for k in range(30)] + [(None, 1), (100, None)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:  # each on the odd rows themselves
        assert stage(spark, docs, d).count() > 0
        assert stage(spark, docs.limit(0), d).count() == 0
    one = sorted(str(r.doc_id) for r in corpus_pipeline.one_of_each(spark, docs, d).collect())
    assert one == sorted(str(r.doc_id) for r in docs.collect())  # rows that repeat a kept id stay
    cut = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, d).collect()}
    assert cut[100] is None and cut[101] == "" and cut[103] == "" and cut[5].startswith("plain words number 5")
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "slot", "place"] and 0 < out.count() <= docs.count()
