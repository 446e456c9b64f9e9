import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import fingerprint, media, minhash, mixing, quality, sentencepiece, substring_dedup, token_shards, url_filter, warc
from trajlake.llm._skew import join_groups
from trajlake.operators.components import components

DOCS = "doc_id long, text string, n_words string, score string"
#: Nulls in every column, empty and blank texts, repeated rows, a very long text, columns called like results.
ODD = [(1, None, "a", "b"), (None, "x y z", None, None), (2, "", "", ""), (3, " \n\t ", None, ""), (4, "one two three four five six", "1", "2"), (4, "one two three four five six", "1", "2"), (5, "ONE two Three four five SIX", None, None), (6, "é " * 60_000, None, None), (7, "last", "q", "r")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def chatter(seed, n, words=400):
    r = random.Random(seed)
    return [" ".join(r.choice(["the", "of", "tion", "ing", "as"]) + str(r.randrange(words)) for _ in range(r.randrange(1, 120))) for _ in range(n)]


# --- WARC


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b c%\n", "x"), (3, None, None), (4, "u", ""), (5, "v", "y" * 700_000), (2, "http://b c%\n", "x"), (None, "n", "x"), (6, "w", "ü")], "page_id long, url string, html string").repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, frame_bytes=64, bundle_bytes=200)
    rows = warc.read_archives(spark, path).collect()
    found = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows), key=repr)
    assert found == sorted([(1, "revisit", 2, 1), (2, "response", None, 1), (2, "response", None, 1), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 700_000), (None, "response", None, 1), (6, "response", None, 2)], key=repr)
    assert {r.url for r in rows if r.page_id == 2} == {"http://b c%\n"} and {r.payload_digest for r in rows if r.page_id in (3, 4)} == {warc.digest(b"")}
    got = warc.fetch(spark, path, spark.createDataFrame([(5,), (6,)], "page_id long")).collect()
    assert {r.page_id: len(r.payload) for r in got} == {5: 700_000, 6: 2}
    warc.write_archives(pages, path + "2", least=2)
    assert {r.record_type for r in warc.read_archives(spark, path + "2").collect()} == {"response"}
    warc.write_archives(pages.limit(0), path + "0")
    assert warc.read_archives(spark, path + "0").count() == 0
    with pytest.raises(ValueError):
        warc.frame_table(b"0" * 100)


def test_index_leads_to_records(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", str(k) * 50) for k in range(40)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, frame_bytes=500)
    data = {r.bundle: r.data for r in spark.read.parquet(path).collect()}
    for e in warc.index(spark, path).collect():
        record = warc.read_frame(data[e.bundle], e.frame)[e.offset : e.offset + e.length]
        assert f"<urn:page:{e.page_id}>".encode() in record and record.endswith(str(e.page_id).encode() * 50 + b"\r\n\r\n")


# --- SentencePiece


def test_segmentation_equals_the_library():
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(open(sentencepiece.DEFAULT_MODEL, "rb").read())
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for p in model.pieces:
        p.score = max(p.score, -40_000)  # the library loses small sums beside -1e9
    other = library.SentencePieceProcessor(model_proto=model.SerializeToString())
    own = sentencepiece.pieces_of(sentencepiece.DEFAULT_MODEL)
    for text in [*chatter(1, 40), "Hello world", " a", "日本語 ☃ x", "a\tb", "naïve café", "x" * 100, "\U0001f600 ok"]:
        ids, at = own.encode([text])
        assert ids.tolist() == other.encode(text) and at.tolist() == [0, len(ids)]
        assert own.decode(ids, at) == [text]


def test_both_ways_through_the_automaton_agree():
    own = sentencepiece.pieces_of(sentencepiece.DEFAULT_MODEL)
    r = random.Random(7)
    words = [f"{sentencepiece.MARK}{w}" for t in chatter(4, 30) for w in t.split()] + ["".join(r.choice("abcdefgh tion") for _ in range(r.randrange(1, 49))).replace(" ", sentencepiece.MARK) for _ in range(300)]
    done, (flat, lo, hi) = own.many.viterbi(words)
    assert len(done) >= 300
    for k, a, b in zip(done, lo, hi, strict=True):
        assert flat[a:b].tolist() == own.viterbi(words[k]), words[k]


def test_viterbi_equals_brute_force():
    pieces = [("<unk>", 0.0, sentencepiece.UNKNOWN), *((p, s, sentencepiece.NORMAL) for p, s in (("a", -2.0), ("b", -2.5), ("ab", -4.6), ("ba", -3.0), ("aba", -6.0), ("▁", -1.0), ("▁a", -2.9)))]
    own = sentencepiece.Pieces(pieces, prefix=False)
    scores = {p: s for p, s, _ in pieces}

    def best(text):
        total = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                total[end] = max(total[end], total[start] + scores.get(text[start:end], -16 if end - start == 1 else float("-inf")))
        return total[-1]

    for text in ["abab", "a ba", "aab c ab", "   ", "cab"]:
        ids, at = own.encode([text])
        assert sum(pieces[i][1] if i else -16 for i in ids.tolist()) == pytest.approx(best(text.replace(" ", "▁")))


def test_encode_and_decode_odd_rows(spark, odd, none):
    clash = odd.withColumns({"ids": F.lit("a"), "n_tokens": F.lit("b"), "decoded": F.lit("c")})
    out = sentencepiece.decode(sentencepiece.encode(clash)).collect()
    assert all(r.decoded == (r.text or "") and len(r.ids) == r.n_tokens for r in out)
    assert sentencepiece.encode(none).count() == 0
    assert spark.createDataFrame([(None,)], "ids array<int>").transform(sentencepiece.decode).first().decoded is None


# --- shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000])
def test_permutation(n):
    order = token_shards.SlotPermutation(n, 5)
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (order.sequence(slots) == np.arange(n)).all()
    if n == 1000:
        assert (slots != token_shards.SlotPermutation(n, 6).slot(np.arange(n))).any() and np.abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.1


def test_shards(spark, tmp_path):
    lists = [[int(x) for x in range(3, 3 + n)] for n in (0, 1, 7, 40, 3, 16)] + [None]
    df = spark.createDataFrame([(x,) for x in lists], "ids array<int>").coalesce(2)
    path = f"file://{tmp_path}/s"
    n = token_shards.write_shards(df, path, length=8, per_shard=4, pad=1)
    rows = sorted(token_shards.read_slots(spark, path).collect())
    assert [r.slot for r in rows] == list(range(n)) and {len(r.tokens) for r in rows} == {16}
    order, sequences = token_shards.SlotPermutation(n, 20240101), {}
    for r in rows:
        assert (r.shard, r.byte_offset) == (r.slot // 4, r.slot % 4 * 16)
        sequences[int(order.sequence(np.array([r.slot]))[0])] = np.frombuffer(r.tokens, "<u2").tolist()
    stream = [x for k in range(n) for x in sequences[k] if x != 1]
    parts = [[]]
    for x in stream:
        parts.append([]) if x == 2 else parts[-1].append(x)
    assert sorted(map(str, parts[:-1])) == sorted(str(x or []) for x in lists)
    again = sorted(token_shards.read_slots(spark, path, 3, 6).collect())
    assert again == rows[3:6]
    assert token_shards.write_shards(df.limit(0), path + "0") == 0 and token_shards.read_slots(spark, path + "0").count() == 0
    with pytest.raises(Exception, match="16 bits"):
        token_shards.write_shards(spark.createDataFrame([([70000],)], "ids array<int>"), path + "1")


def test_shards_of_wide_ids(spark, tmp_path):
    lists = [[70_000, 5], [2**32 - 1], None, list(range(65_530, 65_560))]
    df = spark.createDataFrame([(x,) for x in lists], "ids array<long>").coalesce(1)
    n = token_shards.write_shards(df, f"file://{tmp_path}/w", length=8, per_shard=2, id_bytes=4)
    order = token_shards.SlotPermutation(n, 20240101)
    rows = {int(order.sequence(np.array([r.slot]))[0]): np.frombuffer(r.tokens, "<u4").tolist() for r in token_shards.read_slots(spark, f"file://{tmp_path}/w").collect()}
    stream = [x for ids in lists for x in [*(ids or []), 2]]
    assert sum((rows[k] for k in range(n)), [])[: len(stream)] == stream
    with pytest.raises(Exception, match="over 16 bits"):
        token_shards.write_shards(df, f"file://{tmp_path}/x", length=8)


# --- fingerprints


def test_vectors_add_up(spark):
    rows = spark.createDataFrame([(1, "a b c\nd e"), (2, "d e\na b c"), (3, "a b c"), (4, "d e"), (5, "other words here")], "k long, text string")
    v = {r.k: r.vector for r in fingerprint.vectors(rows, ["k"], "text").collect()}
    assert v[1] == v[2] != v[3]
    both = spark.createDataFrame([(v[1], v[3], v[4], v[5])], "a array<long>, b array<long>, c array<long>, d array<long>")
    r = both.select(fingerprint.insert(F.col("b"), F.col("c")).alias("sum"), fingerprint.remove(F.col("a"), F.col("c")).alias("rest"), fingerprint.likeness(F.col("a"), F.col("a")).alias("same"), fingerprint.likeness(F.col("a"), F.col("d")).alias("far")).first()
    assert r.sum == v[1] and r.rest == v[3] and r.same == 1 and r.far < 0.5


def test_fingerprints_of_odd_rows(spark, odd, none):
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and fingerprint.fingerprints(none).count() == 0
    prints = defaultdict(set)
    texts = {k: t or "" for k, t, _, _ in ODD}
    for r in rows:
        prints[texts[r.doc_id]].add(r.fingerprint)
        assert r.n_chars == len(texts[r.doc_id])
    assert all(len(x) == 1 for x in prints.values())
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.near_next == 1


def test_a_key_with_a_third_of_all_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "PER_BUCKET", 10)
    ids = [*range(-100, 100), *[None] * 200, *[7] * 200]
    rows = [(k, f"{n:04d}abcd") for n, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    filled = df.select("text", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"))
    bucket, n = fingerprint.order_buckets(filled, "k", F.xxhash64("text"))
    dealt = filled.withColumn("b", bucket).groupBy("b").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("b").collect()
    assert n == len(rows) == sum(r.n for r in dealt) and max(r.n for r in dealt) < 40
    assert all(a.hi <= b.lo for a, b in zip(dealt[:-1], dealt[1:], strict=True))

    starts = {hashlib.sha256((text[:4] + f"{n:04d}").encode()).hexdigest(): (text, n) for _, text in rows for n in range(len(rows))}
    following = {int(text[:4]): n for text, n in (starts[r.edited_sha256] for r in fingerprint.fingerprints(df).collect())}
    at, seen = 0, []
    for _ in rows:
        seen.append(at)
        at = following[at]
    keys = [-(2**63) if ids[k] is None else ids[k] for k in [*seen, at]]
    falls = sum(a < b for a, b in zip(keys[:-1], keys[1:], strict=True))
    assert at == 0 and len(set(seen)) == len(rows) and falls == 1  # one ring, and its keys descend


def test_no_bucket_grows_with_a_key(spark):
    """A key with 3 % of all rows, and one with half a per cent, in buckets of their own."""
    n = 200_000
    k = F.when(F.col("id") % 100 < 3, 70_000).when(F.col("id") % 1000 == 999, 70_001).otherwise(F.col("id"))
    df = spark.range(n).select(k.cast("long").alias("k"), F.col("id").cast("string").alias("text"))
    bucket, _ = fingerprint.order_buckets(df, "k", F.xxhash64("text"))
    dealt = df.withColumn("b", bucket).groupBy("b").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("b").collect()
    sizes = sorted(r.n for r in dealt)
    assert sum(sizes) == n and sizes[-1] < 2 * sizes[len(sizes) // 2]
    assert all(a.hi <= b.lo for a, b in zip(dealt[:-1], dealt[1:], strict=True))


def test_fingerprints_equal_plain_counting(spark):
    import xxhash

    def h(*values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v, seed=seed)
        return seed

    def vector(text):
        out = [0] * fingerprint.LANES
        for paragraph in text.split("\n"):
            w = paragraph.split(" ")
            found = [(a.encode(), b.encode()) for a, b in zip(w[:-1], w[1:], strict=True)] + [(w[-1].encode(),), (paragraph.encode(), b"paragraph")]
            for values in found:
                for k, x in enumerate((h(*values), h(struct.pack("<i", 7), *values))):
                    for j in range(32):
                        out[64 * k + 2 * j] += 1 if x >> j & 1 else -1
                        out[64 * k + 2 * j + 1] += 1 if x >> (j + 32) & 1 else -1
        return [(x + 2**15) % 2**16 - 2**15 for x in out]

    texts = ["one two three\nfour five", "", "é \n\n  x", "one two three\nfour five", *chatter(6, 12)]
    rows = sorted(fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    for r in rows:
        text, follower = texts[r.doc_id], texts[(r.doc_id - 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        own, other, near = (vector(t) for t in (text, edited, follower))
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{x % 2**16:04x}" for x in v) for v in (own, other))
        for found, v in ((r.near_edited, other), (r.near_next, near)):
            cosine = np.dot(own, v) / np.sqrt(float(np.dot(own, own)) * np.dot(v, v))
            assert found == pytest.approx(1.0 if own == v else max(0.0, min(1.0, cosine)), abs=1e-9)


# --- substrings


def brute_removed(texts, window):
    where = defaultdict(list)
    for d, t in enumerate(texts):
        w = t.encode().split()
        for i in range(len(w) - window + 1):
            where[tuple(w[i : i + window])].append((d, i))
    covered = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                covered[d].update(range(i, i + window))
    return [b" ".join(x for k, x in enumerate(t.encode().split()) if k not in covered[d]).decode() for d, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(2))
def test_repeats_equal_brute_force(spark, seed):
    r = random.Random(seed)
    parts = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(1, 14))) for _ in range(25)]
    texts = [" ".join(r.choices(parts, k=r.randrange(0, 5))) for _ in range(60)] + ["a " * 30, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {x.doc_id: x for x in substring_dedup.remove_repeats(df, window=6, gram=3).collect()}
    for d, kept in enumerate(brute_removed(texts, 6)):
        assert found[d].kept_text == kept and found[d].n_words == len(texts[d].split()) and found[d].n_removed == found[d].n_words - len(kept.split())


def test_ranges_of_repeated_rows_are_told_once(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, text)] * 2000, "key long, text string").withColumn("text_hash", F.xxhash64("text")).repartition(8)
    rows = substring_dedup.repeated_ranges(df, "text", 35, 8, 1 << 20).collect()
    assert len(rows) == 1 and len(rows[0].ranges) <= 2


def test_repeats_do_not_need_a_wide_sketch(spark):
    texts = chatter(3, 80, 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    narrow, wide = ({x.doc_id: x.kept_text for x in substring_dedup.remove_repeats(df, window=3, gram=2, most_cells=m).collect()} for m in (2, 1 << 24))
    assert narrow == wide == dict(enumerate(brute_removed(texts, 3)))


def test_repeats_in_odd_rows(odd, none):
    rows = substring_dedup.remove_repeats(odd, window=6, gram=3).collect()
    assert len(rows) == len(ODD) and substring_dedup.remove_repeats(none).count() == 0
    kept = {(r.doc_id, r.text): (r.n_words, r.n_removed) for r in rows}
    assert kept[4, ODD[4][1]] == (6, 6) and kept[5, ODD[6][1]] == (6, 0) and kept[6, ODD[7][1]] == (60_000, 60_000) and kept[1, None] == (0, 0)


def morse(flip):
    """Two words that collide in every polynomial with an odd base modulo 2**64."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1024))


def test_words_of_a_pattern_are_told_apart(spark):
    words = [f"w{k}" for k in range(34)]
    texts = [" ".join([*words[:20], morse(f), *words[20:]]) for f in (0, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]
    short = spark.createDataFrame(list(enumerate([f"a b {morse(f)} c d" for f in (0, 1)])), "doc_id long, text string")
    assert sorted(r.component_id for r in minhash.near_duplicates(short).collect()) == [0, 1]
    assert all(r.decoded == r.text for r in sentencepiece.decode(sentencepiece.encode(df)).collect())


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(sentencepiece, "word_hashes", lambda data, starts, ends, seed: [np.zeros(len(starts), np.uint64)])
    own = sentencepiece.Pieces(sentencepiece.read_model(sentencepiece.DEFAULT_MODEL)[0])
    texts = ["some words and some more words", "and others"]
    assert own.decode(*own.encode(texts)) == texts


# --- mixing


def test_mixing_stays_within_a_block(spark):
    sizes, weights = {"a": 700, "b": 200, None: 50, "d": 37}, {"a": 5, "b": 3, None: 2}
    rows = [(k, s, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    out = mixing.mix(df, weights, block_rows=5).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    parts = weights | {"d": 1}
    slots = defaultdict(dict)
    for r in out:
        slots[r.source].setdefault(r.block, set()).add(r.slot)
    for s, blocks in slots.items():
        assert sorted(blocks) == list(range(-(-sizes[s] // 5)))
        for k, at in blocks.items():
            share = parts[s] / 11
            assert len(at) == 1 and k / share - 1 < min(at) + 1e-9 and min(at) + 1 <= (k + 1) / share + 1
    assert len({r.slot for r in out}) == len({(r.source, r.block) for r in out})
    ordered = mixing.in_order(mixing.mix(df, weights, block_rows=5)).collect()
    assert [(r.slot, r.place) for r in ordered] == sorted((r.slot, r.place) for r in out)


def test_mixing_keeps_all_columns(spark):
    """Columns called like internal ones come back as they were; null keys are told apart by ties."""
    names = ["parts", "period", "slot_in_period", "_rank", "_bucket", "_order", "_source", "_nth", "_turn", "_before", "_key", "row", "n", "names", "slot"]
    rows = [(k if k % 3 else None, "ab"[k % 2], f"text {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.concat(F.lit(c), "text") for c in names})
    out = mixing.mix(df, block_rows=4, ties=["text"]).collect()
    assert sorted((r.text, r.doc_id or -1, r.source) for r in out) == sorted((t, k or -1, s) for k, s, t in rows)
    assert all(r[c] == c + r.text for r in out for c in names if c != "slot")
    assert len({(r.slot, r.place) for r in out}) == len(rows)
    again = {r.text: (r.slot, r.place) for r in mixing.mix(df.select("doc_id", "source", "text").repartition(3), block_rows=4, ties=["text"]).collect()}
    assert again == {r.text: (r.slot, r.place) for r in out}


def test_schedule_equals_earliest_deadline_first(spark):
    for parts in ({"a": 5, "b": 3, "c": 2, "d": 1}, {"x": 1}, {"p": 7, "q": 7, "r": 13}):
        whole = sum(parts.values())
        names, done, order = sorted(parts), Counter(), []
        for t in range(whole):
            ready = [(-(-(done[s] + 1) * whole // parts[s]), s) for s in names if done[s] < parts[s] and done[s] * whole // parts[s] <= t]
            order.append(min(ready)[1])
            done[order[-1]] += 1
        rows = mixing.schedule(spark.createDataFrame(list(parts.items()), "source string, parts int")).collect()
        assert [r.source for r in sorted(rows, key=lambda r: r.slot_in_period)] == order
        assert sorted((r.source, r.nth) for r in rows) == sorted((s, k) for s in parts for k in range(parts[s]))
    with pytest.raises(ValueError, match="weight"):
        mixing.mix(spark.createDataFrame([(1, "a")], "doc_id long, source string"), {"a": 0})


def test_mixing_odd_rows(spark, odd, none):
    rows = mixing.mix(odd.withColumn("source", F.lit(None).cast("string"))).collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, *_ in ODD)
    assert mixing.mix(none.withColumn("source", F.lit("x"))).count() == 0


# --- classifier


def test_classifier_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (5, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels, bits=10)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[r.text or ""].add(r.score)
    assert all(len(x) == 1 for x in by.values())
    assert quality.score(none, quality.fit(none, labels, bits=10)).count() == 0
    assert quality.score(odd, quality.fit(odd, labels.limit(0), bits=10)).filter("score <> 0.5").count() == 0


def test_the_sample_is_bounded(spark, monkeypatch):
    """Four labelled ids over 20,000 rows, and a bound on the bytes."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda samples, *_: seen.append(samples) or (np.zeros(4, np.float32), 0.0))
    docs = spark.range(20_000).select((F.col("id") % 4 + 1).alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 5)], "doc_id long, quality int")
    quality.fit(docs, labels)
    known = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(1, 5))
    assert len(seen[0]) == known
    size = max(len(x[0]) for x in seen[0]) * 8
    quality.fit(docs, labels, most_bytes=2 * size)
    assert 1 <= len(seen[1]) <= 2 < known


def test_training_equals_plain_loops():
    samples = [(np.array([0, 3, 5], np.uint32), np.array([2, 1, 1], np.float32), 1), (np.array([3, 6], np.uint32), np.array([1, 4], np.float32), 0), (np.array([], np.uint32), np.array([], np.float32), 1)]
    bits, dim, epochs, rate = 3, 4, 5, 0.5
    weights, bias = quality.train(samples, bits, dim, epochs, rate, 9)
    random_ = np.random.default_rng(9)
    table = random_.uniform(-1 / dim, 1 / dim, (8, dim)).astype(np.float32).tolist()
    layer, shift, done = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0], 0
    for _ in range(epochs):
        for k in random_.permutation(3):
            rows, counts, label = samples[k]
            speed = rate * (1 - done / (epochs * 3))
            done += 1
            share = [float(c) / max(1.0, float(counts.sum())) for c in counts]
            mean = [sum(w * table[r][i] for r, w in zip(rows, share, strict=True)) for i in range(dim)]
            logits = [sum(mean[i] * layer[i][j] for i in range(dim)) + shift[j] for j in (0, 1)]
            p = [np.exp(x) / sum(np.exp(y) for y in logits) for x in logits]
            wrong = [p[j] - (j == label) for j in (0, 1)]  # the slope of the cross-entropy by each logit
            back = [sum(layer[i][j] * wrong[j] for j in (0, 1)) for i in range(dim)]
            for i in range(dim):
                for j in (0, 1):
                    layer[i][j] -= speed * mean[i] * wrong[j]
            for j in (0, 1):
                shift[j] -= speed * wrong[j]
            norm = sum(w * w for w in share)
            for r, w in zip(rows, share, strict=True):
                for i in range(dim):
                    table[r][i] -= speed * w / norm * back[i]
    assert bias == pytest.approx(shift[1] - shift[0], abs=1e-4)
    assert weights.tolist() == pytest.approx([sum(table[r][i] * (layer[i][1] - layer[i][0]) for i in range(dim)) for r in range(8)], abs=1e-4)


def test_classifier_learns(spark):
    docs = spark.createDataFrame([(k, ("good calm words " if k % 2 else "b@d sp@m !!! ") * (1 + k % 5)) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels, bits=12)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)


# --- near-duplicates


def sets_of(text):
    w = text.encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets = {d: sets_of(t) for d, t in texts.items()}
    label = {d: d for d in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {d: (len(sets[d]), root(d)) for d in texts}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # so that buckets are compared in several blocks
    r = random.Random(5)
    base = [f"word{k}" for k in range(160)]
    texts = {0: " ".join(base)}
    for d in range(1, 120):  # a large group around one text, at all similarities
        w = list(base)
        for _ in range(r.randrange(0, 10)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts[d] = " ".join(w[: r.randrange(120, 161)])
    for k, t in enumerate(chatter(9, 120)):
        texts[1000 + 2 * k] = t
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        texts[1001 + 2 * k] = " ".join(w).upper() if k % 3 else t + " more"
    found = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute_components(texts)
    assert all(x.kept == (x.doc_id == x.component_id) for x in found)


def test_only_bands_of_large_buckets_are_joined(spark, monkeypatch):
    """Joins by bucket get about the members of large buckets, not all bands of all classes."""
    base = [f"word{k}" for k in range(60)]
    texts = {d: " ".join(base[:d] + [f"x{d}"] + base[d + 1 :]) for d in range(40)}  # near one another
    texts |= {1000 + k: " ".join(f"w{k}x{i}" for i in range(8)) for k in range(2000)}
    joined = []

    def counting(rows, groups, keys, size, total):
        if keys == ["key"]:
            joined.append(rows.count())
        return join_groups(rows, groups, keys, size, total)

    monkeypatch.setattr(minhash, "join_groups", counting)
    found = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute_components(texts)
    assert len(joined) >= 2 and 0 < max(joined) <= 2 * 40 * minhash.BANDS  # all bands: 2040 * BANDS


def test_members_of_buckets_equal_a_join(spark):
    r = random.Random(6)
    keys = [r.getrandbits(64) - 2**63 for _ in range(300)]
    rows = [(rep, [*r.sample(keys, 2), r.getrandbits(64) - 2**63]) for rep in range(900)]
    banded = spark.createDataFrame(rows, "rep long, bands array<long>").repartition(3)
    large = banded.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("size")).filter("size > 5")
    sizes = {x.key: x.size for x in large.collect()}
    expected = sorted((rep, key, sizes[key]) for rep, bands in rows for key in bands if key in sizes)
    assert expected and len(expected) < 1800
    for most_bits in (28, 15):  # the smaller lets others pass
        assert sorted((x.rep, x.key, x.size) for x in minhash.members_of(banded, large, most_bits).collect()) == expected
    assert minhash.members_of(banded, large.limit(0)).count() == 0


def test_short_near_duplicates_are_not_lost(spark):
    texts = {}
    for k in range(1500):  # of similarity exactly 0.75: four shingles and three of them
        words = [f"w{k}x{i}" for i in range(8)]
        texts |= {2 * k: " ".join(words[:7]), 2 * k + 1: " ".join(words)}
    found = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == {d: (4 if d % 2 else 3, d // 2 * 2) for d in texts}


def test_every_size_has_a_common_bucket():
    """Pairs of similarity 0.75 with 4 to 400 shingles in the union: the bands alone, before any comparison."""
    r = np.random.default_rng(8)
    for union, tries in ((4, 4000), (8, 2000), (20, 1000), (100, 400), (400, 200)):
        both = r.integers(0, 2**64, (tries, union), dtype=np.uint64)
        sides = [[np.sort(x[: union * m // 8]) for x in both] for m in (8, 6)]
        keys = [minhash.band_keys(minhash.signatures(np.concatenate(x), np.concatenate([[0], np.cumsum([len(y) for y in x])]))) for x in sides]
        assert (keys[0] == keys[1]).any(axis=1).all(), union


def test_joining_equals_brute_force(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(50)]
    sets += [np.delete(x, 0) for x in sets if len(x) > 1]
    rows = [(k, k % 37, x.tobytes()) for k, x in enumerate(sets)]
    assert len(rows) > 90
    for left, right in ((rows, None), (rows[:30], rows[30:]), (rows[:1], rows[1:2])):
        every = [(a, b) for a in left for b in right or left if a[1] != b[1] and minhash.similar(sets[a[0]], sets[b[0]], 75)]
        names = {x[0]: x[1] for x in [*left, *(right or [])]}
        found = minhash.joining(left, right, 75)
        assert set(found) <= {(a[0], b[0]) for a, b in every}
        assert union_find([(names[a], names[b]) for a, b in found]) == union_find([(a[1], b[1]) for a, b in every])
        assert len(found) < len(set(names.values()))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    found = {r.v: r.component for r in components(links).collect()}
    assert found == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0


def union_find(links):
    label = {x: x for link in links for x in link}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for link in links:
        x, y = sorted(map(root, link))
        label[y] = x
    return {x: root(x) for x in label}


def random_tree(seed, n):
    r = random.Random(seed)
    ids = r.sample(range(1000), n)
    return [(ids[k], ids[r.randrange(k)]) for k in range(1, n)]


#: Two centres that share a member which is the smallest of neither, and trees that end after a round with two parents.
@pytest.mark.parametrize("links", [[(1, 5), (3, 5), (3, 6), (2, 6)], *(random_tree(s, 8) for s in (16, 24, 25)), random_tree(0, 60)])
def test_components_equal_union_find(spark, links):
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.v, r.component) for r in rows) == sorted(union_find(links).items())


def test_near_duplicates_of_odd_rows(odd, none):
    rows = minhash.near_duplicates(odd.withColumns({"n_shingles": F.lit("a"), "kept": F.lit("b"), "component_id": F.lit("c")})).collect()
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert found == Counter({(1, 0, 1, True): 1, (None, 1, None, True): 1, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (4, 2, 4, True): 2, (5, 2, 4, False): 1, (6, 1, 6, True): 1, (7, 1, 7, True): 1})
    assert minhash.near_duplicates(none).count() == 0
    assert sorted(str(r.doc_id) for r in minhash.keep_first(odd).collect()) == sorted(str(k) for k, *_ in ODD if k != 5)


def test_one_id_with_several_sets(spark):
    """(5, A), (5, B), (3, near A), (8, near B), (9, near B as well): classes are told apart, whatever their ids."""
    a, b = (" ".join(f"{s}{k}" for k in range(60)) for s in "ab")
    c = " ".join(f"c{k}" for k in range(60))
    rows = [(5, a), (5, b), (3, a + " more"), (8, b + " more"), (9, b + " other"), (5, c), (5, c), (4, c + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(df).collect())
    assert found == sorted([(5, 56, 3, False), (3, 57, 3, True), (5, 56, 5, True), (8, 57, 5, False), (9, 57, 5, False), (5, 56, 4, False), (5, 56, 4, False), (4, 57, 4, True)])
    assert sorted((x.doc_id, x.text) for x in minhash.keep_first(df).collect()) == sorted([(3, a + " more"), (5, b), (4, c + " x")])
    alone = [(5, a), (5, c), (3, a + " more")]  # the unique text of a shared id stays
    assert sorted((x.doc_id, x.text) for x in minhash.keep_first(spark.createDataFrame(alone, "doc_id long, text string")).collect()) == sorted(alone[1:])
    same = [(5, b), (5, b + " more")]  # of two sets in one group with one id, one stays
    assert minhash.keep_first(spark.createDataFrame(same, "doc_id long, text string")).count() == 1


def test_heavy_groups_are_joined_whole(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("size"))
    assert join_groups(rows, groups, ["k"], "size", 6000).count() == 6000


# --- media


def filtered_pixel_by_pixel(image, kinds):
    rows = np.zeros((len(image), image.shape[1] + 1), np.uint8)
    for y, kind in enumerate(kinds):
        rows[y, 0] = kind
        for x in range(image.shape[1]):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            near = min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
            rows[y, x + 1] = (int(image[y, x]) - [0, a, b, (a + b) // 2, near][kind]) % 256
    return rows


def test_png_filters():
    r = np.random.default_rng(1)
    images = [r.integers(0, 256, (h, 64), dtype=np.uint8) for h in (7, 1, 30)] + [np.cumsum(r.integers(-3, 4, (9, 64)), axis=1).astype(np.uint8)]
    for kind in range(5):
        files = media.encode_pngs(images, kind)
        assert all((x == y).all() for x, y in zip(media.decode_pngs(files), images, strict=True))
        assert (media.unpacked_png(files[0]) == filtered_pixel_by_pixel(images[0], [kind] * 7)).all()
    mixed = [filtered_pixel_by_pixel(x, [(y + 1) % 5 for y in range(len(x))]) for x in images]
    first = np.concatenate([np.arange(len(x)) == 0 for x in images])
    assert (media.unfilter(np.concatenate(mixed), first) == np.concatenate(images)).all()
    files = media.encode_pngs(images)  # each row by the filter with the least sum
    assert all((x == y).all() for x, y in zip(media.decode_pngs(files), images, strict=True))
    for file, image in zip(files, images, strict=True):
        rows = media.unpacked_png(file)
        every = np.stack([filtered_pixel_by_pixel(image, [kind] * len(image)) for kind in range(5)])
        sums = np.abs(every[:, :, 1:].view(np.int8).astype(int)).sum(axis=2)
        assert (sums[rows[:, 0], np.arange(len(image))] == sums.min(axis=0)).all()
    assert len(set(media.unpacked_png(files[3])[:, 0].tolist()) - {0}) > 0
    wide = np.zeros((3, 5), np.uint8)
    assert [x.shape for x in media.decode_pngs([files[0], *media.encode_pngs([wide])])] == [(7, 64), (3, 5)]
    broken = bytearray(files[0])
    broken[-20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.decode_pngs([bytes(broken)])
    width, height = struct.unpack(">II", files[0][16:24])
    assert (width, height) == (64, 7)


def test_large_images_in_bands(monkeypatch):
    """The same files and samples in bands of a few rows; every filter type on both sides of a band's edge."""
    r = np.random.default_rng(5)
    images = [r.integers(0, 256, (n, 64)).astype(np.uint8) for n in (1, 7, 8, 9, 40)] + [np.frombuffer((b"some words of a text " * 200)[:2560], np.uint8).reshape(-1, 64)]
    ends = np.cumsum([len(x) for x in images])
    first, kinds = np.zeros(ends[-1], bool), r.integers(0, 5, ends[-1])
    first[ends - [len(x) for x in images]] = True
    whole = media.encode_pngs(images), media.filter_rows(np.concatenate(images), first, kinds)
    for band in (1, 4, 8, 13):
        monkeypatch.setattr(media, "BAND", band)
        assert media.encode_pngs(images) == whole[0] and (media.filter_rows(np.concatenate(images), first, kinds) == whole[1]).all()
        assert (media.unfilter(whole[1], first) == np.concatenate(images)).all()
        assert all((a == b).all() for a, b in zip(media.decode_pngs(whole[0]), images, strict=True))


def test_feature_equals_a_plain_cosine_transform():
    r = np.random.default_rng(2)
    for height in (1, 20, 32, 100):
        image = r.integers(0, 256, (height, 64), dtype=np.uint8)
        edges = [k * height // 32 for k in range(33)]
        small = [[float(np.mean([image[y, 2 * x : 2 * x + 2] for y in range(min(edges[k], height - 1), max(edges[k + 1], min(edges[k], height - 1) + 1))])) for x in range(32)] for k in range(32)]
        low = np.array([sum(small[y][x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) * (2 if u and v else 2**0.5 if u or v else 1) / 32 for u in range(8) for v in range(8)])
        low = np.round(low, 6)
        bits = "".join(str(int(k > 0 and c > np.median(low[1:]))) for k, c in enumerate(low))
        assert f"{int(bits, 2):016x}" == media.cosine_hash(image)


def test_cosine_hash_is_near_for_near_images():
    waves = np.random.default_rng(5).normal(size=(8, 8))
    shape = [np.cos(np.pi * (2 * np.arange(n)[:, None] + 1) * np.arange(8) / (2 * n)) for n in (80, 64)]
    image = np.clip(128 + 12 * shape[0] @ waves @ shape[1].T, 0, 250).astype(np.uint8)
    noisy = image.copy()
    noisy[::9, ::9] += 3
    distance = lambda a, b: bin(int(media.cosine_hash(a), 16) ^ int(media.cosine_hash(b), 16)).count("1")
    assert distance(image, noisy) <= 6 < distance(image, np.random.default_rng(2).integers(0, 256, (80, 64), dtype=np.uint8))
    assert len(media.cosine_hash(np.zeros((1, 64), np.uint8))) == 16


def test_media_odd_rows(odd, none):
    rows = media.read_png(media.store_png(odd.select("doc_id", "text", "n_words", F.lit("x").alias("n_bytes"), F.lit("y").alias("media"), F.lit("z").alias("feature")))).collect()
    texts = {k: (t or "").encode() for k, t, _, _ in ODD}
    for r in rows:
        raw = texts[r.doc_id]
        assert r.n_bytes == len(raw) and r.payload_bytes == max(64, -(-len(raw) // 64) * 64) and r.tail_crc32 == zlib.crc32((raw + bytes(-len(raw) % 64 if raw else 64))[-64:])
    assert len(rows) == len(ODD) and media.read_png(media.store_png(none)).count() == 0


# --- URLs


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://net/", "http://NET", "http://a.net/x", "https://example.net/en/", "https://x.example.net/en/1?q=/de/", "http://notexample.net/en/", "http://example.com/de/#f", "http://example.com/de", "http://a.org/fr/b", "http://a.org/en/fr/", "http://x.com/a.net/", "http://net:80/", "http://é.net/é", "http://a.net?x=/y", "http://" + "a" * 300 + ".net/" + "b" * 3000]
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    for r in url_filter.filter_urls(df, rules, default="other").collect():
        rest = (r.url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [x for x in rules if ("." + host).endswith("." + x.partition("/")[0]) and path.startswith("/" + x.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, rules.get(rule, "other")), r
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_globs_equal_fnmatch():
    from fnmatch import fnmatchcase

    r = random.Random(4)
    globs = ["".join(r.choice("ab*") for _ in range(r.randrange(1, 30))) for _ in range(60)]
    globs = [x for x in globs if x.strip("*")]
    texts = ["".join(r.choice("ab") for _ in range(r.randrange(0, 25))) for _ in range(80)]
    automaton = url_filter.GlobSet([["*" if c == "*" else ord(c) for c in x] for x in globs])
    raw = "".join(texts).encode()
    found = automaton.run(np.frombuffer(raw, np.uint8).astype(np.int16), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
    assert automaton.n_words > 4
    assert found.tolist() == [[fnmatchcase(t, x) for x in globs] for t in texts]


def test_many_rows_are_ordered_in_more_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_PART", 50)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    ordered = mixing.in_order(mixing.mix(df, {"a": 1, "b": 2}, block_rows=5))
    assert ordered.rdd.getNumPartitions() == 20
    places = [(r.slot, r.place) for r in ordered.select("slot", "place").collect()]
    assert places == sorted(places) and len(places) == 1000
