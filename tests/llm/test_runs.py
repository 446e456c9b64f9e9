import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import queries, runs


def brute(w, least, times):
    n, out, seen = len(w), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and (i, j + q) not in seen:
                seen.add((i, j + q))
                if j + q - i >= max(least, times * q):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(r, n, kinds):
    w = []
    while len(w) < n:
        part = [r.randrange(kinds) for _ in range(r.randrange(1, 12))]
        w += (part * r.randrange(1, 9))[: r.randrange(1, 60)]
    return w[:n]


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


@pytest.mark.parametrize("kinds", [1, 2, 3, 20])
def test_all_runs_equal_brute_force(kinds):
    r = random.Random(kinds)
    for _ in range(60):
        w = periodic(r, r.randrange(0, 200), kinds)
        assert runs.runs(w, 2, 2) == brute(w, 2, 2)
        assert runs.runs(w, 24, 3) == brute(w, 24, 3)


def test_zones_hold_every_run():
    r = random.Random(9)
    for _ in range(40):
        texts = [periodic(r, r.randrange(0, 400), r.choice([2, 5, 50])) for _ in range(5)]
        at = np.cumsum([0, *map(len, texts)])
        begin, end = runs.zones(np.array(sum(texts, []), np.int32), at, 24, 3)
        for k, w in enumerate(texts):
            for s, n, _ in brute(w, 24, 3):
                assert any(a <= at[k] + s and at[k] + s + n <= b <= at[k + 1] for a, b in zip(begin, end, strict=True))


def test_a_long_text_of_one_word_or_period():
    for w, want in (([7] * 300_000, (0, 300_000, 1)), ((list(range(1000)) * 100)[:99_999], (0, 99_999, 1000))):
        assert runs.runs(w, 24, 3) == [want]


def test_runs_of_texts(spark):
    r = random.Random(4)
    texts = [" ".join(f"w{x}" if x else "é　b" for x in periodic(r, r.randrange(0, 500), r.choice([2, 6, 60]))) for _ in range(60)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for row in runs.find_runs(rows).withColumn("best", runs.strongest(F.col("runs"))).collect():
        w = texts[row.doc_id].split(" ") if texts[row.doc_id] else []
        want = brute(w, 24, 3)
        assert [tuple(x) for x in row.runs] == want and row.n_words == len(w) and row.collapsed_text == " ".join(collapsed(w, want))
        assert (tuple(row.best) if row.best else None) == (max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if want else None)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (None, "x " * 30, None), (2, "", ""), (3, " \n\t\x0b ", None), (4, "one two " * 40, "1"), (4, "one two " * 40, "1"), (5, "long " * 500_000, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed_text", F.lit(3)).repartition(2)
    out = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in runs.find_runs(df).collect())
    assert out == [("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("4", 80, [(0, 80, 2)], "one two"), ("4", 80, [(0, 80, 2)], "one two"), ("5", 500_000, [(0, 500_000, 1)], "long"), ("None", 30, [(0, 30, 1)], "x")]
    assert runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(df, least=10)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op12_runs(spark, sf_dir).collect()
    assert len(rows) == len(docs) and sum(r.n_runs for r in rows) > 10
    for row in rows:
        w = planted(row.doc_id, docs[row.doc_id].encode().split())
        want = brute(w, 24, 3)
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2])) if want else (None,) * 3
        assert (row.n_runs, row.start, row.length, row.period) == (len(want), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(collapsed(w, want))).hexdigest()
