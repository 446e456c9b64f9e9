import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import phrases

DDL = "doc_id long, text string, lang string, n long"


def brute(rows, longest=3, least=10, share=50, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in ((t, "und" if g is None else g) for t, g in rows):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = [x for x in re.split("[ \t]", piece) if x]
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        chosen = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in chosen.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(covered[p[i : i + m]], a)
        told = []
        for p, a in chosen.items():
            if not covered[p] or 100 * covered[p] < share * a:
                s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                told.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, totals[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(told)[:top], 1)]
    return sorted(out)


def sentences(seed, n, words=12):
    r = random.Random(seed)
    return [(" ".join(r.choice(["The", "the", "a", "é", "deep\tsea", "x"]) + (str(int(r.random() ** 3 * words)) if r.random() < 0.8 else r.choice(". , ; ! \n \r".split(" "))) for _ in range(r.randrange(0, 150))), r.choice(["en", "de", None, ""])) for _ in range(n)]


def found(spark, rows, **options):
    df = spark.createDataFrame([(k, t, g, k) for k, (t, g) in enumerate(rows)], DDL).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize(("heavy", "together", "most"), [(4096, 8 << 20, 1 << 20), (0, 1 << 10, 20), (40, 1 << 12, 100)])
def test_collocations_equal_brute_force(spark, monkeypatch, heavy, together, most):
    for name, value in (("LEAST_HEAVY", heavy), ("TOGETHER", together), ("MOST_HELD", most)):  # all buckets are split, or some
        monkeypatch.setattr(phrases, name, value)
    rows = sentences(3, 120)
    monkeypatch.setattr(phrases, "BUCKET", 1000)
    assert len(brute(rows)) > 50
    assert found(spark, rows) == brute(rows)


def test_other_parameters(spark):
    rows = sentences(4, 60, 4)
    assert found(spark, rows, longest=4, least=4, share=80, top=7) == brute(rows, 4, 4, 80, 7)
    assert found(spark, rows, longest=2, least=2) == brute(rows, 2, 2)


def test_parts_equal_plain_counts():
    r = np.random.default_rng(2)
    for n, words, least in ((0, 3, 1), (1, 1, 1), (500, 3, 1), (500, 5, 12), (3000, 40, 9)):
        keys = r.integers(0, words, (n, 3)).astype(np.int32)
        keys[r.random(n) < 0.2, 2] = -1
        keys[r.random(n) < 0.1, 1:] = -1
        weights = r.integers(1, 4, n)
        ones, _ = phrases.equal_parts(keys, None, least)
        assert sorted(map(tuple, ones.tolist())) == sorted(map(tuple, phrases.equal_parts(keys, np.ones(n), least)[0].tolist()))
        inner, whole = phrases.equal_parts(keys, weights, least)
        plain, full = Counter(), Counter()
        for key, w in zip(keys.tolist(), weights.tolist(), strict=True):
            key = tuple(x for x in key if x >= 0)
            full[key] += w
            for m in range(1, len(key) + 1):
                plain[key[:m]] += w
        assert sorted((tuple(keys[p, :m]), w) for p, m, w in inner.tolist()) == sorted((k, v) for k, v in plain.items() if v >= least)
        assert sorted((tuple(x for x in keys[p] if x >= 0), w) for p, _, w in whole.tolist()) == sorted((k, v) for k, v in full.items() if v >= least)


def test_scores_past_64_bits(spark):
    big = [(10**12, 10**12 + 7, 10**12 + 9), (3 * 10**13, 3 * 10**13, 9 * 10**13), (10, 10**15, 10**15)]
    out = spark.createDataFrame(big, "a long, l long, r long").select("a", phrases.score("a", "l", "r").alias("s")).collect()
    assert {r.a: r.s for r in out} == {a: 1000000 * a * a // (left * right) for a, left, right in big}


def test_odd_rows(spark):
    clash = {c: F.lit("z") for c in ("phrase", "rank", "bucket", "salt", "words", "f", "part")}
    rows = [(1, None, None, 1), (None, "", "en", None), (2, " \n\t.,", "en", 3), (3, "go " * 60_000, "xx", 0), *[(4, "A b. A b! c", None, 2)] * 11, (5, "w" * 3_000_000, "en", 1)]
    df = spark.createDataFrame(rows, DDL).withColumns(clash).repartition(2)
    out = sorted(tuple(r) for r in phrases.collocations(df).collect())
    assert out == brute([(t, g) for _, t, g, _ in rows])
    assert ("und", 1, "a b", 22, 22, 22, 55, 1000000) in out
    assert phrases.collocations(df.limit(0)).count() == 0
