"""The whole pipeline against plain loops, stage by stage from the classifier's own decisions on (SQL can't express these)."""

from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_removed
from trajlake.llm import minhash, sentencepiece


def brute_mixing(docs, block_rows=64, exponent=0.5, period=1000):
    """doc_id -> (slot, place): sources in hashed order of ids, blocks by earliest deadline first over repeated periods."""
    counts = Counter(s for _, s in docs)
    total = sum(n**exponent for n in counts.values())
    parts = {s: max(1, int(np.floor(period * n**exponent / total + 0.5))) for s, n in counts.items()}
    whole, done, slots = sum(parts.values()), Counter(), {s: [] for s in parts}
    for t in range(whole):
        ready = [(-(-(done[s] + 1) * whole // parts[s]), s) for s in sorted(parts) if done[s] < parts[s] and done[s] * whole // parts[s] <= t]
        chosen = min(ready)[1]
        done[chosen] += 1
        slots[chosen].append(t)
    out = {}
    for s in parts:
        order = sorted((k for k, x in docs if x == s), key=lambda k: (xxhash.xxh64_intdigest(int(k).to_bytes(8, "little", signed=True), seed=42) >> 1, k))
        for i, k in enumerate(order):
            block = i // block_rows
            out[k] = (block // parts[s] * whole + slots[s][block % parts[s]], i % block_rows)
    return out


def test_pipeline_equals_plain_loops(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id: r for r in corpus_pipeline.good_quality(spark, docs, sf_dir).collect()}
    assert 0 < len(good) < docs.count()
    kept = {d: good[d].text for d, (_, component) in brute_components({d: r.text for d, r in good.items()}).items() if d == component}
    cut = dict(zip(kept, brute_removed(list(kept.values()), 35), strict=True))
    texts = {d: t if len(cut[d].split()) == len(t.encode().split()) else cut[d] for d, t in kept.items()}
    places = brute_mixing([(d, good[d].source) for d in texts])
    own = sentencepiece.pieces_of(sentencepiece.DEFAULT_MODEL)
    want = {d: (good[d].source, *places[d], tuple(own.encode([t])[0].tolist())) for d, t in texts.items()}
    found = {r.doc_id: (r.source, r.slot, r.place, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert found == want


def test_near_duplicates_join_only_bands_of_large_buckets(spark, monkeypatch):
    base = [f"word{k}" for k in range(60)]
    texts = [" ".join(base[:d] + [f"x{d}"] + base[d + 1 :]) for d in range(20)] + [" ".join(f"w{k}x{i}" for i in range(8)) for k in range(500)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    join_groups, joined = minhash.join_groups, []

    def counting(rows, groups, keys, size, total):
        if keys == ["key"]:
            joined.append(rows.count())
        return join_groups(rows, groups, keys, size, total)

    monkeypatch.setattr(minhash, "join_groups", counting)
    stays = sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert stays == [0, *range(20, 520)]
    assert 0 < max(joined) <= 2 * 20 * minhash.BANDS  # all bands: 520 * BANDS
