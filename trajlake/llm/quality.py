"""A quality classifier from supervised subword embeddings.

A document is the mean of the learned vectors of its words, of its pairs of neighbouring words and of its character n-grams,
all hashed to a table of 2**bits rows; a softmax layer over that mean gives the probability of label 1. All weights are learned by stochastic gradient
descent in numpy, document by document. Only a bounded sample of labelled rows is learned from (`most_labelled`, those with
the smallest hash of their id); every document is scored. As the layer behind the mean is linear, a trained model comes
down to one weight for each row of the table, and a score to a mean of weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import drop, kept
from ._schema import extended
from ._scratch import map_batches
from ._text import lower, pieces, windows, with_columns, word_hashes, words

#: Lengths of n-grams, in words and in code points.
WORD_GRAMS, GRAMS = (1, 2), (2, 3)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of words and of code points (A-Z lowered), grouped by text, and the texts' offsets in them."""
    data = lower(data)
    starts, ends, at = words(data, offsets)
    values, found = word_hashes(data, starts, ends, 11)[0], []
    for n in WORD_GRAMS:
        where, hashes = windows(values, at, n, n)
        found.append((hashes, np.searchsorted(where, at)))
    points = np.frombuffer(data.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]  # code points before each text
    for n in GRAMS:
        where, hashes = windows(points, begins, n, 20 + n)
        found.append((hashes, np.searchsorted(where, begins)))
    total = sum(x[1] for x in found)
    out = np.empty(total[-1], np.uint32)
    filled = total[:-1].copy()
    for hashes, at in found:
        n = np.diff(at)
        out[np.arange(len(hashes)) + np.repeat(filled - at[:-1], n)] = (hashes >> np.uint64(64 - bits)).astype(np.uint32)
        filled = filled + n
    return out, total


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], bits: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """A weight for each table row and a bias, from (table rows, how often each occurs, label) by document."""
    n_one = sum(y for _, _, y in samples)
    if n_one in (0, len(samples)):  # nothing to tell apart: the share of label 1, smoothed
        return np.zeros(1 << bits, np.float32), float(np.log((n_one + 1) / (len(samples) - n_one + 1)))
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for k in random.permutation(len(samples)):
            rows, counts, label = samples[k]
            speed = rate * (1 - done / steps)
            done += 1
            share = counts / max(1, counts.sum())
            mean = share @ table[rows] if len(rows) else np.zeros(dim, np.float32)
            logits = mean @ layer + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = layer @ wrong
            layer -= speed * np.outer(mean, wrong)
            bias -= speed * wrong
            if len(rows):
                table[rows] -= np.outer(speed / (share @ share) * share, back)  # so that the mean moves by speed * back, however long the text
    toward = layer[:, 1] - layer[:, 0]
    return table @ toward, float(bias[1] - bias[0])


def fold(key: str = "doc_id") -> F.Column:
    """crc32 of the key as text, modulo 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = 3000, most_bytes: int = 256 << 20, bits: int = 18, dim: int = 16, epochs: int = 12, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Learn from labelled rows whose fold isn't 0. Rows with a null id, label or no document are left out; of an id that is
    labelled more than once the largest label counts, of one with several texts the text with the smallest hash.

    The driver gets the features of most_labelled texts, and no more than most_bytes of them: in the order of the ids' hashes,
    those that go beyond are left out of the sample."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # most_labelled rows bound what is broadcast
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text"))["text"].alias("text"), F.first("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("text")):
                found, at = features(data, offsets, bits)
                counted = [np.unique(found[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[lo:hi], "label": batch.column("label")[lo:hi],
                    "rows": pa.array([x[0].astype(np.uint32).tobytes() for x in counted], pa.binary()), "counts": pa.array([x[1].astype(np.uint32).tobytes() for x in counted], pa.binary()),
                })

    found, rows, size = kept(map_batches(texts, run, "doc_id long, label int, rows binary, counts binary"), "features"), [], 0
    for row in found.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        size += len(row.rows) + len(row.counts)
        if size > most_bytes:
            break
        rows.append(row)
    drop(found)
    rows.sort(key=lambda r: r.doc_id)
    samples = [(np.frombuffer(r.rows, np.uint32), np.frombuffer(r.counts, np.uint32).astype(np.float32), r.label) for r in rows]
    return train(samples, bits, dim, epochs, rate, seed) if samples else (np.zeros(1 << bits, np.float32), 0.0)


def score(documents: DataFrame, model: tuple[np.ndarray, float], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """documents with score (double, 0 to 1) and predicted (int). A null or empty text gets the score of the bias alone;
    columns of these names are replaced."""
    sent, bits = documents.sparkSession.sparkContext.broadcast(model), int(len(model[0])).bit_length() - 1
    schema = extended(documents.schema, "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        weights = weights.astype(np.float64)
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(text)):
                found, at = features(data, offsets, bits)
                n = np.diff(at)
                mean = np.zeros(hi - lo)
                if full := np.flatnonzero(n).tolist():
                    mean[full] = np.add.reduceat(weights[found], at[full]) / n[full]
                p = 1 / (1 + np.exp(-np.clip(mean + bias, -700, 700)))
                yield with_columns(batch.slice(lo, hi - lo), {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}, schema.names)

    return map_batches(documents, run, schema)
