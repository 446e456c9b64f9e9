"""Substring deduplication: every word under a window of `window` words whose sequence also starts elsewhere is removed.

Pass one counts. Each window is represented by its smallest hash of `gram` words, so that all places of a window have the
same representative and about one word in fifteen is one. Each task puts its representatives in a count-min sketch of two
rows; the partitions' sketches are merged, segment by segment, and overestimate how often a representative, and so any of
its windows, starts. Pass two groups exactly, by 128 bits of all its words (two hashes with nothing in common), each window whose estimate is two or more. A
task first groups its own windows and sends one row for each different one, so that the most frequent window has one row
for each task. No window that repeats can be lost: an estimate is never too low.

The sketch is broadcast. Its width follows the input up to `most_cells` (2 * most_cells / 8 bytes); beyond that, more
windows reach the exact pass and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._schema import extended
from ._scratch import map_batches
from ._text import mix, pieces, row_of, runs_hash, window_starts, windows, with_columns, word_hashes, words

LARGEST = np.uint64(2**64 - 1)
SEGMENT_BITS = 20
#: place is start << 32 | stop, in words, of a window that its task has once; -1 for one that the task has more often, which
#: counts as two; -2 - place for a run of windows that are known to repeat.
ASK = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("key", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int64())])


def slide(x: np.ndarray, k: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of k values, in log k steps."""
    done = 1
    while done < k:
        step = min(done, k - done)
        x, done = pick(x[:-step], x[step:]), done + step
    return x


def representatives(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, the representative of each, and the representatives by place (each place once)."""
    starts = window_starts(offsets, window)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    span = window - gram + 1
    at, hashes = windows(values, offsets, gram, 3)
    grams = np.full(len(values), LARGEST)
    grams[at] = hashes
    least = slide(grams, span, np.minimum)[starts]
    over = np.zeros(len(values) + span - 1, np.uint64)
    over[starts + span - 1] = least
    return starts, least, grams[(slide(over, span, np.maximum) == grams) & (grams != LARGEST)]


def cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in either row of the sketch."""
    return [(h >> np.uint64(64 - bits)).astype(np.uint32) for h in (mix(hashes, 11), mix(hashes, 12))]


def sketch_bits(documents: DataFrame, text: str, most_cells: int) -> int:
    """About eight cells for each representative, of which there is one for 95 bytes of text or so."""
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(16, min(most_cells.bit_length() - 1, (size // 12).bit_length()))


def repeated_cells(documents: DataFrame, text: str, window: int, gram: int, bits: int) -> list[bytes]:
    """For each row of the merged sketch, a bit for each cell that counted two or more."""
    low = min(bits, SEGMENT_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sketch(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for row, cell in enumerate(cells(np.concatenate(found), bits)):
                which, n = np.unique(cell, return_counts=True)
                segment = which >> np.uint32(low)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(which)]])
                rows = [{"segment": (row << (bits - low)) + int(segment[a]), "cells": (which[a:b] & np.uint32((1 << low) - 1)).tobytes(), "counts": np.minimum(n[a:b], 255).astype(np.uint8).tobytes()} for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("segment", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())]))

        found, size = [], 0
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column(0)):
                starts, ends, rows = words(data, offsets)
                new = representatives(word_hashes(data, starts, ends, 11)[0], rows, window, gram)[2]
                found, size = [*found, new], size + len(new)
                if size > 1 << 18:
                    yield from sketch(found)
                    found, size = [], 0
        if size:
            yield from sketch(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})

        for batch in batches:
            for segment, cell, n in zip(*(batch.column(k).to_pylist() for k in ("segment", "cells", "counts")), strict=True):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, total = segment, np.zeros(1 << low, np.uint8)
                cell, n = np.frombuffer(cell, np.uint32), np.frombuffer(n, np.uint8)
                total[cell] = np.minimum(total[cell].astype(np.uint16) + n, 255).astype(np.uint8)
        if now is not None:
            yield done()

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = map_batches(documents.select(text), count, "segment int, cells binary, counts binary")
    merged = map_batches(sketches.repartition(parts, "segment").sortWithinPartitions("segment"), merge, "segment int, bits binary")
    planes = np.zeros((2 << (bits - low), 1 << low >> 3), np.uint8)
    for row in merged.toLocalIterator():  # of bounded size: 2 * most_cells bits
        planes[row.segment] = np.frombuffer(row.bits, np.uint8)
    return [x.tobytes() for x in planes.reshape(2, -1)]


def may_repeat(hashes: np.ndarray, planes: list[np.ndarray], bits: int) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for plane, cell in zip(planes, cells(hashes, bits), strict=True):
        hit &= (plane[cell >> np.uint32(3)] >> (np.uint32(7) - (cell & np.uint32(7))).astype(np.uint8)) & 1 == 1
    return hit


def _questions(h1: np.ndarray, h2: np.ndarray, row: np.ndarray, start: np.ndarray, keys: np.ndarray, texts: np.ndarray, window: int) -> pa.RecordBatch:
    """One row for each different window of a task: with its place if it is there once. Windows that a task has twice or
    more are known to repeat; their places follow as runs, each under a key of its own."""
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    lead = order[first]
    once = n == 1
    known = np.sort(order[np.repeat(~once, n)])  # places come in order of row and start
    breaks = np.ones(len(known), bool)
    breaks[1:] = (row[known][1:] != row[known][:-1]) | (start[known][1:] != start[known][:-1] + 1)
    a = np.flatnonzero(breaks)
    b = np.append(a[1:], len(known)) - 1 if len(a) else a
    run_key = mix(texts[row[known[a]]].astype(np.uint64) + mix(start[known[a]].astype(np.uint64), 5), 6)
    parts = [
        np.concatenate([h1[lead], run_key]).astype(np.int64), np.concatenate([h2[lead], mix(run_key, 7)]).astype(np.int64),
        np.concatenate([keys[row[lead]], keys[row[known[a]]]]), np.concatenate([texts[row[lead]], texts[row[known[a]]]]),
        np.concatenate([np.where(once, start[lead] << 32 | (start[lead] + window), -1), -2 - (start[known[a]] << 32 | (start[known[b]] + window))]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], schema=ASK)


def repeated_ranges(documents: DataFrame, text: str, window: int, gram: int, most_cells: int) -> DataFrame:
    """key and text_hash of a document, and the ranges (start << 32 | stop) of words that windows cover which start elsewhere too."""
    spark = documents.sparkSession
    bits = sketch_bits(documents, text, most_cells)
    planes = spark.sparkContext.broadcast(repeated_cells(documents, text, window, gram, bits))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = [np.frombuffer(x, np.uint8) for x in planes.value]
        held: list[tuple] = []
        size = rows_held = 0
        for batch in batches:
            keys, texts = (np.asarray(batch.column(k)) for k in ("key", "text_hash"))
            for lo, hi, data, offsets in pieces(batch.column(text)):
                starts, ends, at = words(data, offsets)
                values = word_hashes(data, starts, ends, 11, 12)
                begin, least, _ = representatives(values[0], at, window, gram)
                begin = begin[may_repeat(least, bitmaps, bits)]
                if len(begin):
                    row = row_of(at)[begin]
                    hashes = [runs_hash(v, window, seed)[begin] for seed, v in zip((1, 2), values, strict=True)]
                    held.append((*hashes, row + rows_held, begin - at[row], keys[lo:hi], texts[lo:hi]))
                    size, rows_held = size + len(begin), rows_held + hi - lo
                    if size > 1 << 18:
                        yield _questions(*(np.concatenate(x) for x in zip(*held, strict=True)), window)
                        held, size, rows_held = [], 0, 0
        if size:
            yield _questions(*(np.concatenate(x) for x in zip(*held, strict=True)), window)

    asked = map_batches(documents.select(F.coalesce(F.col("key"), F.lit(-1)).alias("key"), "text_hash", text), ask, "h1 long, h2 long, key long, text_hash long, place long")
    counted = asked.withColumn("total", F.sum(F.when(F.col("place") < 0, 2).otherwise(1)).over(Window.partitionBy("h1", "h2"))).filter("total >= 2 AND place <> -1")
    place = F.when(F.col("place") < 0, -2 - F.col("place")).otherwise(F.col("place"))
    return counted.groupBy("key", "text_hash").agg(F.collect_set(place).alias("ranges"))  # once each, however often the row is repeated


def remove_repeats(documents: DataFrame, text: str = "text", key: str = "doc_id", window: int = 35, gram: int = 8, most_cells: int = 1 << 28) -> DataFrame:
    """documents with n_words and n_removed (long) and kept_text (the words left, joined by one space).

    Words are runs without ASCII white space. Windows are judged on the input, over all rows: every copy goes, also the
    first. A null text has no words. Texts under `window` words lose nothing. Rows repeated in full repeat each other. A
    null key is a key like others. Input columns with a result's name are replaced.
    """
    new = ["n_words", "n_removed", "kept_text"]
    rows = documents.drop(*(c for c in new if c not in (text, key))).withColumn("_text_hash", F.xxhash64(F.coalesce(text, F.lit(""))))
    short = rows.select(F.col(key).cast("long").alias("key"), F.col("_text_hash").alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ranges = repeated_ranges(short, "_text", window, gram, most_cells).withColumnsRenamed({"key": "_key", "text_hash": "_hash", "ranges": "_ranges"})
    joined = rows.join(ranges, (F.coalesce(F.col(key).cast("long"), F.lit(-1)) == F.col("_key")) & (F.col("_text_hash") == F.col("_hash")), "left").drop("_key", "_hash", "_text_hash")
    schema = extended(joined.drop("_ranges").schema, "n_words long, n_removed long, kept_text string")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts, removed, kept = [], [], []
                for body, spans in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("_ranges").to_pylist(), strict=True):
                    found = (body or b"").split()  # bytes.split takes the same white space
                    n = len(found)
                    if spans:
                        step = np.zeros(n + 1, np.int32)
                        np.add.at(step, np.array(spans) >> 32, 1)
                        np.add.at(step, np.array(spans) & 0xFFFFFFFF, -1)
                        found = [w for w, covered in zip(found, np.cumsum(step)[:-1].tolist(), strict=True) if not covered]
                    counts.append(n)
                    removed.append(n - len(found))
                    kept.append(b" ".join(found))
                yield with_columns(batch, {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}, schema.names)

    return map_batches(joined, strip, schema)
