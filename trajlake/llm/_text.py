"""Whole-batch text work in numpy: words and hashes straight from Arrow's UTF-8 buffers.

A word's hash is the sum of its scrambled chunks of eight bytes, each crossed with a scramble of its place; the hash of a
run of words is built by doubling (two halves of 2**j words are scrambled into one). No step is linear, so that no pattern
of bytes or words cancels out. Two seeds give two hashes that have nothing in common but the input: 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (two multiply and xor-shift rounds)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    """One hash of two, in this order."""
    return mix(left * np.uint64(0x9FB21C651E98DF25) + right, seed)


def runs_hash(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The hash of values[i:i + k] for each i from 0 to len(values) - k."""
    out, have, span, power = None, 0, 1, values
    while True:
        if k & span:
            n = len(values) - have - span + 1
            out = power[:n] if out is None else joined(out[:n], power[have : have + n], seed + 1)
            have += span
        span *= 2
        if span > k:
            return out
        power = joined(power[: -(span // 2)], power[span // 2 :], seed)


def short_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The hash of values[start:end] for each pair: for a few values each."""
    n = ends - starts
    out = mix(n.astype(np.uint64), seed)
    for i in range(int(n.max(initial=0))):
        more = np.flatnonzero(n > i)
        out[more] = joined(out[more], values[starts[more] + i], seed)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo:hi with their bytes and offsets, about `most` bytes at a time, a longer text alone: bounds the memory."""
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without SPACE, never across rows), and the offsets of the rows in them."""
    n = len(data)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~solid[:-1]
    after[:-1] |= ~solid[1:]
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every word's chunks of eight bytes, the last filled up with zeros; the place of each in its word; each word's first."""
    n = (ends - starts + 7) >> 3
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    at = np.repeat(starts, n) + 8 * place
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    values = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    left = np.repeat(ends, n) - at
    last = np.flatnonzero(left < 8)
    values[last] &= (np.uint64(1) << (8 * left[last]).astype(np.uint64)) - np.uint64(1)
    return values, place, first


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *seeds: int) -> list[np.ndarray]:
    """For each seed, the hashes of the words data[start:end], none of them empty."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in seeds]
    values, place, first = chunks(data, starts, ends)
    place, lengths = place.astype(np.uint64), (ends - starts).astype(np.uint64)
    return [mix(np.add.reduceat(mix(values ^ mix(place, seed), seed + 1), first) + lengths, seed) for seed in seeds]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each element, the row that it lies in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def window_starts(offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of all runs of k values within a row."""
    starts = np.arange(max(0, int(offsets[-1]) - k + 1))
    return starts[starts + k <= np.repeat(offsets[1:], np.diff(offsets))[: len(starts)]]


def windows(values: np.ndarray, offsets: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of k values within a row, and their hashes."""
    starts = window_starts(offsets, k)
    return starts, runs_hash(values, k, seed)[starts] if len(starts) else np.zeros(0, np.uint64)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def strings(values: list[str | None]) -> pa.Array:
    return pa.array(values, pa.string())


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], order: list[str]) -> pa.RecordBatch:
    """The batch with columns added; an input column of the same name gives way."""
    have = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)} | new
    return pa.RecordBatch.from_arrays([have[n] for n in order], names=order)
