"""Periodic runs of words: a suffix automaton whose tree of suffix links is accessed by link-cut paths.

The words so far end at a state of the automaton; its path to the root holds all their suffixes. Every path segment of the
link-cut forest carries one colour, the place where its substrings ended last. The access of a new word's state passes
from segment to segment: where the distance to the last end is no more than the length of the segment's deepest state,
the two occurrences touch or overlap, which is a square; then the whole path takes the new place as its colour. Squares
are extended to both sides by comparing words. Every primitive square is met, so every run is.

Only stretches that can hold a wanted run go through the automaton: in a run of period q every group of GRAM words is
there again q words further or before, so groups without an equal one near enough cut a text into zones, and most texts have none.
Memory is about 80 bytes for each word of a zone. Words are numbered by their bytes; only zones are found by hashes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._schema import extended
from ._scratch import map_batches
from ._text import SPACE, joined, mix, pieces, row_of, windows, with_columns, words

GRAM = 8
RUNS = "array<struct<start: long, length: long, period: long>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SuffixTree:
    """The suffix automaton of a sequence: suffix links and lengths of its states (1 is the root, 0 none), and the state of
    each prefix. A state's first transition is in two arrays, further ones in a dictionary."""

    def __init__(self, sequence: list[int]):
        size = 2 * len(sequence) + 2
        self.link, self.length, self.prefix = array("i", bytes(4 * size)), array("i", bytes(4 * size)), array("i")
        self.word, self.to, self.more, self.n = array("q", [-1]) * size, array("i", bytes(4 * size)), {}, 1
        for value in sequence:
            self.prefix.append(self._extended(self.prefix[-1] if self.prefix else 1, value))

    def _extended(self, last: int, value: int) -> int:
        link, length, word, to, more = self.link, self.length, self.word, self.to, self.more
        self.n = new = self.n + 1
        length[new] = length[last] + 1
        at, target = last, 0
        while at:
            if word[at] == value:
                target = to[at]
                break
            if word[at] < 0:
                word[at], to[at] = value, new
            else:
                others = more.setdefault(at, {})
                if value in others:
                    target = others[value]
                    break
                others[value] = new
            at = link[at]
        if not at:
            link[new] = 1
        elif length[target] == length[at] + 1:
            link[new] = target
        else:
            self.n = copy = self.n + 1
            length[copy], link[copy], word[copy], to[copy] = length[at] + 1, link[target], word[target], to[target]
            if target in more:
                more[copy] = dict(more[target])
            link[target] = link[new] = copy
            while at:
                if word[at] == value:
                    if to[at] != target:
                        break
                    to[at] = copy
                elif more[at][value] != target:
                    break
                else:
                    more[at][value] = copy
                at = link[at]
        return new


class Paths:
    """A link-cut forest over a tree of parents: each path is a splay tree by depth, its root has the path's colour."""

    def __init__(self, parents: array, n: int):
        self.up, self.left, self.right, self.colour = array("i", parents[: n + 1]), array("i", bytes(4 * n + 4)), array("i", bytes(4 * n + 4)), array("i", [-1]) * (n + 1)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def access(self, state: int, colour: int) -> list[tuple[int, int]]:
        """(deepest state, colour) of each segment between the state and the root; then all of them have the new colour."""
        up, right, colours = self.up, self.right, self.colour
        met, below = [], 0
        while state:
            self._splay(state)
            if (old := colours[state]) >= 0:
                met.append((state, old))
            if right[state]:
                colours[right[state]] = old
            right[state] = below
            below, state = state, up[state]
        colours[below] = colour
        return met


def runs(sequence: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs with length >= max(least, times * period), by start and period."""
    tree = SuffixTree(sequence)
    paths = Paths(tree.link, tree.n)
    n, reached, seen, out = len(sequence), {}, set(), []
    for here, state in enumerate(tree.prefix):
        for deepest, before in paths.access(state, here):
            period = here - before
            if tree.length[deepest] < period or here < reached.get(period, 0):
                continue
            lo, hi = here - 2 * period + 1, here + 1
            while lo and sequence[lo - 1] == sequence[lo - 1 + period]:
                lo -= 1
            while hi < n and sequence[hi] == sequence[hi - period]:
                hi += 1
            reached[period] = hi
            if (lo, hi) not in seen:  # else the same stretch has a smaller period, which divides this one
                seen.add((lo, hi))
                if hi - lo >= max(least, times * period):
                    out.append((lo, hi - lo, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def zones(ids: np.ndarray, at: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in words of the batch, of the stretches that hold all wanted runs of the texts (offsets `at`).

    A run of length n is a stretch of n - GRAM + 1 groups of GRAM words, each with an equal one within n / times words.
    """
    groups = least - GRAM + 1
    starts, hashes = windows(mix(ids.astype(np.uint64), 51), at, GRAM, 52)
    row = row_of(at)[starts]
    key = joined(hashes, row.astype(np.uint64), 53)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    apart = np.where(same, starts[order][1:] - starts[order][:-1], np.iinfo(np.int64).max)
    near = np.full(len(starts), np.iinfo(np.int64).max)
    near[order[:-1]] = apart
    near[order[1:]] = np.minimum(near[order[1:]], apart)
    left = np.flatnonzero(near <= np.diff(at)[row] // times)
    while True:
        new = np.ones(len(left), bool)
        new[1:] = (starts[left][1:] != starts[left][:-1] + 1) | (row[left][1:] != row[left][:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(left)))
        length = np.repeat(size, size)
        stays = (length >= groups) & (near[left] <= (length + GRAM - 1) // times)
        if stays.all():
            return starts[left[first]], starts[left[first]] + size + GRAM - 1
        left = left[stays]


def find_runs(documents: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """documents with n_words (long), runs (start, length and smallest period in words, by start, then period) and collapsed_text
    (words joined by one space, without those that lie in a run behind its first period).

    Words are runs without ASCII white space, compared by their bytes. A run is a stretch of max(least, times * period)
    words or more in which words `period` apart are equal, that no neighbouring word continues; least is 2 * GRAM + times or more, times 3 or more
    (ValueError otherwise). A null or empty text has no words and no runs; repeated rows are judged each; columns called
    like results are replaced.
    """
    if least < 2 * GRAM + 3 or times < 3:
        raise ValueError("runs of less than 19 words, or of less than three periods, are not found")
    schema = extended(documents.schema, f"n_words long, runs {RUNS}, collapsed_text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(text)):
                starts, ends, at = words(data, offsets)
                solid = data[~SPACE[data]]
                bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
                coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(solid)]).dictionary_encode()
                ids = np.asarray(coded.indices)
                found = [[] for _ in range(lo, hi)]
                gone = np.zeros(len(ids), bool)
                for a, b in zip(*(x.tolist() for x in zones(ids, at, least, times)), strict=True):
                    row = int(np.searchsorted(at, a, "right")) - 1
                    for start, length, period in runs(ids[a:b].tolist(), least, times):
                        found[row].append({"start": a + start - int(at[row]), "length": length, "period": period})
                        gone[a + start + period : a + start + length] = True
                told = []
                for row in range(hi - lo):
                    body = data[offsets[row] : offsets[row + 1]].tobytes().split()  # at the same white space
                    if found[row]:
                        body = [w for w, out in zip(body, gone[at[row] : at[row + 1]].tolist(), strict=True) if not out]
                    told.append(b" ".join(body))
                new = {"n_words": pa.array(np.diff(at)), "runs": pa.array(found, RUN_TYPE), "collapsed_text": pa.array(told, pa.binary()).cast(pa.string())}
                yield with_columns(batch.slice(lo, hi - lo), new, schema.names)

    return map_batches(documents, run, schema)


def strongest(found: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; of equal ones the first. Null without runs."""

    def better(best: Column, one: Column) -> Column:
        return F.when(best["length"] * one["period"] < one["length"] * best["period"], one).otherwise(best)

    return F.aggregate(found, F.get(found, F.lit(0)), better)
