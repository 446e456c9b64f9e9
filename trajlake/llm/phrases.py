"""Phrase collocations: multikey three-way quicksort of suffix pointers, routed by their leading words.

A suffix is a word and the words behind it in its piece of text, `longest` at most. Each task sorts the suffixes of some
megabytes at a time, one word after the other: a segment is split around a pivot into less, equal and greater, the equal
part goes on with the next word, and its size is the count of the words so far. All segments are split side by side in
numpy. Equal suffixes leave the task as one, with their number.

They are then dealt to buckets by their leading word, by the two leading words where the first is frequent in the whole
corpus; where both are, each beginning of two words or more goes by all its words (`split`). So no bucket grows with one
word or pair, and every count is whole in its bucket. Each bucket is sorted in the same way, and a part whose numbers add up to less
than `least` is abandoned at once with all that it would be split into. Words are counted before, in a pass of their own,
which tells the frequent ones: less than 2**17 of them, whose hashes are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import drop, kept
from ._scratch import map_batches
from ._text import joined, lower, mix, pieces, utf8, word_hashes

#: Bytes that end a piece, and those that separate words.
BREAK, GAP = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP[[0x20, 0x09, *np.flatnonzero(BREAK)]] = True
#: Bytes of text that are sorted together, suffixes in a bucket, and a bucket's suffixes from which equal ones are added up.
TOGETHER, BUCKET, MOST_HELD = 4 << 20, 1 << 18, 1 << 20
#: A word with less occurrences is never frequent; and at most one in 2**HEAVY_BITS occurrences makes a word so.
LEAST_HEAVY, HEAVY_BITS = 4096, 17
#: Parts that the rows of one language are ranked in first.
SALTS = 64


def equal_parts(keys: np.ndarray, weights: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of pointers (rows of keys: word numbers, -1 behind the last word; without weights, 1 each).

    Gives inner and whole: rows (pointer, words, weight), one for each set of pointers with the same first words and for
    each set of the same whole suffix. Sets of less weight than `least` are abandoned. Parts aren't put in order.
    """
    inner, whole = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]
    work, sizes = np.arange(len(keys), dtype=np.int32), np.array([len(keys)])
    for depth in range(keys.shape[1]):
        value, deeper = keys[:, depth][work], [(work[:0], sizes[:0])]
        while len(work):
            first = np.cumsum(sizes) - sizes
            a, b, c = value[first], value[first + sizes // 2], value[first + sizes - 1]
            pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
            above, segment = np.repeat(pivot, sizes), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            rest = []
            for chosen in (value < above, value == above, value > above):
                at = np.flatnonzero(chosen)
                where = segment[at]
                count = np.bincount(where, minlength=len(sizes))
                total = count if weights is None else np.bincount(where, weights[work[at]], len(sizes)).astype(np.int64)
                stays = (count > 0) & (total >= least)
                if len(rest) == 1:
                    part = np.flatnonzero(stays)
                    ended = pivot[part] < 0
                    found = np.stack([work[at[(np.cumsum(count) - count)[part]]], depth + ~ended, total[part]], axis=1)
                    inner.append(found[~ended])
                    whole.append(found[ended | (depth == keys.shape[1] - 1)])
                    stays[part[ended]] = False
                at = at[stays[where]]
                rest.append((work[at], value[at], count[stays]))
            deeper.append(rest.pop(1)[::2])
            work, value, sizes = (np.concatenate(x) for x in zip(*rest, strict=True))
        work, sizes = (np.concatenate(x) for x in zip(*deeper, strict=True))
    return np.concatenate(inner), np.concatenate(whole)


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """Languages and lowered texts with a line end behind each, some megabytes at a time; a longer text alone."""
    held, size = {}, 0

    def joined_up() -> Iterator[tuple[str, np.ndarray]]:
        for lang, texts in held.items():
            yield lang, lower(np.frombuffer(b"\n".join([*texts, b""]), np.uint8))

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lo, hi, data, offsets in pieces(batch.column("text")):
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), lo):
                held.setdefault(langs[row], []).append(data[a:b].tobytes())
            size += len(data)
            if size > TOGETHER:
                yield from joined_up()
                held, size = {}, 0
    yield from joined_up()


class Words:
    """The words of a text: their numbers in a vocabulary, and the piece that each lies in."""

    def __init__(self, data: np.ndarray):
        solid = ~GAP[data]
        before = np.append(False, solid[:-1])
        starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(~solid & before)
        self.piece = np.cumsum(BREAK[data])[starts]
        self.offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(self.offsets.astype(np.int32)), pa.py_buffer(data[solid])])
        coded = words.dictionary_encode()
        self.ids, self.vocabulary = np.asarray(coded.indices), coded.dictionary
        #: every word with one space behind it
        self.spaced = np.where(solid, data, 0x20).astype(np.uint8)[solid | before]

    def suffixes(self, longest: int) -> np.ndarray:
        """(words, longest) numbers; -1 behind the end of the piece."""
        n = len(self.ids)
        keys = np.full((n, longest), -1, np.int32)
        for d in range(min(longest, n)):
            keys[: n - d, d] = np.where(self.piece[d:] == self.piece[: n - d], self.ids[d:], -1)
        return keys

    def lines(self, pointers: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases of so many words at the pointers, each with a line end, and their offsets."""
        begin, end = (self.offsets[p] + p for p in (pointers, pointers + words))
        at = np.concatenate([[0], np.cumsum(end - begin)])
        out = self.spaced[np.repeat(begin - at[:-1], end - begin) + np.arange(at[-1])]
        out[at[1:] - 1] = 0x0A
        return out, at


def vocabulary_hashes(vocabulary: pa.Array, lang: str) -> np.ndarray:
    data, offsets = utf8(vocabulary)
    own = np.frombuffer(lang.encode() or b" ", np.uint8)
    return mix(word_hashes(data, offsets[:-1], offsets[1:], 21)[0] + word_hashes(own, np.array([0]), np.array([len(own)]), 22)[0], 23)


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, phrase (a word), hash and f of texts (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in by_language(batches):
            words = Words(data)
            n = len(words.vocabulary)
            hashes = vocabulary_hashes(words.vocabulary, lang).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), words.vocabulary.cast(pa.string()), pa.array(hashes), pa.array(np.bincount(words.ids, minlength=n))], names=["lang", "phrase", "hash", "f"])

    return map_batches(texts, run, "lang string, phrase string, hash long, f long").groupBy("lang", "phrase").agg(F.first("hash").alias("hash"), F.sum("f").alias("f"))


def routed(texts: DataFrame, longest: int, n_buckets: int, heavy) -> DataFrame:
    """bucket, lang, split, phrases (lines) and counts (longs) of the suffixes with two words or more; of those that begin with
    two frequent words (split) each beginning is a phrase of its own. heavy: a broadcast, the ascending hashes of frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = heavy.value
        for lang, data in by_language(batches):
            words = Words(data)
            if not len(words.ids):
                continue
            keys = words.suffixes(longest)
            some = np.flatnonzero(keys[:, 1] >= 0)
            inner, whole = equal_parts(keys[some], None, 1)
            hashes = vocabulary_hashes(words.vocabulary, lang)
            frequent = np.isin(hashes, often)
            hot = frequent[keys[some, 0]] & frequent[keys[some, 1]]
            found = np.concatenate([whole[~hot[whole[:, 0]]], inner[hot[inner[:, 0]] & (inner[:, 1] > 1)]])
            pointer, length, count = some[found[:, 0]], found[:, 1], found[:, 2]
            key, split = keys[pointer], hot[found[:, 0]]
            route = hashes[key[:, 0]]
            for d in range(1, longest):
                more = split & (d < length) if d > 1 else frequent[key[:, 0]]
                route = np.where(more, joined(route, hashes[key[:, d]], 24), route)
            bucket = (mix(route, 25) % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((split, bucket))
            lines, at = words.lines(pointer[order], length[order])
            bucket, split, count = bucket[order], split[order], count[order]
            edges = np.concatenate([[0], np.flatnonzero((np.diff(bucket) != 0) | (np.diff(split.astype(np.int8)) != 0)) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
            lines, count = lines.tobytes(), count.tobytes()
            spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            arrays = [
                pa.array(bucket[edges[:-1]]), pa.array([lang] * len(spans), pa.string()), pa.array(split[edges[:-1]]),
                pa.array([lines[at[a] : at[b]] for a, b in spans], pa.binary()), pa.array([count[8 * a : 8 * b] for a, b in spans], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "lang", "split", "phrases", "counts"])

    return map_batches(texts, run, "bucket long, lang string, split boolean, phrases binary, counts binary")


class Held:
    """The suffixes of one bucket, language and kind, as lines and counts."""

    def __init__(self, longest: int):
        self.longest, self.lines, self.counts, self.n = longest, [], [], 0

    def add(self, lines: bytes, counts: bytes) -> None:
        self.lines.append(lines)
        self.counts.append(np.frombuffer(counts, np.int64))
        self.n += len(counts) // 8
        if self.n > MOST_HELD:  # add up equal ones; different ones are few, as a bucket is one in many
            keys, vocabulary = self._keys()
            _, whole = equal_parts(keys, np.concatenate(self.counts), 1)
            order = np.argsort(whole[:, 0])
            phrases = self._named(keys, vocabulary, whole[order])
            self.lines, self.counts, self.n = [b"\n".join([*phrases, b""])], [whole[order, 2]], len(whole)

    def _keys(self) -> tuple[np.ndarray, pa.Array]:
        phrases = pc.split_pattern(pa.array([b"".join(self.lines)[:-1]], pa.large_binary()), b"\n").flatten()
        words = pc.split_pattern(phrases, b" ")
        n = pc.list_value_length(words).to_numpy()
        coded = words.flatten().dictionary_encode()
        keys = np.full((len(n), self.longest), -1, np.int32)
        row = np.repeat(np.arange(len(n)), n)
        keys[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(coded.indices)
        return keys, coded.dictionary

    def _named(self, keys: np.ndarray, vocabulary: pa.Array, found: np.ndarray) -> list[bytes]:
        names = vocabulary.to_pylist()
        return [b" ".join([names[k] for k in row[:n]]) for row, n in zip(keys[found[:, 0]].tolist(), found[:, 1].tolist(), strict=True)]

    def counted(self, lang: str, split: bool, least: int) -> pa.RecordBatch:
        """Phrases of two words or more with `least` occurrences: all beginnings of suffixes, or what is split by itself."""
        keys, vocabulary = self._keys()
        inner, whole = equal_parts(keys, np.concatenate(self.counts), least)
        found = whole if split else inner[inner[:, 1] > 1]
        phrases = pa.array(self._named(keys, vocabulary, found), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), phrases, pa.array(found[:, 1]), pa.array(found[:, 2])], names=["lang", "phrase", "words", "a"])


def candidates(suffixes: DataFrame, parts: int, longest: int, least: int) -> DataFrame:
    """lang, phrase, words and a of all phrases of two words or more that occur `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lang", "split", "phrases", "counts")), strict=True):
                if row[:3] != now:
                    if now is not None:
                        yield held.counted(*now[1:], least)
                    now, held = row[:3], Held(longest)
                held.add(*row[3:])
        if now is not None:
            yield held.counted(*now[1:], least)

    dealt = suffixes.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket", "lang", "split")
    return map_batches(dealt, run, "lang string, phrase string, words long, a long")


def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)), in whole numbers of 38 digits."""
    a, left, right = (f"CAST({x} AS DECIMAL(19, 0))" for x in (a, left, right))
    return F.expr(f"({a} * {a} * CAST(1000000 AS DECIMAL(7, 0))) DIV ({left} * {right})")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n and score.

    A-Z are lowered; a text is split to pieces at .,;:!? and line ends, a piece at spaces and tabs to words. n counts all
    words of the language, a the phrase. The score is a * a over the counts of its two parts, in millionths, at the cut
    that gives the least (of equal ones the first). Phrases with less than `least` occurrences are left out, and those inside a longer
    candidate that has `share` per cent of their occurrences or more. Equal scores are ordered by a, then the phrase's
    bytes. A null language is `und`, a null text has no words; repeated rows count each; an empty table has no phrases;
    other columns play no part.
    """
    texts = documents.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    spark = documents.sparkSession
    words = kept(word_counts(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    n = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (BUCKET * 16))
    n_buckets = max(1, n // BUCKET)
    often = words.filter(F.col("f") > max(n >> HEAVY_BITS, n // n_buckets // 4, LEAST_HEAVY)).select("hash").collect()  # less than 2**HEAVY_BITS
    heavy = spark.sparkContext.broadcast(np.sort(np.array([r.hash for r in often], np.int64).view(np.uint64)))
    found = kept(candidates(routed(texts, longest, n_buckets, heavy), parts, longest, least), "candidates")
    counts = words.filter(F.col("f") >= least).select("lang", "phrase", "f").unionByName(found.filter(F.col("words") < longest).select("lang", "phrase", F.col("a").alias("f")))
    token, k = F.split("phrase", " "), F.col("k")
    run_of = lambda start, length: F.array_join(F.slice(token, start, length), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": run_of(F.lit(1), k.cast("int")), "right": run_of((k + 1).cast("int"), (F.col("words") - k).cast("int"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score("a", "l", "r").alias("score"), "k", "l", "r")).alias("best"))
    inside = found.filter("words > 2").withColumn("at", F.explode(F.array(F.lit(1), F.lit(2))))
    inside = inside.select("lang", run_of(F.col("at"), (F.col("words") - 1).cast("int")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    free = best.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("cover") < share * F.col("a"), F.lit(True)))
    free = kept(free.select("lang", "phrase", "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")), "free")
    drop(found)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    first = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
