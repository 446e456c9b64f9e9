"""SentencePiece encoding and decoding with a given vocabulary.

All pieces stand in an Aho-Corasick automaton. One pass over a text visits, at each position, every piece that ends there
(along the automaton's output links) and relaxes the best score of that position: a Viterbi search for the segmentation with the
largest sum of scores, as in the library's unigram inference. A character that no piece of one character covers costs
`lowest score - 10` and becomes byte pieces. Equal sums: the longer last piece wins.

No piece holds a space mark behind another character, or a line feed with other characters; where a vocabulary is so (it is
looked up, not assumed), the best segmentation of a text is the best ones of its words. The different words of some
hundred texts go through the automaton side by side; a worker keeps their ids in a bounded cache.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, deque
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._schema import extended
from ._scratch import map_batches
from ._text import chunks, pieces, with_columns, word_hashes

MARK = "▁"
#: Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, kind) by id, and whether a text gets a space in front."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(Path(path).read_bytes())
    normal = model.normalizer_spec
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
        raise ValueError("only models that leave a text's characters as they are")
    return [(p.piece, p.score, p.type) for p in model.pieces], normal.add_dummy_prefix


class Automaton:
    """Aho-Corasick over the pieces that consist of the most frequent characters, as arrays, run over many words at once.

    delta has the next state by state and character class; a state's own piece is (length, score, id), and link leads to
    the next shorter piece that ends at the same place.
    """

    CLASSES, LONGEST = 160, 48

    def __init__(self, pieces: list[tuple[str, float, int]]):
        single = {p for p, _, _ in pieces if len(p) == 1}
        common = Counter(c for p, _, _ in pieces for c in p if c in single).most_common(self.CLASSES - 1)
        self.class_of = np.zeros(0x110000, np.uint8)
        for k, (c, _) in enumerate(common, 1):
            self.class_of[ord(c)] = k
        children, ends = [{}], [None]
        for match in pieces:
            path = self.class_of[[ord(c) for c in match[0]]].tolist()
            if 0 not in path:
                at = 0
                for k in path:
                    if (to := children[at].get(k)) is None:
                        to = children[at][k] = len(children)
                        children.append({})
                        ends.append(None)
                    at = to
                ends[at] = match
        n = len(children)
        self.delta, self.link = np.zeros((n, self.CLASSES), np.int32), np.zeros(n, np.int32)
        self.length = np.array([len(m[0]) if m else 0 for m in ends], np.int64)
        self.score = np.array([m[1] if m else 0 for m in ends])
        self.piece = np.array([m[2] if m else 0 for m in ends], np.int64)
        fail, queue = [0] * n, deque([0])
        while queue:  # by depth: the state that a fall leads to is finished before
            at = queue.popleft()
            back = fail[at]
            if at:
                self.delta[at] = self.delta[back]
                self.link[at] = back if ends[back] else self.link[back]
            for k, to in children[at].items():
                fail[to] = int(self.delta[back, k]) if at else 0
                self.delta[at, k] = to
                queue.append(to)

    def viterbi(self, words: list[str]) -> tuple[list[int], list[np.ndarray]]:
        """Which of the words could be done (all characters known, not too long), and their ids."""
        lengths = np.array([len(w) for w in words])
        codes = self.class_of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        fit = np.flatnonzero(np.logical_and(np.minimum.reduceat(codes, starts) > 0, lengths <= self.LONGEST))
        fit = fit[np.argsort(-lengths[fit], kind="stable")]
        starts, lengths, n = starts[fit], lengths[fit], len(fit)
        if not n:
            return [], []
        most = int(lengths[0])
        best, came_length, came = np.full((most + 1, n), -np.inf), np.zeros((most + 1, n), np.uint8), np.zeros((most + 1, n), np.int32)
        best[0] = 0
        state = np.zeros(n, np.int32)
        for at in range(most):
            active = int(np.searchsorted(-lengths, -at, "left"))
            state = self.delta[state[:active], codes[starts[:active] + at]]
            now, which = np.where(self.length[state] > 0, state, self.link[state]), np.arange(active)
            while len(which):  # along the output links, longest piece first
                length = self.length[now]
                score = best[at + 1 - length, which] + self.score[now]
                better = np.flatnonzero(score > best[at + 1, which])
                to = which[better]
                best[at + 1, to], came_length[at + 1, to], came[at + 1, to] = score[better], length[better], self.piece[now[better]]
                now = self.link[now]
                left = np.flatnonzero(now)
                now, which = now[left], which[left]
        at, steps, counts = lengths.copy(), [], np.zeros(n, np.int64)
        which = np.arange(n)
        while len(which):
            steps.append((which, came[at[which], which]))
            counts[which] += 1
            at[which] -= came_length[at[which], which]
            which = which[at[which] > 0]
        ends = np.cumsum(counts)
        flat = np.empty(ends[-1], np.int32)
        for k, (which, ids) in enumerate(steps):
            flat[ends[which] - 1 - k] = ids
        return fit.tolist(), [flat, ends - counts, ends]


def different_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different word, and for each place which word it is. Hashes gather equal words; that words of one hash
    are equal is looked up in their bytes."""
    words, at, which = np.unique(word_hashes(data, starts, ends, 11)[0], return_index=True, return_inverse=True)
    values, place, first = chunks(data, starts, ends)
    chief = at[which]
    if np.array_equal(ends - starts, (ends - starts)[chief]):
        n = np.diff(np.append(first, len(values)))
        if np.array_equal(values, values[np.repeat(first[chief], n) + place]):
            return at, which
    body, seen = data.tobytes(), {}
    which = np.array([seen.setdefault(body[a:b], len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.unique(which, return_index=True)[1], which


class Pieces:
    """A vocabulary; a worker keeps the ids of words in a bounded cache."""

    def __init__(self, vocabulary: list[tuple[str, float, int]], prefix: bool = True, cache: int = 150_000):
        self.prefix, self.most = prefix, cache
        self.code = "H" if len(vocabulary) <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.unknown = next((i for i, p in enumerate(vocabulary) if p[2] == UNKNOWN), 0)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(vocabulary) if p[2] == BYTE}
        self.surface, self.single = [b""] * len(vocabulary), set()
        lowest, line, inner, self.usable = 0.0, False, False, []
        for i, (piece, score, kind) in enumerate(vocabulary):
            if kind in (NORMAL, USER_DEFINED):
                self.usable.append((piece, score, i))
                self.surface[i] = piece.replace(MARK, " ").encode()
                lowest = min(lowest, score)
                line |= "\n" in piece and len(piece) > 1
                inner |= MARK in piece.lstrip(MARK)
                if len(piece) == 1:
                    self.single.add(piece)
            elif kind == BYTE:
                self.surface[i] = bytes([int(piece[3:5], 16)])
        self.penalty = lowest - 10
        self.text, lengths = np.frombuffer(b"".join(self.surface), np.uint8), np.array([len(x) for x in self.surface])
        self.text_length, self.text_start = lengths, np.cumsum(lengths) - lengths
        self.cuts, self.line_cuts = not inner, not line
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @cached_property
    def many(self) -> Automaton:
        return Automaton(self.usable)

    @cached_property
    def rare(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for piece, score, i in self.usable:
            automaton.add_word(piece, (len(piece), score, i))
        automaton.make_automaton()
        return automaton

    def viterbi(self, text: str) -> list[int]:
        """One text of any characters."""
        n = len(text)
        best, came = [0.0, *[-math.inf] * n], [(1, self.penalty, self.unknown)] * (n + 1)
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for end, match in self.rare.iter(text):
            ends[end + 1].append(match)
        for end in range(1, n + 1):
            for match in ends[end] if text[end - 1] in self.single else [*ends[end], came[0]]:
                score = best[end - match[0]] + match[1]
                if score > best[end]:
                    best[end], came[end] = score, match
        out, at = [], n
        while at:
            length, _, piece = came[at]
            if piece == self.unknown and self.bytes:
                out.extend(self.bytes[b] for b in reversed(text[at - 1].encode()))
            else:
                out.append(piece)
            at -= length
        return out[::-1]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the texts' offsets in them; a null or empty text has none.

        A mark in the text itself is taken as a space. Words are told apart by their bytes.
        """
        front = b" " if self.prefix else b""
        raw = [front + x.replace(MARK, " ").encode() if x else b"" for x in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        if self.cuts:
            space, line = data == 0x20, (data == 0x0A) & self.line_cuts
            begins[:-1] |= line
            begins[1:-1] |= (space[1:] & ~space[:-1]) | line[:-1]
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(data))
        at, which = different_words(data, starts, ends)
        body = data.tobytes()
        keys = [body[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        ids = [self.cache.get(k) or self.old.get(k) for k in keys]
        if missing := [k for k, x in enumerate(ids) if x is None]:
            new = [keys[k].decode().replace(" ", MARK) for k in missing]
            done, found = self.many.viterbi(new)
            if done:
                flat, lo, hi = found
                size, packed = self.kind.itemsize, flat.astype(self.kind).tobytes()
                for k, a, b in zip(done, (lo * size).tolist(), (hi * size).tolist(), strict=True):
                    ids[missing[k]] = packed[a:b]
            for k in set(range(len(new))).difference(done):
                ids[missing[k]] = array(self.code, self.viterbi(new[k])).tobytes()
        if len(self.cache) > self.most:  # of two generations the older one goes: what is used often stays
            self.cache, self.old = {}, self.cache
        self.cache.update((k, x) for k, x in zip(keys, ids, strict=True) if len(k) <= 256)
        lengths = np.array([len(x) for x in ids]) // self.kind.itemsize
        firsts = np.cumsum(lengths) - lengths
        n = lengths[which]
        stops = np.cumsum(n)
        out = np.frombuffer(b"".join(ids), self.kind)[np.arange(stops[-1]) + np.repeat(firsts[which] - stops + n, n)]
        return out, np.concatenate([[0], stops])[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids[at[k]:at[k + 1]]; the space that encoding puts in front goes. Unknown and control ids have no
        text."""
        lengths = self.text_length[ids]
        ends = np.cumsum(lengths)
        raw = self.text[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.text_start[ids] - ends + lengths, lengths)].tobytes()
        edges = np.concatenate([[0], ends])[at].tolist()
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [x[1:] if self.prefix and x[:1] == " " else x for x in texts]


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(*read_model(path))


def encode(df: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", most_bytes: int = 3 << 19) -> DataFrame:
    """df with ids array<int> and n_tokens long; columns of these names are replaced. A null text has an empty list.

    Rows go through in slices of about most_bytes of text, a longer text alone.
    """
    schema = extended(df.schema, "ids array<int>, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces_of(model)
        for whole in batches:
            for lo, hi, _, _ in pieces(whole.column(text), most_bytes):
                batch = whole.slice(lo, hi - lo)
                ids, at = vocabulary.encode(batch.column(text).to_pylist())
                new = {"ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), "n_tokens": pa.array(np.diff(at))}
                yield with_columns(batch, new, schema.names)

    return map_batches(df, run, schema)


def decode(df: DataFrame, model: str = DEFAULT_MODEL, ids: str = "ids", out: str = "decoded", step: int = 512) -> DataFrame:
    """df with the text of each list of ids; null for a null list. A column called `out` is replaced."""
    schema = extended(df.schema, f"`{out}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces_of(model)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                lists = batch.column(ids)
                at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
                texts = pa.array(vocabulary.decode(np.asarray(lists.flatten()), at), pa.string())
                yield with_columns(batch, {out: pc.if_else(lists.is_valid(), texts, None)}, schema.names)

    return map_batches(df, run, schema)
