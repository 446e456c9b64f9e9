"""URL filters: all rules run at once as one bit-parallel Shift-And automaton.

A rule `host/path` fits its host and every subdomain where the path starts with the rule's path; the longest rule wins.
As a glob over the canonical form "." + host + SEP + path it is `*.host SEP path*`. SEP is a symbol outside the byte
alphabet, so host text cannot match inside a path. All globs are laid side by side in one bit vector of as many 64-bit
words as needed; one step per character, taken for all URLs of a batch together, is D = ((D << 1) | starts | (D & loops))
& masks[symbol], where `loops` are the bits that stand before a `*`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._schema import extended
from ._scratch import map_batches
from ._text import utf8, with_columns

SEP, ALPHABET = 256, 257


class GlobSet:
    """Globs (lists of symbols and "*") packed into multiword Shift-And masks.

    Bit i of a glob is set in D when its first i symbols have matched; a `*` after symbol i makes bit i stay. A leading
    `*` makes the start bit available at every step, a trailing `*` keeps the last bit.
    """

    def __init__(self, globs: list[list]):
        where, loops, self.last, floating, anchored, masks = 0, [], [], [], [], []
        for glob in globs:
            first = where
            for symbol in glob:
                if symbol == "*":
                    (floating.append(first) if where == first else loops.append(where - 1))
                else:
                    masks.append((where, symbol))
                    where += 1
            if where == first:
                raise ValueError("a glob needs a symbol besides *")
            if first not in floating:
                anchored.append(first)
            self.last.append(where - 1)
        self.n_words = where // 64 + 1
        self.masks = np.zeros((ALPHABET, self.n_words), np.uint64)
        for bit, symbol in masks:
            self.masks[symbol, bit // 64] |= np.uint64(1 << (bit % 64))
        self.loops, self.floating, self.anchored = self._bits(loops), self._bits(floating), self._bits(anchored)
        #: Bits that a shift brings in from the glob before.
        self.firsts = ~(self.floating | self.anchored)

    def _bits(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.n_words, np.uint64)
        for bit in bits:
            out[bit // 64] |= np.uint64(1 << (bit % 64))
        return out

    def run(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text and glob, whether the glob matches the whole text."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        start, length = offsets[:-1][order], length[order]
        state = np.zeros((len(order), self.n_words), np.uint64)
        active = len(order)
        for at in range(int(length[0]) if len(order) else 0):
            active = int(np.searchsorted(-length[:active], -at, "left"))
            d = state[:active]
            step = d << np.uint64(1)
            step[:, 1:] |= d[:, :-1] >> np.uint64(63)
            step = (step & self.firsts) | self.floating
            if not at:
                step |= self.anchored
            state[:active] = (step & self.masks[symbols[start[:active] + at]]) | (d & self.loops)
        out = np.empty((len(order), len(self.last)), bool)
        for k, bit in enumerate(self.last):
            out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def rule_glob(rule: str) -> list:
    host, _, path = rule.partition("/")
    return ["*", *(b"." + host.lower().encode()), SEP, *f"/{path}".encode(), "*"]


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, rules: dict[str, str], url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (the longest that fits, else null) and verdict (the rule's, else `default`).

    rules: verdict by rule. A null URL, or one without `://`, has an empty host and path and fits no rule; repeated rows
    are judged alike; a column of pages that is called like a result is replaced; rules of equal length that fit the same
    URL are equal in host and path, or of different hosts of which only one can end there, so that no tie is left but
    between a longer host and a longer path: then the longer host wins.
    """
    names = sorted(rules, key=lambda r: (-len(r), -len(r.partition("/")[0]), r))
    host, path = split_url(F.col(url))
    wide = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path") else pages
    wide = wide.withColumns({"host": host, "path": path})
    schema = extended(wide.schema, "rule string, verdict string")
    globs = [rule_glob(r) for r in names]
    verdicts = [rules[r] for r in names]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobSet(globs)
        labels, outcome = pa.array([*names, None], pa.string()), pa.array([*verdicts, default], pa.string())
        for batch in batches:
            hosts, host_at = utf8(batch.column("host"))
            paths, path_at = utf8(batch.column("path"))
            # "." host SEP path, laid out for the whole batch at once
            n_host, n_path = np.diff(host_at), np.diff(path_at)
            offsets = np.concatenate([[0], np.cumsum(n_host + n_path + 2)])
            symbols = np.empty(offsets[-1], np.int16)
            symbols[offsets[:-1]] = ord(".")
            symbols[offsets[:-1] + 1 + n_host] = SEP
            symbols[np.arange(len(hosts)) + np.repeat(offsets[:-1] + 1 - host_at[:-1], n_host)] = hosts
            symbols[np.arange(len(paths)) + np.repeat(offsets[:-1] + 2 + n_host - path_at[:-1], n_path)] = paths
            fits = automaton.run(symbols, offsets)
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(names)) if names else np.zeros(len(n_host), int)
            best = pa.array(best)
            yield with_columns(batch, {"rule": labels.take(best), "verdict": outcome.take(best)}, schema.names)

    return map_batches(wide, judge, schema)
