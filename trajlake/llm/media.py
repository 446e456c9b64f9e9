"""Media columns: payloads as 8-bit grayscale PNG images in binary columns, and a perceptual hash of their samples."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._schema import extended
from ._scratch import map_batches
from ._text import with_columns

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

SIDE, LOW = 32, 8
#: Rows of images that are filtered or undone at a time.
BAND = 8192


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _predicted(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> list[np.ndarray]:
    """What the five filters expect of a sample, from its neighbours (int16)."""
    a, b = np.abs(up - corner), np.abs(left - corner)
    c = np.abs(left + up - 2 * corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return [np.zeros_like(left), left, up, (left + up) >> 1, paeth]


def filter_rows(samples: np.ndarray, first: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Rows of images under one another (`first` marks each image's first row), each with its filter type in front: for each
    row that of the five filters with the least sum of absolute differences, or the given ones. BAND rows are worked on at a
    time, so that memory beside the result doesn't grow with an image."""
    n, width = samples.shape
    out = np.empty((n, width + 1), np.uint8)
    for lo in range(0, n, BAND):
        top, hi = max(lo - 1, 0), min(lo + BAND, n)  # the row above goes along
        wide = samples[top:hi].astype(np.int16)
        left, up, corner = np.zeros_like(wide), np.zeros_like(wide), np.zeros_like(wide)
        left[:, 1:] = wide[:, :-1]
        up[1:] = wide[:-1]
        up[first[top:hi]] = 0
        corner[:, 1:] = up[:, :-1]
        tried = np.stack([(wide - x).astype(np.uint8) for x in _predicted(left, up, corner)])[:, lo - top :]
        chosen = np.abs(tried.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0) if kinds is None else kinds[lo:hi]
        out[lo:hi, 0], out[lo:hi, 1:] = chosen, tried[chosen, np.arange(hi - lo)]
    return out


def unfilter(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The samples of filtered rows of images under one another, of one byte a pixel, BAND rows at a time."""
    out = np.empty((len(rows), rows.shape[1] - 1), np.uint8)
    for lo in range(0, len(rows), BAND):
        above = out[lo - 1] if lo and not first[lo] else None
        out[lo : lo + BAND] = _unfilter_band(rows[lo : lo + BAND], first[lo : lo + BAND], above)
    return out


def _unfilter_band(rows: np.ndarray, first: np.ndarray, above: np.ndarray | None) -> np.ndarray:
    """unfilter() of rows that fit in memory several times; `above` is the row over the first one, if that is of its image.

    A sample needs its left and upper neighbours, so all rows are undone together along their diagonals. A row of the type
    None or Sub needs no row above it: a diagonal begins anew there, so that one image is cut up as well.
    """
    kinds, width = rows[:, 0].astype(np.int64), rows.shape[1] - 1
    if (kinds > PAETH).any():
        raise ValueError("unknown filter type")
    first = first.copy()
    first[0] = True
    n, starts = len(rows), np.flatnonzero(first)
    image, anew = np.cumsum(first) - 1, first | (kinds <= SUB)
    depth = np.arange(n) - np.flatnonzero(anew)[np.cumsum(anew) - 1]
    out = np.zeros((n + len(starts), width + 1), np.int16)  # a row of zeros above each image, and a column before it
    if above is not None:
        out[0, 1:] = above
    base, flat = (np.arange(n) + image + 1) * (width + 1) + 1, out.ravel()
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
    base, kinds, filtered = base[order], kinds[order], rows[order, 1:].astype(np.int16)
    last = len(edges) - 2
    for step in range(last + width):
        lo, hi = edges[max(0, step - width + 1)], edges[min(last, step) + 1]
        x = step - np.repeat(np.arange(max(0, step - width + 1), min(last, step) + 1), np.diff(edges[max(0, step - width + 1) : min(last, step) + 2]))
        at = base[lo:hi] + x
        guess = np.choose(kinds[lo:hi], _predicted(flat[at - 1], flat[at - width - 1], flat[at - width - 2]))
        flat[at] = (filtered[np.arange(lo, hi), x] + guess) & 255
    keep = np.ones(len(out), bool)
    keep[starts + np.arange(len(starts))] = False
    return out[keep, 1:].astype(np.uint8)


def packed_png(rows: np.ndarray, level: int) -> bytes:
    """The file of one image's filtered rows."""
    header = struct.pack(">IIBBBBB", rows.shape[1] - 1, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def encode_pngs(images: list[np.ndarray], kind: int | None = None, level: int = 6) -> list[bytes]:
    """(height, width) uint8 images of one width and a row at least, as files; `kind` sets one filter for all rows."""
    ends = np.cumsum([len(x) for x in images])
    first = np.zeros(ends[-1], bool)
    first[ends - [len(x) for x in images]] = True
    rows = filter_rows(np.concatenate(images), first, None if kind is None else np.full(len(first), kind))
    return [packed_png(rows[hi - len(x) : hi], level) for x, hi in zip(images, ends.tolist(), strict=True)]


def unpacked_png(data: bytes) -> np.ndarray:
    """The filtered rows of an 8-bit grayscale PNG without interlace; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, packed, size = 8, [], None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(data[at + 4 : at + 8 + n]):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grayscale without interlace")
            size = height, width + 1
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size)


def decode_pngs(files: list[bytes]) -> list[np.ndarray]:
    """The samples of images; those of one width are unfiltered together."""
    rows, out = [unpacked_png(x) for x in files], [None] * len(files)
    for width in {x.shape[1] for x in rows}:
        which = [k for k, x in enumerate(rows) if x.shape[1] == width]
        ends = np.cumsum([len(rows[k]) for k in which])
        first = np.zeros(ends[-1], bool)
        first[ends - [len(rows[k]) for k in which]] = True
        samples = unfilter(np.concatenate([rows[k] for k in which]), first)
        for k, hi in zip(which, ends.tolist(), strict=True):
            out[k] = samples[hi - len(rows[k]) : hi]
    return out


def _dct(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


DCT = _dct(SIDE, LOW)


def _shrink(image: np.ndarray, side: int) -> np.ndarray:
    """Rows averaged over `side` even bands; with fewer rows each is repeated."""
    edges = np.arange(side + 1) * len(image) // side
    if len(image) >= side:
        return np.add.reduceat(image, edges[:-1], axis=0, dtype=np.float64) / np.diff(edges)[:, None]
    lo, hi = np.minimum(edges[:-1], len(image) - 1), np.maximum(edges[1:], edges[:-1] + 1)
    sums = np.concatenate([np.zeros((1, image.shape[1])), np.cumsum(image, axis=0, dtype=np.float64)])
    hi = np.minimum(hi, len(image))
    return (sums[hi] - sums[lo]) / (hi - lo)[:, None]


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits in hex: which of the 8 x 8 lowest cosine coefficients of the image, shrunk to 32 x 32, lie over their median.

    The constant coefficient takes no part in the median and its own bit is 0.
    """
    small = _shrink(_shrink(samples, SIDE).T, SIDE).T
    low = np.round((DCT @ small @ DCT.T).ravel(), 6)
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload_of(text: str | bytes | None, width: int = 64) -> bytes:
    raw = b"" if text is None else text if isinstance(text, bytes) else text.encode()
    return raw + bytes(-len(raw) % width if raw else width)


def slices(items: list, size: Callable[[object], int], most: int = 1 << 18) -> Iterator[list]:
    """Runs of items of about `most` bytes, a larger one alone: bounds what is worked on at a time."""
    part, total = [], 0
    for x in items:
        if part and total + size(x) > most:
            yield part
            part, total = [], 0
        part.append(x)
        total += size(x)
    if part:
        yield part


def store_png(df: DataFrame, payload: str = "text", width: int = 64, level: int = 6) -> DataFrame:
    """df with n_bytes (of the payload column's UTF-8) and media (the PNG), without the payload column.

    The payload gets bytes 0 up to a positive multiple of `width`; a null or empty one becomes one row of zeros. A text of
    any length is one image. Input columns called n_bytes or media are replaced; an empty table gives an empty one.
    """
    schema = extended(df.drop(*({"n_bytes", "media"} - {payload})).schema, "n_bytes long, media binary")
    schema.fields = [f for f in schema.fields if f.name != payload]
    order = [f.name for f in schema.fields]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                raw = batch.column(payload).cast(pa.binary()).to_pylist()
                media = [x for part in slices([np.frombuffer(payload_of(x, width), np.uint8).reshape(-1, width) for x in raw], lambda i: i.size) for x in encode_pngs(part, level=level)]
                new = {"n_bytes": pa.array([len(x or b"") for x in raw], pa.int64()), "media": pa.array(media, pa.binary())}
                yield with_columns(batch, new, order)

    from pyspark.sql import types as T

    return map_batches(df, encode, T.StructType(schema.fields))


def read_png(df: DataFrame, media: str = "media") -> DataFrame:
    """What the stored images hold: df without the media column, with payload_bytes, payload_sha256, tail_crc32 (last 64
    bytes), media_bytes, media_sha256 and feature (cosine_hash), all from the decoded samples. A null image gives nulls; a
    damaged one fails."""
    new = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = extended(df.drop(media).schema, new)
    names = [x.split()[0] for x in new.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def facts(stored: bytes, samples: np.ndarray) -> tuple:
        raw = samples.tobytes()
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                files = batch.column(media).to_pylist()
                images = iter([x for part in slices([x for x in files if x is not None], len) for x in decode_pngs(part)])
                found = [(None,) * len(names) if x is None else facts(x, next(images)) for x in files]
                columns = zip(*found, strict=True) if found else [[] for _ in names]
                yield with_columns(batch, {n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds, strict=True)}, schema.names)

    return map_batches(df, decode, schema)


def text_payloads(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
