"""Token ids as binary shards in training order.

Documents' ids, each followed by an end mark, are packed to sequences of a fixed length. A keyed Feistel network over the
next power of four, walked along its cycles until it falls below the number of sequences, maps each sequence to its own
slot: a permutation of 0 .. n-1 without a sort or a table. Slots lie in shards of a fixed number, shards in ranges of
partitions; a shard is one binary value in which slot s starts at byte (s - first_slot) * stride, so that a reader starts or
resumes at any slot and then reads on in order. Shards are rows of a Parquet table, which makes their commit safe against
lost tasks on any file system; export_shards() writes them as files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import drop, kept
from ._scratch import map_batches
from ._text import mix

SHARDS = "shard long, first_slot long, n_sequences int, stride int, crc32 long, data binary"


class SlotPermutation:
    """A keyed permutation of 0 .. n-1 and its inverse, for arrays."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [(key * 1_000_003 + 7919 * k) & (2**63 - 1) for k in range(rounds)]

    def _step(self, x: np.ndarray, forward: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & self.mask
        for key in self.keys if forward else reversed(self.keys):
            if forward:
                left, right = right, left ^ (mix(right, key) & self.mask)
            else:
                left, right = right ^ (mix(left, key) & self.mask), left
        return (left << half) | right

    def _walk(self, x: np.ndarray, forward: bool) -> np.ndarray:
        out = self._step(np.asarray(x).astype(np.uint64), forward)
        while (outside := np.flatnonzero(out >= self.n)).size:
            out[outside] = self._step(out[outside], forward)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, True)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, False)


def pack(df: DataFrame, ids: str = "ids", length: int = 1024, end: int = 2, pad: int = 0, id_bytes: int = 2) -> DataFrame:
    """Sequences of `length` ids of id_bytes (2 or 4, little-endian), packed over the documents of each input partition: part, pos, n_tokens, tokens.

    A null or empty list is an end mark alone. The last sequence of a partition is filled up with `pad`. An id that doesn't
    fit is an error.
    """
    kind = np.dtype({2: np.uint16, 4: np.uint32}[id_bytes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, left = TaskContext.get().partitionId(), 0, np.zeros(0, kind)
        for batch in batches:
            lists = batch.column(0)
            counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            flat = np.asarray(lists.flatten())
            if flat.size and (flat.min() < 0 or flat.max() >= 1 << 8 * id_bytes):
                raise ValueError(f"ids over {8 * id_bytes} bits")
            stream = np.full(len(flat) + len(counts), end, kind)
            stream[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
            left = np.concatenate([left, stream])
            if whole := len(left) // length:
                yield packed(part, pos, left[: whole * length].reshape(whole, length), length)
                pos, left = pos + whole, left[whole * length :]
        if len(left):
            row = np.full((1, length), pad, kind)
            row[0, : len(left)] = left
            yield packed(part, pos, row, len(left))

    def packed(part: int, pos: int, rows: np.ndarray, used: int) -> pa.RecordBatch:
        n, stride = len(rows), id_bytes * rows.shape[1]
        data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * stride), pa.py_buffer(rows.astype(kind.newbyteorder("<")).tobytes())])
        columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(pos, pos + n)), pa.array(np.full(n, used, np.int32)), data]
        return pa.RecordBatch.from_arrays(columns, names=["part", "pos", "n_tokens", "tokens"])

    return map_batches(df.select(ids), run, "part int, pos long, n_tokens int, tokens binary")


def write_shards(df: DataFrame, path: str, key: int = 20240101, ids: str = "ids", length: int = 1024, per_shard: int = 1024, end: int = 2, pad: int = 0, id_bytes: int = 2) -> int:
    """Write the lists of ids in df as shards at `path` (a new Parquet folder); gives the number of sequences.

    Vocabularies of more than 65,536 pieces need id_bytes = 4. Each list is followed by the end mark. Numbering is by input partition and place in it, so equal input files give equal
    shards. An empty table writes an empty folder.
    """
    spark = df.sparkSession
    sequences = kept(pack(df, ids, length, end, pad, id_bytes), "sequences", "zstd")
    counts = sorted((r.part, r.n) for r in sequences.groupBy("part").agg(F.count("*").alias("n")).collect())  # one number for each input partition
    n = sum(x for _, x in counts)
    ahead = np.cumsum([0, *(x for _, x in counts)])[:-1].tolist()
    before = spark.sparkContext.broadcast(dict(zip([p for p, _ in counts], ahead, strict=True)))
    order, n_shards = SlotPermutation(n, key), max(1, -(-n // per_shard))
    parts = min(n_shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * length * id_bytes >> 26))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number = np.array([before.value[p] for p in batch.column("part").to_pylist()]) + np.asarray(batch.column("pos"))
                slot = order.slot(number)
                target = slot // per_shard * parts // n_shards
                yield pa.RecordBatch.from_arrays([pa.array(target.astype(np.int32)), pa.array(slot), batch.column("tokens")], names=["target", "slot", "tokens"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, first = None, [], 0

        def row() -> pa.RecordBatch:
            data = b"".join(rows)
            return pa.RecordBatch.from_pylist([{"shard": now, "first_slot": now * per_shard, "n_sequences": len(rows), "stride": length * id_bytes, "crc32": zlib.crc32(data), "data": data}], schema=ARROW)

        for batch in batches:
            for slot, tokens in zip(batch.column("slot").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if slot // per_shard != now:
                    if rows:
                        yield row()
                    now, rows, first = slot // per_shard, [], slot
                if slot != first + len(rows) or first != now * per_shard:
                    raise ValueError("a slot is missing")
                rows.append(tokens)
        if rows:
            yield row()

    placed = map_batches(sequences, place, "target int, slot long, tokens binary").repartitionById(parts, "target").sortWithinPartitions("slot")
    map_batches(placed.select("slot", "tokens"), shards, SHARDS).write.option("compression", "zstd").parquet(path)
    drop(sequences)
    return n


ARROW = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int32()), ("stride", pa.int32()), ("crc32", pa.int64()), ("data", pa.binary())])


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot, shard, byte_offset and tokens of the slots start .. stop-1; only shards in that range are read."""
    table = spark.read.schema(SHARDS).parquet(path).filter(F.col("first_slot") + F.col("n_sequences") > start)
    if stop is not None:
        table = table.filter(F.col("first_slot") < stop)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, stride = row["data"], row["stride"]
                if zlib.crc32(data) != row["crc32"]:
                    raise ValueError("a shard is damaged")
                lo, hi = max(0, start - row["first_slot"]), row["n_sequences"] if stop is None else min(row["n_sequences"], stop - row["first_slot"])
                found = [{"slot": row["first_slot"] + k, "shard": row["shard"], "byte_offset": k * stride, "tokens": data[k * stride : (k + 1) * stride]} for k in range(lo, hi)]
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("slot", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("tokens", pa.binary())]))

    return map_batches(table, cut_up, "slot long, shard long, byte_offset long, tokens binary")


def export_shards(spark: SparkSession, path: str, folder: str) -> None:
    """Write every shard as folder/shard-<number>.bin; `folder` must be one that all executors mount. Safe to repeat."""

    def save(rows) -> None:
        for row in rows:
            target = f"{folder}/shard-{row.shard:08d}.bin"
            with open(f"{target}.{os.getpid()}", "wb") as file:
                file.write(row.data)
            os.replace(file.name, target)

    spark.read.schema(SHARDS).parquet(path).select("shard", "data").foreachPartition(save)
