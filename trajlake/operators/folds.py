"""Folds over groups in order of time, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Tasks that groups are dealt to by their hash: with few, long groups would often share one.
LEAST_TASKS = 256
Walk = Callable[[pd.DataFrame], pd.DataFrame]


def fold(rows: DataFrame, by: list[str], frame: list[str], used: list[str], start: Callable[[tuple], Walk], schema: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """by without its last, and what walks give: start(key) makes a group's walk, which takes whole frames (`frame`: the columns
    that order and tell them) of the columns `used`, in order.

    Spark sorts the groups, and each goes through its walk batch by batch, so that a task needs memory for a batch and not for
    a group; a batch's last frame waits for the next one.
    """
    tasks = max(LEAST_TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(*by, *used).repartition(tasks, *by).sortWithinPartitions(*by, *frame, *ties)
    kinds = dict(rows.dtypes)
    ddl = ", ".join([*(f"{k} {kinds[k]}" for k in by[:-1]), schema])
    out = to_arrow_schema(T._parse_datatype_string(ddl))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group(by, frame, used, start)
        for batch in batches:
            yield from written(group.taken(batch))
        yield from written(group.rest())

    def written(parts: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if len(part):
                yield pa.RecordBatch.from_pandas(part, out, preserve_index=False)

    return dealt.mapInArrow(walk, ddl)


class Group:
    """What fold() knows between batches: the group it is in, its walk and the rows of the frame that may go on."""

    def __init__(self, by: list[str], frame: list[str], used: list[str], start: Callable[[tuple], Walk]):
        self.by, self.frame, self.used, self.start = by, frame, used, start
        self.key, self.walk, self.open = None, None, None

    def taken(self, batch: pa.RecordBatch) -> Iterator[pd.DataFrame]:
        if not len(batch):
            return
        table, change = pa.Table.from_batches([batch]), np.zeros(len(batch) - 1, bool)
        for k in self.by:
            codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            change |= codes[1:] != codes[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(table)]
        rows = table.select(self.used).to_pandas()
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(table.column(k)[low].as_py() for k in self.by)
            if self.walk is None or key != self.key:
                yield from self.rest()
                self.key, self.walk = key, self.start(key)
            part = rows.iloc[low:high] if self.open is None else pd.concat([self.open, rows.iloc[low:high]])
            earlier = np.zeros(len(part), bool)
            for c in self.frame:
                values = part[c].to_numpy()
                earlier |= values != values[-1]
            cut = int(earlier.nonzero()[0][-1]) + 1 if earlier.any() else 0
            self.open = part.iloc[cut:]
            if cut:
                yield self._stepped(part.iloc[:cut])

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.open is not None and len(self.open):
            yield self._stepped(self.open)
        self.open = None

    def _stepped(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = self.walk(rows)
        for k, name in enumerate(self.by[:-1]):
            out.insert(k, name, self.key[k])
        return out
