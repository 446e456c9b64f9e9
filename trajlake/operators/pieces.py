"""Windows over long groups, cut into pieces: each piece is ordered on its own, and only one row of each is ordered for the
whole group, so that one group with a third of all rows is spread over many tasks. Rows with a null key are a group like others."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Seconds, or numbers of frames, in a piece: some thousand rows of a sequence with the usual frame rates.
SECONDS, FRAMES = 64.0, 2048
#: Internal columns have names of their own, so that no input column gives way to them.
PIECE = "trajlake_piece"


def by_step(df: DataFrame, value: str, step: float) -> DataFrame:
    """df with the piece of each row, by the steps of a column; nulls come first, in a piece of their own."""
    return df.withColumn(PIECE, F.coalesce(F.floor(F.col(value) / step).cast("long"), F.lit(-(1 << 62))))


def by_range(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with the piece of each row: ranges of equal size in this order. As they come from a sample, write the result
    (tables.kept) before it is read twice."""
    return df.repartitionByRange(*order).withColumn(PIECE, F.spark_partition_id().cast("long"))


def earlier(by: list[str]) -> WindowSpec:
    """The pieces before, nearest last."""
    return Window.partitionBy(*by).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)


def later(by: list[str]) -> WindowSpec:
    """The pieces behind, nearest last."""
    return Window.partitionBy(*by).orderBy(F.col(PIECE).desc()).rowsBetween(Window.unboundedPreceding, -1)


def carry(rows: DataFrame, by: list[str], parts: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """rows with the columns of `carried`: windows (earlier, later) over the aggregates `parts` of each piece."""
    each = rows.groupBy(*by, PIECE).agg(*(c.alias(n) for n, c in parts.items()))
    names = {k: f"trajlake_key_{i}" for i, k in enumerate([*by, PIECE])}
    each = each.select(*(F.col(k).alias(n) for k, n in names.items()), *(c.alias(n) for n, c in carried.items()))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return rows.join(each, same).drop(*names.values())


def inside(by: list[str], *order: str | Column) -> WindowSpec:
    return Window.partitionBy(*by, PIECE).orderBy(*order)


def up_to_here(by: list[str], *order: str | Column) -> WindowSpec:
    return inside(by, *order).rowsBetween(Window.unboundedPreceding, 0)
