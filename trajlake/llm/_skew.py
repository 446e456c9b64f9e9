"""Joins to a table of groups of which some may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from 1/HEAVY of all rows on, so there are at most HEAVY such keys: the bound of what is broadcast.
HEAVY = 2048


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows to groups, which has one row for each key with the number of rows in `size`.

    Heavy keys are broadcast (at most HEAVY rows), the others are shuffled; no task gets more than a small share of a key.
    """
    most = max(1, total // HEAVY)
    heavy, light = groups.filter(F.col(size) > most), groups.filter(F.col(size) <= most)
    found = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return found.unionByName(rest)
