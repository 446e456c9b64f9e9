"""Identity measures: one trajectory to one, so that most frames are shared."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assignment import best_pairs
from .components import pair_components


def shared_frames(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """How many frames an object and a prediction have inside the gate together."""
    return pairs.groupBy(*keys, "oid", "hid").agg(F.count("*").alias("shared"))


def identity_matches(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """idtp by sequence: in each component the one-to-one choice with the largest sum of shared frames. A component in
    which each prediction meets one object, or each object one prediction, is a plain maximum; others are assigned by an
    auction over their pairs, each component a group of its own: a row for each pair of ids that meets, no matrix."""
    shared = shared_frames(pairs, keys).join(pair_components(pairs, keys), [*keys, "oid", "hid"])
    sizes = shared.groupBy(*keys, "component").agg(F.countDistinct("oid").alias("objects"), F.countDistinct("hid").alias("predictions"))
    joined = shared.join(sizes, [*keys, "component"])
    plain = joined.filter("objects = 1 OR predictions = 1").groupBy(*keys, "component").agg(F.max("shared").alias("idtp"))

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shared = group.shared.to_numpy()
        most = shared[best_pairs(group.oid.to_numpy(), group.hid.to_numpy(), shared)].sum()
        return pd.DataFrame([[*key, int(most)]], columns=[*keys, "component", "idtp"])

    kinds = dict(pairs.dtypes)
    solved = joined.filter("objects > 1 AND predictions > 1").groupBy(*keys, "component").applyInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "component long", "idtp long"]))
    return plain.unionByName(solved).groupBy(*keys).agg(F.sum("idtp").alias("idtp"))
