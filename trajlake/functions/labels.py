"""Names, paths, ids and report cells as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dataset_label(key: Column) -> Column:
    """The key without underscores behind its first two characters."""
    return F.concat(F.substring(key, 1, 2), F.replace(F.substr(key, F.lit(3)), F.lit("_"), F.lit("")))


def file_label(name: Column) -> Column:
    return F.translate(name, ", ", "--")


def image_path(folder: Column, number: Column, extension: str = ".jpg") -> Column:
    return F.concat(folder, F.lit("/"), F.format_string("%06d", number), F.lit(extension))


def hex_id(traj_id: Column) -> Column:
    return F.format_string("%x", traj_id)


def class_name(classes: Column, class_id: Column) -> Column:
    return F.get(classes, class_id)


def summary(columns: list[tuple[str, str, str]]) -> Column:
    """One line of a report: for each (metric, header, format) whose metric is there, header and formatted value."""
    return F.concat_ws(" ", *(F.when(F.col(k).isNotNull(), F.concat(F.lit(h), F.format_string(f, F.col(k)))) for k, h, f in columns))


def seconds_ago(then: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(then)
