"""Schemas of results."""

from __future__ import annotations

from pyspark.sql import types as T


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """schema with the fields of ddl at its end; a field of the same name (in any case) gives way."""
    new = T._parse_datatype_string(ddl)
    names = {f.name.lower() for f in new}
    return T.StructType([f for f in schema if f.name.lower() not in names] + list(new))
