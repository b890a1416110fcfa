"""Column names that operators add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def without(df: DataFrame, names) -> DataFrame:
    """``df`` less the columns that have one of these names, in any case: the operator's own column takes their place."""
    taken = {n.lower() for n in names}
    return df.select(*[c for c in df.columns if c.lower() not in taken])


def added(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """The schema of ``df`` with ``fields`` after it; ``df`` holds none of these names."""
    return T.StructType([*df.schema.fields, *fields])
