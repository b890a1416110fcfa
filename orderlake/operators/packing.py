"""Whole rows as one text each, for a shuffle.

A row that is shuffled or sorted has a word of eight bytes for each column, and each text is
filled up to whole words. Rows of many short texts therefore take half the disk and memory
when these go as one, which is taken apart again behind the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKED = "_packed"

_BETWEEN, _ESCAPE = "\x1f", "\x1e"
_NULL = f"{_ESCAPE}n"


def packed_rows(df: DataFrame, *apart: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], Callable[[str], Column]]:
    """Rows with their texts in one column, what takes such rows apart again, and what looks one text up in them.

    Columns that are no text stay as they are, and so do those named ``apart``, by which rows are to be dealt or joined.
    Rows that are taken apart have their columns in the old order, and behind them those that came in between.
    Texts may hold any character; a null stays one.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in apart]
    place, others = {name: i for i, name in enumerate(names)}, [c for c in df.columns if c not in names]
    # Few texts hold one of the two characters, so the others are spared the look at each cell, and that is a short loop:
    # as an expression a column it would make a method that the JVM does not compile.
    texts = F.array(*[F.col(c) for c in names]) if names else F.array().cast("array<string>")
    together = F.concat_ws("", texts)
    escaped = F.when(together.contains(_ESCAPE) | together.contains(_BETWEEN), F.transform(texts, _escaped)).otherwise(texts)

    def look_up(name: str) -> Column:
        return _unescaped(F.substring_index(F.substring_index(PACKED, _BETWEEN, place[name] + 1), _BETWEEN, -1))

    def unpack(rows: DataFrame) -> DataFrame:
        added = [c for c in rows.columns if c not in df.columns and c != PACKED]
        given = F.split(PACKED, _BETWEEN)
        cells = F.when(F.col(PACKED).contains(_ESCAPE), F.transform(given, _unescaped)).otherwise(given)
        return rows.withColumn("_cells", cells).select(
            *[F.get("_cells", F.lit(place[c])).alias(c) if c in place else F.col(c) for c in df.columns], *added
        )

    return df.select(*others, F.array_join(escaped, _BETWEEN, _NULL).alias(PACKED)), unpack, look_up


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}e")), F.lit(_BETWEEN), F.lit(f"{_ESCAPE}s"))


def _unescaped(cell: Column) -> Column:
    text = F.replace(F.replace(cell, F.lit(f"{_ESCAPE}s"), F.lit(_BETWEEN)), F.lit(f"{_ESCAPE}e"), F.lit(_ESCAPE))
    return F.when(cell != _NULL, text)
