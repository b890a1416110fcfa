"""Row-wise projections between the raw, stored and displayed layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlake.functions.text import base_name, join_present
from orderlake.schema import (
    BROWSE_COLUMNS,
    DISPLAY_TO_STORED,
    ORDER_LINE_COLUMNS,
    SEARCH_COLUMNS,
    STORED_TO_DISPLAY,
)


def conform(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the public columns, in order, as text; absent ones become blank.

    ``keep`` names extra columns to carry along, such as the ingest key.
    """
    public = [
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns
        else F.lit("").alias(c)
        for c in ORDER_LINE_COLUMNS
    ]
    return df.select(*[F.col(c) for c in keep], *public)


def rename_to_display(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored column names to display names, text blank where it is missing.

    Of the internal columns the id is shown, and those named in ``keep``.
    """
    names = {s: d for s, d in STORED_TO_DISPLAY.items() if s in records.columns}
    internal = [c for c in ("id", *keep) if c in records.columns]
    shown = [
        F.col(c) if c.endswith("_at") else F.coalesce(c, F.lit("")).alias(c) for c in names
    ]
    return records.select(*internal, *shown).withColumnsRenamed(names)


def rename_to_stored(lines: DataFrame) -> DataFrame:
    return lines.withColumnsRenamed(DISPLAY_TO_STORED)


def browse(lines: DataFrame) -> DataFrame:
    return lines.select(*[c for c in BROWSE_COLUMNS if c in lines.columns])


def search_document(lines: DataFrame, stored: bool = False):
    """The searchable text of a line, as a Column over the present fields."""
    names = [DISPLAY_TO_STORED[c] if stored else c for c in SEARCH_COLUMNS]
    return join_present(" ", [F.col(c) for c in names if c in lines.columns])


def with_provenance(pages: DataFrame) -> DataFrame:
    """File name and one-based number of each page.

    The name is the base name of the path, unless the table gives one of its own.
    """
    own_name = "Source_File" in pages.columns
    return pages.withColumns({
        "Source_File": F.col("Source_File") if own_name else base_name(F.col("path")),
        "Source_Page": (F.col("page_index") + 1).cast("string"),
    })


def page_range(pages: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Pages with ``start <= page_index < end``; an end past the file is no error."""
    wanted = pages.filter(F.col("page_index") >= start)
    return wanted if end is None else wanted.filter(F.col("page_index") < end)
