"""String predicates and clean-ups as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: what stands in place of a scrubbed token.
SCRUBBED = "sample-scan"
# The same set as a regular-expression class.
SPACE_CLASS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
NON_SPACE_CLASS = r"[^\t-\r\x1c-\x1f\x85\p{Z}]"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim every kind of white space; plain ``trim`` takes spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def has_text(c: Column) -> Column:
    return F.length(strip(blank_if_null(c))) > 0


def join_present(separator: str, columns: Iterable[Column]) -> Column:
    """Join the non-blank values; ``concat_ws`` alone would keep the blanks."""
    return F.concat_ws(separator, *[F.nullif(c, F.lit("")) for c in columns])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def zip_prefix(c: Column) -> Column:
    """The three-digit area of a postal code."""
    return F.substring(F.regexp_replace(blank_if_null(c), "[^0-9]", ""), 1, 3)


def scrub(c: Column, tokens: Iterable[str], replacement: str = SCRUBBED) -> Column:
    """Replace each token, literally and in order."""
    return reduce(lambda acc, token: F.replace(acc, F.lit(token), F.lit(replacement)), tokens, c)


def split_tokens(setting: str) -> list[str]:
    """Tokens from a comma-separated setting, trimmed, blanks dropped."""
    return [token.strip() for token in setting.split(",") if token.strip()]


def contains_any(c: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(word) for word in words])
