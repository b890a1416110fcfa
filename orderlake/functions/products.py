"""Product standardisation: the catalog is data, the matching is expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlake.functions.text import blank_if_null, contains_any


@dataclass(frozen=True)
class Family:
    """One catalog entry and the spellings that lead to it."""

    code: str
    category: str
    name: str
    contains: tuple[str, ...] = ()
    starts_with: tuple[str, ...] = ()
    tiered: bool = True


@dataclass(frozen=True)
class Catalog:
    """Families in matching order; the last one takes whatever is left."""

    families: tuple[Family, ...]
    tier_labels: dict[str, str] = field(default_factory=dict)
    default_tier: str = "1"
    unknown_category: str = "Other"


# Catalog entries, spellings and pack sizes.
DEFAULT_CATALOG = Catalog(
    families=(
        Family("SAMP", "Sampler", "Sampler Pack",
               contains=("SAMP", "SAMPLE", "SMPL", "SIMPLER"), tiered=False),
        Family("CARM", "Caramels", "Signature Caramels", contains=("CAR", "CRAV")),
        Family("GUMM", "Gummies", "Botanical Gummies",
               contains=("GUM", "GALACTIC", "GLM"), starts_with=("MG",)),
        Family("CHOC", "Chocolate", "Dark Chocolate Bar",
               contains=("CHO", "BAR", "HERO", "HERB", "HBAR", "MUSH", "MMB", "MMC")),
        Family("ASST", "Assorted", "Assorted Selection", tiered=False),
    ),
    tier_labels={"1": "1-Pack", "3": "3-Pack", "5": "5-Pack"},
)


def _matches(text: Column, family: Family) -> Column:
    tests = [contains_any(text, family.contains)] if family.contains else []
    tests += [text.startswith(prefix) for prefix in family.starts_with]
    return reduce(lambda a, b: a | b, tests)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _family(code: Column, description: Column, catalog: Catalog, value) -> Column:
    """CASE over the families in matching order; ``value`` gives each result."""
    text = F.upper(F.concat(blank_if_null(code), F.lit(" "), blank_if_null(description)))
    *matchable, fallback = catalog.families
    result = F.lit(value(fallback))
    for fam in reversed(matchable):
        result = F.when(_matches(text, fam), F.lit(value(fam))).otherwise(result)
    return result


def family_code(code: Column, description: Column, catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """First family with a matching spelling in code + description."""
    return _family(code, description, catalog, lambda f: f.code)


def pack_tier(code: Column, catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """Pack size: the first lone digit after a dash, else the last digit, else the default."""
    code = blank_if_null(code)
    known = list(catalog.tier_labels)
    after_dash = F.regexp_extract(code, r"-(\p{Nd})(?:\P{Nd}|$)", 1)
    trailing = F.regexp_extract(code, r"(\p{Nd})\s*$", 1)
    return (
        F.when(after_dash.isin(known), after_dash)
        .when(trailing.isin(known), trailing)
        .otherwise(F.lit(catalog.default_tier))
    )


def canonical_code(code: Column, description: Column, catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """Canonical code of one line: the family, with the pack size where it has one."""
    stem = _family(code, description, catalog, lambda f: f.code + "-" * f.tiered)
    return F.when(stem.endswith("-"), F.concat(stem, pack_tier(code, catalog))).otherwise(stem)


def canonical_description(canonical: Column, catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """Description of a canonical code. It always comes from the catalog, so
    nothing of the source text is carried over."""
    names = {}
    for f in catalog.families:
        if f.tiered:
            names |= {f"{f.code}-{t}": f"{f.name} — {x}" for t, x in catalog.tier_labels.items()}
        else:
            names[f.code] = f.name
    return _lookup(canonical, names)


def category_of(code: Column, catalog: Catalog = DEFAULT_CATALOG) -> Column:
    """Category of an already canonical code."""
    prefix = F.substring_index(blank_if_null(code), "-", 1)
    categories = {f.code: f.category for f in catalog.families}
    return F.coalesce(_lookup(prefix, categories), F.lit(catalog.unknown_category))
