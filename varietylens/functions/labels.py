"""Hierarchical label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hierarchy levels, the columns composing each level's label,
# the separator, and the text that stands for a missing part.
LEVEL_COLUMNS = {
    "city": ["dialect_city_id", "dialect_country_id", "dialect_region_id"],
    "country": ["dialect_country_id", "dialect_region_id"],
    "region": ["dialect_region_id"],
}
LEVELS = ["city", "country", "region"]
SEP = "-"
MISSING = "nan"


def compose_label(level: str, cols: dict[str, str] | None = None) -> Column:
    """``city-country-region`` (or a suffix of it) with NULL parts as
    ``nan``. ``cols`` maps canonical column names to the frame's names."""
    cols = cols or {}
    parts = [F.coalesce(F.col(cols.get(c, c)).cast("string"), F.lit(MISSING))
             for c in LEVEL_COLUMNS[level]]
    return F.concat_ws(SEP, *parts)


def drop_first_part(c) -> Column:
    """``a-b-c`` -> ``b-c`` (one level up the hierarchy)."""
    col = F.col(c) if isinstance(c, str) else c
    parts = F.split(col, SEP)
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), SEP)


def second_part(c) -> Column:
    """``a-b`` -> ``b``; NULL when there is no second part."""
    col = F.col(c) if isinstance(c, str) else c
    return F.get(F.split(col, SEP), 1)


def split_list(c) -> Column:
    """Lower-case comma list -> array of trimmed elements."""
    col = F.col(c) if isinstance(c, str) else c
    return F.transform(F.split(F.lower(col), ","), lambda x: F.trim(x))
