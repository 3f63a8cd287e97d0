"""Keys that different spellings and units share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_key(symbol: Column) -> Column:
    """The instrument that a spelling means: case, blanks and separators do not count."""
    return F.upper(F.regexp_replace(symbol, r"[^\p{L}\p{N}]", ""))


def epoch_us(value: Column) -> Column:
    """Microseconds of an epoch in seconds (below 10^10) or milliseconds."""
    return F.when(value < 10_000_000_000, value * 1_000_000).otherwise(value * 1_000)
