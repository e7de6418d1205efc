"""Date parsing that never fails a job: unreadable input becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted date patterns, tried in this order
PATTERNS = [
    "yyyy-M-d",
    "yyyy-M-d H:mm",
    "yyyy-M-d H:mm:ss",
    "yyyy-M-d'T'H:mm:ss",
    "yyyy/M/d",
    "M/d/yyyy",
    "yyyyMMdd",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
]


def strict_date(text: Column) -> Column:
    """An interval endpoint written year-month-day; anything else is null."""
    return F.try_to_date(F.trim(text.cast("string")), "yyyy-M-d")


def tolerant_timestamp(value: Column) -> Column:
    """Mixed date spellings; numbers lose a trailing ``.0``; six digits are year and month."""
    clean = F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")
    parsed = F.coalesce(*[F.try_to_timestamp(clean, F.lit(p)) for p in PATTERNS])
    year_month = F.when(clean.rlike(r"^\d{6}$"), F.try_to_timestamp(clean, F.lit("yyyyMM")))
    return F.coalesce(year_month, parsed)


def to_number(value: Column) -> Column:
    """Number, or null where the text is none."""
    return value.try_cast("double")
