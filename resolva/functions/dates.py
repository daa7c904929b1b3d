"""Mixed-format date parsing with `try_to_timestamp` (ANSI-safe: bad → NULL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two export formats, and the fallback patterns tried in order
# for anything else (day-first, as the exports are Brazilian).
ISO_REGEX = r"^\d{4}-\d{2}-\d{2}$"
BR_REGEX = r"^\d{2}/\d{2}/\d{4}$"
FALLBACK_PATTERNS = [
    "d/M/yyyy",
    "dd/MM/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "d/M/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-M-d",
    "dd-MM-yyyy",
    "d-M-yyyy",
    "dd.MM.yyyy",
]


def _ts(s: Column, fmt: str) -> Column:
    return F.try_to_timestamp(s, F.lit(fmt))


def parse_mixed_date(c: Column) -> Column:
    """ISO `yyyy-MM-dd`, Brazilian `dd/MM/yyyy`, else the day-first fallbacks.

    Impossible dates ('31/02/2024') and unknown text give NULL.
    """
    s = F.trim(c)
    fallback = F.coalesce(*[_ts(s, p) for p in FALLBACK_PATTERNS])
    return (F.when(s.rlike(ISO_REGEX), _ts(s, "yyyy-MM-dd"))
             .when(s.rlike(BR_REGEX), _ts(s, "dd/MM/yyyy"))
             .otherwise(fallback))


def year_of(c: Column) -> Column:
    return F.year(c).cast("int")


def month_of(c: Column) -> Column:
    return F.month(c).cast("int")
