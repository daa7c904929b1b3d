"""Exact stratified folds without ranking a class in one task.

Rows of a class are ordered by `md5(seed ':' key)`, and row i of that order is
in fold i mod k, so fold sizes of a class differ by at most one. The position
comes from counts: hashes are uniform, so (class, hash prefix) cuts a class
into even buckets; running offsets over the bucket counts and a rank inside
each bucket give it. Rows that share a hash (equal keys) are dealt by a hash
of the whole row, and rows equal in every column are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import as_lookup
from .sampling import PREFIX_DIGITS, sample_hash


def stratified_folds(df: DataFrame, by: str, k: int = 3, key: str = "case_id", seed: int = 42, into: str = "_fold",
                     digits: int = PREFIX_DIGITS) -> DataFrame:
    """Add the fold number, 0 to k - 1. `digits` hex digits make the buckets:
    65,536 a class by default, whose counts are the lookup table."""
    h = sample_hash(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)
    row = F.xxhash64(*df.columns)
    tagged = df.select("*", h.alias("_h"), row.alias("_row"), F.substring(h, 1, digits).alias("_bucket"))
    sizes = tagged.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(by).alias("_class"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = tagged.join(as_lookup(offsets, 1_000_000), F.col(by).eqNullSafe(F.col("_class")) & (F.col("_bucket") == F.col("_at")))
    rank = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy("_h", key, "_row"))
    return placed.select(*df.columns, F.pmod(F.col("_offset") + rank - 1, F.lit(k)).cast("int").alias(into))
