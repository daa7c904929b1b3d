"""Exact fixed-size, reproducible sampling without a single-task top-n.

Rows are ordered by `md5(seed ':' key)` (ties, practically impossible, by
key); the sample is the first n rows of that order. Instead of
`orderBy(hash).limit(n)` — which funnels n rows per task into one final
task — the n-th hash is located with counts over hash prefixes: md5 hex
digits are uniform, so 4-digit prefixes split the rows into 65,536 even
buckets. Only the (prefix, count) table (≤ 65,536 rows) reaches the driver;
the bucket holding the n-th row is refined with the next 4 digits until it
is small, then ranked exactly. The result is a plain filter `hash ≤ cutoff`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 4
SMALL_BUCKET = 200_000


def sample_hash(key, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _prefix_counts(tagged: DataFrame, prefix: str) -> list:
    depth = len(prefix) + PREFIX_DIGITS
    scope = tagged.filter(F.startswith(F.col("_h"), F.lit(prefix))) if prefix else tagged
    return (scope.groupBy(F.substring("_h", 1, depth).alias("b"))
                 .agg(F.count(F.lit(1)).alias("c"))
                 .orderBy("b").collect())


def sample_fixed(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The n rows with the smallest md5(seed:key); all rows when n ≥ count.

    The first prefix-count pass also yields the row count, so the common
    case costs two scans (counts, final filter) plus a small ranked bucket.
    """
    tagged = df.withColumn("_h", sample_hash(F.col(key), seed))
    counts = _prefix_counts(tagged, "")
    total = sum(r["c"] for r in counts)
    if n >= total:
        return df
    if n <= 0:
        return df.limit(0)
    remaining, prefix = n, ""
    while True:
        acc = 0
        for row in counts:
            if acc + row["c"] >= remaining:
                bucket, bucket_count = row["b"], row["c"]
                break
            acc += row["c"]
        remaining -= acc
        prefix = bucket
        if bucket_count <= SMALL_BUCKET or len(prefix) >= 32:
            break
        counts = _prefix_counts(tagged, prefix)
    bucket = tagged.filter(F.startswith(F.col("_h"), F.lit(prefix)))
    # exact rank inside the one small bucket, or a single hash value
    cut = prefix if len(prefix) >= 32 else bucket.select("_h").orderBy("_h").offset(remaining - 1).limit(1).first()["_h"]
    remaining -= bucket.filter(F.col("_h") < F.lit(cut)).count()
    below = tagged.filter(F.col("_h") < F.lit(cut)).drop("_h")
    return below.unionByName(_take_equal(tagged.filter(F.col("_h") == F.lit(cut)).drop("_h"), remaining, seed))


def _take_equal(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """n of the rows that share the cutoff key, by a hash of the whole row;
    rows equal in every column are interchangeable."""
    by_row = rows.withColumn("_row", F.md5(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})))
    if by_row.select("_row").distinct().limit(2).count() < 2:
        return rows.limit(n)
    return sample_fixed(by_row, n, "_row", seed).drop("_row")
