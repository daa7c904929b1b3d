"""Publish a folder once under a key, whole or not at all.

A writer fills a version folder of its own and then renames a small JSON
marker into place. The marker alone says which version is current, so a
half-written folder is never read, a failed writer leaves nothing that counts,
and of two writers at once both end with the version that the marker names;
the other version is removed by its writer. Every file operation's answer is
looked at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "CURRENT.json"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its own object."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def published(spark: SparkSession, root: str) -> dict | None:
    """The marker's content with the version's `path`, or None."""
    text = _read(spark, f"{root}/{MARKER}")
    if text is None:
        return None
    content = json.loads(text)
    return content | {"path": f"{root}/{content['version']}"}


def publish(spark: SparkSession, root: str, write: Callable[[str], dict | None]) -> dict:
    """What is published under `root`; if nothing is, `write(path)` fills a new
    version and what it returns enters the marker."""
    found = published(spark, root)
    if found is not None:
        return found
    version = f"v-{uuid.uuid4().hex}"
    content = {"version": version} | (write(f"{root}/{version}") or {})
    fs, marker = file_system(spark, f"{root}/{MARKER}")
    _, draft = file_system(spark, f"{root}/{version}.marker")
    out = fs.create(draft, True)
    try:
        out.write(json.dumps(content, ensure_ascii=False, sort_keys=True).encode())
    finally:
        out.close()
    if fs.exists(marker) or not fs.rename(draft, marker):
        fs.delete(draft, False)
    found = published(spark, root)
    if found is None:
        raise RuntimeError(f"no marker could be written under {root}")
    if found["version"] != version:
        _, own = file_system(spark, f"{root}/{version}")
        fs.delete(own, True)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a run's folder once its result has been written elsewhere."""
    fs, p = file_system(spark, path)
    if fs.exists(p) and not fs.delete(p, True):
        raise RuntimeError(f"could not delete {path}")


def rows_fingerprint(rows: DataFrame, by: list[str] | None = None) -> list[list[str]]:
    """Per group: row count and order-free sums of two hashes over all columns.
    Equal tables have equal fingerprints in every session and on every cluster."""
    columns = sorted(c for c in rows.columns if c not in (by or []))
    table = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("a"),
        F.sum(F.xxhash64(F.lit("second"), *columns).cast("decimal(20,0)")).alias("b"))
    return sorted([str(x) for x in r] for r in table.collect())
