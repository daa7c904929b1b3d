"""The cleaned case base: written once per input version, read by every later step.

Like the original flow (clean → parts on disk → profiling / splits /
training read the parts), the cleaning job writes a Parquet base
partitioned by close year under the shared checkpoint folder; later queries
read it, so year filters prune partitions and no query re-plans the raw
joins and text cleaning. The base is keyed by the input files' sizes and
modification times and published by a marker (`publish.py`).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_cases, clean_schema
from ..schema import CLOSE_YEAR
from ..session import scratch_path
from .publish import file_system, publish
from .tables import raw_cases

#: Goes into the keys of written tables; changes with the rules or columns of the raw and cleaned cases.
CLEANING = "2"
_INPUTS = ("orders", "customer", "nation", "region")


def _fingerprint(spark: SparkSession, source: str) -> str:
    """Input-version key: sizes, file counts and mtimes of the shared input
    tables when `source` holds them, else of the whole `source` folder."""
    root = source.rstrip("/")
    parts = [root, CLEANING]
    names = [f"{root}/{n}.parquet" for n in _INPUTS]
    fs0, _ = file_system(spark, root)
    jvm = spark.sparkContext._jvm
    if not all(fs0.exists(jvm.org.apache.hadoop.fs.Path(x)) for x in names):
        names = [root]
    for name in names:
        fs, p = file_system(spark, name)
        st = fs.getContentSummary(p)
        mt = fs.getFileStatus(p).getModificationTime()
        parts.append(f"{name}:{st.getLength()}:{st.getFileCount()}:{mt}")
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def write_by_year(df: DataFrame, path: str, salt_cols: list[str]) -> None:
    """Year-partitioned Parquet without the small-file explosion.

    Rows are distributed by (year, hash salt) first, so each task writes one
    or a few years and a year holding a third of all rows still spreads over
    many tasks (AQE coalesces the tiny ones).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(max(1, n)))
    # no explicit partition count: AQE may coalesce small partitions (few, larger files)
    (df.repartition(F.col(CLOSE_YEAR), salt)
       .write.mode("overwrite").partitionBy(CLOSE_YEAR).parquet(path))


def base_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the cleaned cases for `sf_dir`, partitioned by `ano_finalizacao`."""
    def write(path: str) -> None:
        write_by_year(clean_cases(raw_cases(spark, sf_dir)), path, ["case_id"])

    return publish(spark, scratch_path(spark, f"clean_base/{_fingerprint(spark, sf_dir)}"), write)["path"]


def cleaned_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = clean_schema()
    df = spark.read.schema(template).parquet(base_path(spark, sf_dir))
    return df.select(*[F.col(f.name) for f in template.fields])
