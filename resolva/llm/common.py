"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resolva.session import scratch_path
from resolva.sources.publish import remove

#: Columns of the documents table.
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Spark's own setting: a query's shuffle files go when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For writes that end a plan: nothing reads their shuffles again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table once to the shared checkpoint folder and read it back.

    Cuts lineage, gives later branches one fixed version of the rows, and
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{tag}-{uuid.uuid4().hex}")
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete the tables whose tags begin with `folder/`, once nothing reads them."""
    remove(spark, scratch_path(spark, f"llm/{folder}"))


class Rounds:
    """A table that grows by a part per round, in one folder: the plan that reads
    all rounds stays the same size however many there are."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.n = spark, scratch_path(spark, f"llm/{tag}-{uuid.uuid4().hex}"), 0

    def add(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Write one round's rows; gives them and the rows of all rounds."""
        path = f"{self.root}/round={self.n}"
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        self.n += 1
        whole = self.spark.read.schema(df.schema).option("basePath", self.root).parquet(self.root)
        return self.spark.read.schema(df.schema).parquet(path), whole.select(*df.columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with the frame's own, whatever extra
    columns the caller brings."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression to a lambda variable so that inner lambdas read its
    value instead of computing it again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_row_id(df: DataFrame, name: str, tag: str) -> DataFrame:
    """Materialise rows with a unique long id. `doc_id` may be null or repeat,
    so joins back to a row go over this id; it is written, hence stable."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), tag)
