"""Incremental ingest of newly dropped CSV exports with Structured Streaming.

The stream carries file names only: a binary file source, whose contents are not
read, tells which files are new, and each micro-batch hands them to the batch ingest, which
profiles every file on its own. So files of one folder may differ in dialect,
column order and title lines. Cases go to `<out>/lote=<batch id>/
ano_finalizacao=<year>/`, catalog rows to `<catalog>/lote=<batch id>`. A
replayed batch overwrites its own folders, so a retry after executor or driver
loss does not duplicate rows. File sources pass over empty files, so these are
listed and logged apart, as `lote=-1`. The checkpoint location tracks which files were
seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.clean import clean_schema
from ..sources import csv_ingest as ci

FILES = "path string, modificationTime timestamp, length long, content binary"


def run_incremental(spark: SparkSession, folders: list[str], out: str, checkpoint: str,
                    catalog: str | None = None) -> DataFrame:
    """Process every file currently in the folders (availableNow) and return the base."""
    queries = []
    for i, folder in enumerate(folders):
        files = (spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", 64)
                 .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(folder).select("path"))

        def write_batch(batch: DataFrame, epoch: int, i=i) -> None:
            paths = sorted(r["path"] for r in batch.distinct().collect())  # at most 64
            if not paths:
                return
            result = ci.ingest_files(batch.sparkSession, paths)
            ci.write_parts(result.cases, f"{out}/fonte={i}/lote={epoch}")
            if catalog:
                result.catalog.write.mode("overwrite").parquet(f"{catalog}/fonte={i}/lote={epoch}")

        q = (files.writeStream.foreachBatch(write_batch)
                  .option("checkpointLocation", f"{checkpoint}/fonte={i}")
                  .trigger(availableNow=True).start())
        queries.append(q)
        if catalog and (empty := ci.list_csv_files(spark, [folder], only_empty=True)):
            ci.ingest_files(spark, empty).catalog.write.mode("overwrite").parquet(f"{catalog}/fonte={i}/lote=-1")
    for q in queries:
        q.awaitTermination()
    schema = clean_schema({"source_file": T.StringType(), "case_id": T.LongType()})
    extra = T.StructType(schema.fields + [T.StructField("fonte", T.IntegerType()),
                                          T.StructField("lote", T.LongType())])
    return spark.read.schema(extra).option("basePath", out).parquet(out).select(*[f.name for f in schema.fields])
