"""Multi-file CSV ingest with per-file dialect detection and error isolation.

1. File profile job: every file is read once as lines by Spark's own text
   reader (so any Hadoop file system works). Per file it yields the first two
   lines, whether all bytes are valid UTF-8, whether some line leaves a quote
   open, and whether all bytes were read. A small task then tries every
   (encoding, separator, skipped lines) combination on the header; the score
   is the number of header names found in the header dictionary. Files scoring
   < 5, empty files and files that cannot be read whole become `erro` rows.
2. Files sharing a dialect and header are read by ONE `spark.read.csv` with
   an explicit all-string schema (no inference, splittable unless a file has
   quoted line breaks), the known columns renamed to canonical names, NA
   tokens mapped to NULL. Files are told apart by their full path.
   A row with fewer or more fields than its header is padded or cut, as the
   original reader did, and kept in a side table with its text; the catalog
   counts such rows per file. With `reject`, they do not become cases.
3. Files missing a required column are logged `ignorado_colunas_faltando`;
   the rest are unified by name and cleaned in one lineage.
4. The catalog aggregates per file: rows read, rows kept, class counts,
   close-year range, status and dialect.
"""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import header_key, null_na_tokens
from ..operators.clean import clean_cases
from ..schema import CLOSE_YEAR, HEADER_MAP, REQUIRED_COLUMNS, TARGET
from .tables import union_by_name

# Dialect trial order (first trial wins ties), acceptance bar.
ENCODINGS = ["latin1", "cp1252", "utf-8-sig"]
SEPARATORS = [";", "\t", ","]
SKIP_OPTIONS = [0, 1]
MIN_HITS = 5
SPARK_CHARSET = {"latin1": "ISO-8859-1", "cp1252": "windows-1252", "utf-8-sig": "UTF-8"}

PROFILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("arquivo", T.StringType()),
    T.StructField("encoding", T.StringType()),
    T.StructField("sep", T.StringType()),
    T.StructField("skiprows", T.IntegerType()),
    T.StructField("acertos", T.IntegerType()),
    T.StructField("headers", T.ArrayType(T.StringType())),
    T.StructField("skipped", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("multiline", T.BooleanType()),
    T.StructField("erro", T.StringType()),
])

CATALOG_SCHEMA = T.StructType([
    T.StructField("arquivo", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("linhas_lidas", T.LongType()), T.StructField("linhas_filtradas", T.LongType()),
    T.StructField("resolvidas", T.LongType()), T.StructField("nao_resolvidas", T.LongType()),
    T.StructField("ano_min", T.IntegerType()), T.StructField("ano_max", T.IntegerType()),
    T.StructField("encoding", T.StringType()), T.StructField("sep", T.StringType()),
    T.StructField("skiprows", T.IntegerType()), T.StructField("linhas_curtas", T.LongType()),
    T.StructField("linhas_longas", T.LongType()), T.StructField("erro", T.StringType()),
])
#: Where the reader puts the text of a row whose number of fields differs from the header's.
CORRUPT = "_linha_fora_do_formato"


def detect_dialect(head: bytes, valid_utf8: bool | None = None) -> dict:
    """Best (encoding, sep, skip) for the first lines of a file; ties → first
    trial in order, except that a file of strict UTF-8 with characters outside
    ASCII prefers utf-8-sig among ties. `valid_utf8` says so for the whole
    file; when absent, the head alone decides."""
    trials = []
    for enc in ENCODINGS:
        try:
            text = head.decode(enc)
        except UnicodeDecodeError:
            continue
        lines = text.splitlines()
        for sep in SEPARATORS:
            for skip in SKIP_OPTIONS:
                if len(lines) <= skip:
                    continue
                header = next(csv.reader(io.StringIO(lines[skip]), delimiter=sep), [])
                hits = sum(1 for h in header if header_key(h) in HEADER_MAP)
                skipped = [next(csv.reader(io.StringIO(x), delimiter=sep), []) for x in lines[:skip]]
                trials.append({"encoding": enc, "sep": sep, "skiprows": skip, "acertos": hits,
                               "headers": header, "skipped": skipped})
    if not trials:
        raise ValueError("header could not be read with any dialect")
    top = max(t["acertos"] for t in trials)
    best = [t for t in trials if t["acertos"] == top]
    if valid_utf8 is None:
        try:
            head.decode("utf-8")
            valid_utf8 = any(b > 0x7F for b in head)
        except UnicodeDecodeError:
            valid_utf8 = False
    if valid_utf8:
        utf = [t for t in best if t["encoding"] == "utf-8-sig"]
        if utf:
            return utf[0]
    return best[0]


def _profile_batches(batches):
    for pdf in batches:
        rows = []
        for path, first, second, utf8, quotes, whole in zip(pdf["path"], pdf["first"], pdf["second"], pdf["utf8"], pdf["quotes"], pdf["whole"]):
            name = path.rstrip("/").rsplit("/", 1)[-1]
            row = {"path": path, "arquivo": name, "encoding": None, "sep": None, "skiprows": None, "acertos": 0,
                   "headers": [], "skipped": [], "multiline": bool(quotes), "erro": None}
            try:
                if first is None:
                    raise ValueError("empty file")
                if not whole:
                    raise OSError("the file could not be read whole")
                head = bytes(first) + b"\n" + (b"" if second is None else bytes(second) + b"\n")
                row.update(detect_dialect(head, bool(utf8)))
                if row["acertos"] < MIN_HITS:
                    row["erro"] = f"ValueError: unexpected header ({row['acertos']} known columns)"
            except Exception as e:  # noqa: BLE001 - isolated per file, logged in the catalog
                row["erro"] = f"{type(e).__name__}: {e}"
            rows.append(row)
        yield pd.DataFrame(rows, columns=[f.name for f in PROFILE_SCHEMA.fields])


def file_path_col() -> Column:
    """The path of a row's file as written; Spark's metadata column percent-encodes it."""
    return F.try_url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def list_csv_files(spark: SparkSession, folders: list[str], only_empty: bool = False) -> list[str]:
    """Sorted *.csv paths under the folders (recursive), via the Hadoop filesystem."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            continue
        it = fs.listFiles(p, True)
        while it.hasNext():
            found = it.next()
            s = found.getPath().toString()
            if s.lower().endswith(".csv") and not (only_empty and found.getLen()):
                out.append(s)
    return sorted(out)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw lines with the file's path and size; bytes are kept as they are."""
    return (spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", True).text([_glob_safe(p) for p in paths])
            .select(file_path_col().alias("path"), F.col("_metadata.file_size").alias("size"),
                    F.col("_metadata.file_block_start").alias("start"), "value"))


def _glob_safe(path: str) -> str:
    """Spark expands glob patterns in read paths; take names literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def profile_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Dialect profile, one row per file, computed on executors."""
    lines = _lines(spark, paths)
    flags = lines.groupBy("path").agg(
        (F.min(F.is_valid_utf8("value")) & F.max(F.col("value").rlike(r"[^\x00-\x7F]"))).alias("utf8"),
        F.max(F.regexp_count("value", F.lit('"')) % 2 == 1).alias("quotes"),
        # every line has a line break but the last, which may lack one; a byte order mark (3 bytes) is not in the lines
        (F.sum(F.octet_length("value")) + F.count(F.lit(1)) - F.max("size")).alias("over"))
    flags = flags.select("path", (F.col("utf8") | F.col("over").isin(-3, -2)).alias("utf8"), "quotes",
                         F.col("over").isin(0, 1, -3, -2).alias("whole"))
    # the lines of a file's first split stand side by side in one task, so their
    # numbers are consecutive and the first two differ in parity
    first = lines.filter("start = 0").select("path", F.struct(F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line")).alias("x"))
    heads = first.groupBy("path").agg(*[F.min(F.when(F.col("x.at") % 2 == i, F.col("x"))).alias(f"x{i}") for i in (0, 1)])
    heads = heads.select("path", F.sort_array(F.filter(F.array("x0", "x1"), lambda x: x.isNotNull())).alias("x")).select(
        "path", F.get("x", F.lit(0))["line"].alias("first"), F.get("x", F.lit(1))["line"].alias("second"))
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.join(flags, "path", "left").join(heads, "path", "left").mapInPandas(_profile_batches, PROFILE_SCHEMA)


@dataclass
class IngestResult:
    cases: DataFrame      # cleaned rows with source_file
    catalog: DataFrame    # one row per file
    profile: DataFrame    # dialect per file
    malformed: DataFrame  # rows with too few (curta) or too many (longa) fields: source_path, source_file, tipo, linha


def _read_group(spark: SparkSession, paths: list[str], enc: str, sep: str, skip: int,
                headers: list[str], titles: list[tuple[str, list[str]]], multiline: bool = False) -> DataFrame:
    """Rows of the files of one dialect. `titles` has (path, fields) of the
    skipped lines: the CSV source cannot skip lines, so a file's own title and
    header lines are removed by value."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(headers))] + [T.StructField(CORRUPT, T.StringType())])
    reader = (spark.read.schema(schema)
              .option("sep", sep).option("encoding", SPARK_CHARSET[enc])
              .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
              .option("columnPruning", False)      # a pruned parse does not count the fields
              .option("header", skip == 0).option("multiLine", multiline))
    df = reader.csv([_glob_safe(p) for p in paths])
    cols = [F.col(f"_c{i}") for i in range(len(headers))]
    df = df.select("*", file_path_col().alias("source_path"))
    if skip:
        def fields(line):
            return [x or None for x in line[:len(headers)]] + [None] * (len(headers) - len(line))
        drop = spark.createDataFrame([(p, fields(x)) for p, x in titles] + [(p, fields(headers)) for p, _ in titles],
                                     "source_path string, _line array<string>").distinct()
        df = df.withColumn("_line", F.array(*[F.when(c != "", c) for c in cols])).join(drop, ["source_path", "_line"], "left_anti")
    known, seen = [], set()
    for i, h in enumerate(headers):
        canon = HEADER_MAP.get(header_key(h))
        if canon and canon not in seen:
            seen.add(canon)
            known.append(null_na_tokens(F.col(f"_c{i}")).alias(canon))
    unquoted = F.regexp_replace(CORRUPT, r'"([^"]|"")*"', "")
    n_fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit(""))) + 1
    # the reader refuses queries of its corrupt-record column alone, so a field takes part
    bad = F.col(CORRUPT).isNotNull() & ~F.col("_c0").eqNullSafe("\x00")
    odd = F.when(bad, F.when(n_fields < len(headers), "curta").otherwise("longa"))
    return df.select("source_path", F.substring_index("source_path", "/", -1).alias("source_file"), odd.alias("tipo"),
                     F.col(CORRUPT).alias("linha"), *known)


def with_row_key(df: DataFrame) -> DataFrame:
    """Deterministic row key: 64-bit hash of the file name and every raw field
    (NULL-safe, order-aware). It is stable under recomputation after executor
    loss, unlike a generated id; identical rows of one file share a key."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns]
    return df.withColumn("case_id", F.xxhash64(F.concat_ws("\u0001", *fields)))


def ingest(spark: SparkSession, folders: list[str], reject: bool = False) -> IngestResult:
    """Ingest every *.csv under the folders."""
    paths = list_csv_files(spark, folders)
    if not paths:
        raise RuntimeError(f"no .csv files under {folders}")
    return ingest_files(spark, paths, reject)


def ingest_files(spark: SparkSession, paths: list[str], reject: bool = False) -> IngestResult:
    """Ingest the given files; with `reject`, rows with too few or too many
    fields are set aside and not counted as kept."""
    profile = profile_files(spark, paths).checkpoint()
    rows = profile.collect()          # one row per file
    groups: dict[tuple, list[str]] = {}
    titles: dict[tuple, list[tuple[str, list[str]]]] = {}
    for r in rows:
        if r["erro"]:
            continue
        key = (r["encoding"], r["sep"], r["skiprows"], tuple(r["headers"]), r["multiline"])
        groups.setdefault(key, []).append(r["path"])
        titles.setdefault(key, []).extend((r["path"], list(x)) for x in (r["skipped"] or []))
    raw_parts, good_parts = [], []
    for key, gpaths in groups.items():
        enc, sep, skip, headers, multiline = key
        part = _read_group(spark, gpaths, enc, sep, skip, list(headers), titles[key], multiline)
        raw_parts.append(part.select("source_path", "source_file", "tipo", "linha",
                                     F.lit(all(c in part.columns for c in REQUIRED_COLUMNS)).alias("_ok")))
        if all(c in part.columns for c in REQUIRED_COLUMNS):
            good_parts.append((part.filter("tipo IS NULL") if reject else part).drop("tipo", "linha"))
    spark_empty = spark.createDataFrame([], "source_path string, source_file string, tipo string, linha string, _ok boolean")
    raw = union_by_name(raw_parts) if raw_parts else spark_empty
    if good_parts:
        unified = union_by_name([p.select(*[F.col(c).cast("string") for c in p.columns]) for p in good_parts])
        cases = clean_cases(with_row_key(unified), keep=("source_file", "source_path", "case_id"))
    else:
        cases = None
    read = raw.groupBy("source_path").agg(F.count(F.lit(1)).alias("linhas_lidas"), F.max("_ok").alias("_ok"),
                                          F.count_if(F.col("tipo") == "curta").alias("linhas_curtas"),
                                          F.count_if(F.col("tipo") == "longa").alias("linhas_longas"))
    if cases is not None:
        kept = cases.groupBy("source_path").agg(
            F.count(F.lit(1)).alias("linhas_filtradas"),
            F.sum(TARGET).cast("long").alias("resolvidas"),
            F.count_if(F.col(TARGET) == 0).alias("nao_resolvidas"),
            F.min(CLOSE_YEAR).alias("ano_min"), F.max(CLOSE_YEAR).alias("ano_max"))
        stats = read.join(kept, "source_path", "left")
    else:
        stats = read.select("*", *[F.lit(None).cast(t).alias(c) for c, t in
                                   [("linhas_filtradas", "long"), ("resolvidas", "long"), ("nao_resolvidas", "long"),
                                    ("ano_min", "int"), ("ano_max", "int")]])
    prof = profile.select(F.col("path").alias("source_path"), F.col("arquivo").alias("source_file"), "encoding",
                          F.when(F.col("sep") == "\t", F.lit("'\\t'")).otherwise(F.concat(F.lit("'"), "sep", F.lit("'"))).alias("sep"),
                          "skiprows", "erro")
    j = prof.join(stats, "source_path", "left")
    status = (F.when(F.col("erro").isNotNull(), F.lit("erro"))
               .when(~F.coalesce(F.col("_ok"), F.lit(False)), F.lit("ignorado_colunas_faltando"))
               .when(F.coalesce(F.col("linhas_filtradas"), F.lit(0)) == 0, F.lit("sem_dados_filtrados"))
               .otherwise(F.lit("ok")))
    catalog = j.select(
        F.col("source_file").alias("arquivo"), status.alias("status"),
        F.col("linhas_lidas").cast("long"),
        F.when(F.col("erro").isNull(), F.coalesce("linhas_filtradas", F.lit(0))).cast("long").alias("linhas_filtradas"),
        F.col("resolvidas").cast("long"), F.col("nao_resolvidas").cast("long"),
        F.col("ano_min").cast("int"), F.col("ano_max").cast("int"),
        "encoding", "sep", F.col("skiprows").cast("int"), "linhas_curtas", "linhas_longas", "erro")
    if cases is None:
        from ..operators.clean import clean_schema
        cases = spark.createDataFrame([], clean_schema({"source_file": T.StringType(), "source_path": T.StringType(), "case_id": T.LongType()}))
    malformed = raw.filter(F.col("tipo").isNotNull()).select("source_path", "source_file", "tipo", "linha")
    return IngestResult(cases.drop("source_path"), catalog, profile, malformed)


def write_parts(cases: DataFrame, out: str) -> None:
    """Part sink: Parquet partitioned by close year (source file kept as a column),
    distributed by (year, hash salt) so files stay large and few."""
    from .base import write_by_year
    write_by_year(cases, out, ["source_file", "data_finalizacao", "uf", "grupo_problema"])


def read_result_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Result-table reader: UTF-8, falling back to latin1 when any line of the
    file(s) is not valid UTF-8 (checked over the whole text, on executors);
    a missing path gives an empty DataFrame (with `schema` if given)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema or T.StructType([]))
    lines = spark.read.text(path)
    bad = lines.filter(~F.is_valid_utf8("value")).limit(1).count() > 0
    r = spark.read.option("header", True).option("encoding", "ISO-8859-1" if bad else "UTF-8")
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)
