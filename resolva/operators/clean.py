"""Cleaning: finalized-and-evaluated filter, target, close date, text fill.

One narrow projection + filter; no shuffle. The filter runs on normalized
status text, so it is evaluated per row inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import month_of, parse_mixed_date, year_of
from ..functions.text import normalize_value, trim_or_sentinel
from ..schema import (CASE_COLUMNS, CLOSE_MONTH, CLOSE_YEAR, EVAL_NOT_RESOLVED,
                      EVAL_RESOLVED, REQUIRED_COLUMNS, STATUS_FINALIZED_EVALUATED, TARGET)


def missing_required(columns: list[str]) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in columns]


def finalized_evaluated(df: DataFrame) -> DataFrame:
    """Keep rows whose status is 'finalizada avaliada' and whose evaluation is
    'resolvida' / 'não resolvida' (spelling, case, accents and spaces ignored)."""
    ev = normalize_value(F.col("avaliacao_reclamacao"))
    return df.filter((normalize_value(F.col("situacao")) == STATUS_FINALIZED_EVALUATED)
                     & ev.isin(EVAL_RESOLVED, EVAL_NOT_RESOLVED))


def clean_cases(raw: DataFrame, keep: tuple[str, ...] = ("case_id", "source_file")) -> DataFrame:
    """Raw string cases → cleaned cases with a fixed schema.

    Output: `keep` columns present in the input, the 19 case columns (text
    trimmed, NULL → sentinel; a column absent from the source stays NULL),
    `data_finalizacao` as timestamp, close year/month and the 0/1 target.
    """
    absent = missing_required(raw.columns)
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    kept = finalized_evaluated(raw)
    close = parse_mixed_date(F.col("data_finalizacao"))
    cols = [F.col(k) for k in keep if k in raw.columns]
    for c in CASE_COLUMNS:
        if c == "data_finalizacao":
            cols.append(close.alias(c))
        elif c in raw.columns:
            cols.append(trim_or_sentinel(F.col(c).cast("string")).alias(c))
        else:
            cols.append(F.lit(None).cast("string").alias(c))
    cols += [
        year_of(close).alias(CLOSE_YEAR),
        month_of(close).alias(CLOSE_MONTH),
        (normalize_value(F.col("avaliacao_reclamacao")) == EVAL_RESOLVED).cast("int").alias(TARGET),
    ]
    return kept.select(*cols)


def clean_schema(keep: dict[str, T.DataType] | None = None) -> T.StructType:
    """Schema of `clean_cases` output (keep columns first)."""
    keep = keep if keep is not None else {"case_id": T.LongType(), "source_file": T.StringType()}
    fields = [T.StructField(k, t) for k, t in keep.items()]
    for c in CASE_COLUMNS:
        fields.append(T.StructField(c, T.TimestampType() if c == "data_finalizacao" else T.StringType()))
    fields += [T.StructField(CLOSE_YEAR, T.IntegerType()), T.StructField(CLOSE_MONTH, T.IntegerType()),
               T.StructField(TARGET, T.IntegerType())]
    return T.StructType(fields)
