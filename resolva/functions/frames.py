"""Small DataFrame-shape helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_doubles(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column (report / comparison precision)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


#: A lookup table of at most this many narrow rows is broadcast.
LOOKUP_ROWS = 100_000


def as_lookup(table: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """A small aggregate as the lookup side of joins: computed once, and
    broadcast when its counted rows are within `limit`. Beyond that the join
    shuffles, and AQE splits the hot keys of the other side."""
    table = table.checkpoint(eager=True)
    return F.broadcast(table) if table.count() <= limit else table
