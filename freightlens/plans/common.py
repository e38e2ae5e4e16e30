"""Output helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import r


def rounded(df: DataFrame, n: int = 4) -> DataFrame:
    """Round every double column with the report rule (round(x + 1e-9, n))."""
    changes = {f.name: r(F.col(f.name), n) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(changes) if changes else df


def ts_text(col: str):
    """Timestamps leave the engine as 'yyyy-MM-dd HH:mm:ss' text."""
    return F.date_format(F.col(col), "yyyy-MM-dd HH:mm:ss").alias(col)
