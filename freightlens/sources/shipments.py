"""Scan the shipment sheet, rename to canonical names, coerce types.

The sheet arrives as text (CSV export or a Parquet copy of it).  The schema
is declared, never inferred; bad timestamp / number text becomes NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    COLUMN_MAP,
    DICTIONARY_SCHEMA,
    DOUBLE_COLUMNS,
    RAW_SHIPMENT_SCHEMA,
    TIMESTAMP_COLUMNS,
)


def _read_sheet(spark: SparkSession, path: str, schema: T.StructType, fmt: str, options: dict) -> DataFrame:
    """All-text columns by header name: declared ones that are missing are NULL, extra ones follow."""
    reader = spark.read.format(fmt).options(**options)
    if fmt != "csv":
        return reader.load(path)
    sheet = reader.option("header", "true").option("inferSchema", "false").load(path)
    known = [F.col(f"`{f.name}`") if f.name in sheet.columns else F.lit(None).cast("string").alias(f.name) for f in schema]
    return sheet.select(*known, *[F.col(f"`{c}`") for c in sheet.columns if c not in schema.names])


def read_shipments(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Scan the primary sheet; columns go by their header."""
    return _read_sheet(spark, path, RAW_SHIPMENT_SCHEMA, fmt, options)


def read_dictionary(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """Scan the data dictionary sheet (field, description)."""
    return _read_sheet(spark, path, DICTIONARY_SCHEMA, fmt, options)


def canonical_names(df: DataFrame) -> DataFrame:
    """S3: rename source headers; unmapped columns are kept, missing ones ignored."""
    present = {src: dst for src, dst in COLUMN_MAP.items() if src in df.columns}
    return df.withColumnsRenamed(present) if present else df


def _to_timestamp(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampType):
        return col
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return col.cast("timestamp")
    return col.cast("string").try_cast("timestamp")


def _to_double(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NumericType):
        x = col.cast("double")
    else:
        x = F.trim(col.cast("string")).try_cast("double")
    # missing is NULL: not-a-number and infinite texts are no measurements
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def coerce_types(df: DataFrame) -> DataFrame:
    """Timestamps and numbers from text; unparseable values -> NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    changes = {}
    for c in TIMESTAMP_COLUMNS:
        if c in types:
            changes[c] = _to_timestamp(F.col(c), types[c])
    for c in DOUBLE_COLUMNS:
        if c in types:
            changes[c] = _to_double(F.col(c), types[c])
    return df.withColumns(changes) if changes else df


def load_shipments(raw: DataFrame) -> DataFrame:
    """S3+S4+S5 in one projection."""
    return coerce_types(canonical_names(raw))
