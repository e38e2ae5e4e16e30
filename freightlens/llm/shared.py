"""Small helpers of the operators: tables in the shared folder, let-bindings, row keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.session import ensure_checkpoint_dir

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE = r"[\x20\x09-\x0D]+"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back.

    This cuts the lineage, survives lost executors, and gives later joins the
    table's real size.  The write's shuffle files are removed when it is done; they are
    of no use once the table is there.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once a row, also inside the body's lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")



#: Rows up to which a one-column table of longs is sent to every task: 8 MB.
SMALL_ROWS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it has at most SMALL_ROWS rows; else it is joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids
