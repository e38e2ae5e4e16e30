"""Ordered per-key helpers that stay skew-safe.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task.
These helpers window within (key, time bucket) instead and stitch buckets
together through a small per-bucket table (one row per key and bucket),
so a key holding a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_false

_LAST_BUCKET = 9_223_372_036_854_775_807  # rows with a NULL time sort last


def with_bucket(df: DataFrame, ts: str, bucket_hours: int = 24) -> DataFrame:
    width = bucket_hours * 3_600_000_000
    us = F.unix_micros(F.col(ts))
    return df.withColumn("_bkt", F.coalesce(us - F.pmod(us, F.lit(width)), F.lit(_LAST_BUCKET)))


def _order(ts: str, tie: str) -> list[Column]:
    return [F.col(ts).asc_nulls_last(), F.col(tie).asc_nulls_last()]


def lag_by_key(df: DataFrame, key: str, ts: str, tie: str, cols: Sequence[str],
               prefix: str = "prev_", bucket_hours: int = 24, keep_bucket: bool = False) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` on the previous row of the same key
    (ordered by ts, NULL times last, then tie).  NULL keys get NULL.  With
    ``keep_bucket`` the rows keep ``_bkt``, by which they are already dealt out."""
    b = with_bucket(df, ts, bucket_hours)
    w = Window.partitionBy(key, "_bkt").orderBy(*_order(ts, tie))
    b = b.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in cols}).withColumn(
        "_first", F.lag(F.lit(1)).over(w).isNull()
    )
    last = b.groupBy(key, "_bkt").agg(
        F.max_by(F.struct(*[F.col(c).alias(c) for c in cols]), F.struct(F.col(ts), F.col(tie))).alias("_last")
    )
    wb = Window.partitionBy(key).orderBy("_bkt")
    carry = last.select(key, "_bkt", F.lag("_last").over(wb).alias("_carry"))
    j = b.join(carry, [key, "_bkt"], "left")
    fixed = {
        f"{prefix}{c}": F.when(F.col(key).isNull(), F.lit(None))
        .when(F.col("_first"), F.col(f"_carry.{c}"))
        .otherwise(F.col(f"{prefix}{c}"))
        for c in cols
    }
    return j.withColumns(fixed).drop("_first", "_carry", *([] if keep_bucket else ["_bkt"]))


def running_count_by_key(df: DataFrame, key: str, ts: str, tie: str, out: str,
                         flag: Column | None = None, bucket_hours: int = 24) -> DataFrame:
    """``out`` = running count (or running sum of int ``flag``) per key in
    (ts, tie) order, including the current row."""
    val = F.lit(1).cast("bigint") if flag is None else flag.cast("bigint")
    b = with_bucket(df.withColumn("_v", val), ts, bucket_hours)
    w = Window.partitionBy(key, "_bkt").orderBy(*_order(ts, tie)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    b = b.withColumn("_within", F.sum("_v").over(w))
    totals = b.groupBy(key, "_bkt").agg(F.sum("_v").alias("_tot"))
    wb = Window.partitionBy(key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_bkt", F.coalesce(F.sum("_tot").over(wb), F.lit(0)).alias("_off"))
    j = b.join(offsets, [key, "_bkt"], "left")
    return j.withColumn(out, F.col("_within") + F.coalesce(F.col("_off"), F.lit(0))).drop(
        "_v", "_bkt", "_within", "_off"
    )


def runs_by_key(df: DataFrame, key: str, ts: str, tie: str, flag: Column, measures: dict[str, tuple[str, Column]], out: str,
                bucket_hours: int = 24) -> DataFrame:
    """Runs of consecutive rows of a key where ``flag`` holds, numbered from 1 in ``out``.

    ``measures`` names aggregates of a run's rows by column: ``min``, ``max`` or ``sum`` of an expression, as
    ``{"name": ("sum", expr)}``.  Each bucket is summed up in one window pass as its runs in
    order, whether it begins and whether it ends inside one.  Two neighbouring summaries compose: the
    last run of one and the first of the next are the same if both touch.  So one pass over the summaries
    numbers the runs, and pieces of equal number are aggregated once more.  ``df`` may carry ``_bkt``.
    """
    b = df if "_bkt" in df.columns else with_bucket(df, ts, bucket_hours)
    w = Window.partitionBy(key, "_bkt").orderBy(*_order(ts, tie)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agg = {"min": F.min, "max": F.max, "sum": F.sum}
    # Rows after the k-th row outside a run, up to the next one, are piece k; piece 0 touches the bucket's beginning.
    b = b.where(F.col(key).isNotNull()).withColumn("_on", flag).withColumn("_piece", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w))
    pieces = b.groupBy(key, "_bkt", "_piece").agg(
        F.count_if("_on").alias("_rows"), *[agg[how](F.when(F.col("_on"), e)).alias(n) for n, (how, e) in measures.items()]
    )
    piece = F.struct("_piece", *measures)
    summary = pieces.groupBy(key, "_bkt").agg(
        F.sort_array(F.collect_list(F.when(F.col("_rows") > 0, piece))).alias("_runs"),
        (F.max_by("_rows", "_piece") > 0).alias("_ends"), (F.max(F.when(F.col("_piece") == 0, F.col("_rows"))) > 0).alias("_begins"),
    )
    by_bucket = Window.partitionBy(key).orderBy("_bkt")
    joins = null_false(F.col("_begins") & F.lag("_ends").over(by_bucket))
    summary = summary.withColumn("_joined", F.when(joins, 1).otherwise(0))
    before = F.sum(F.size("_runs") - F.col("_joined")).over(by_bucket.rowsBetween(Window.unboundedPreceding, -1))
    # The count comes first: in one select with the explode it would be over the exploded rows.
    summary = summary.withColumn("_before", F.coalesce(before, F.lit(0)))
    runs = summary.select(key, "_joined", "_before", F.posexplode("_runs").alias("_i", "_r"))
    runs = runs.select(key, (F.col("_before") + F.col("_i") + 1 - F.col("_joined")).cast("bigint").alias(out), *[F.col("_r")[n].alias(n) for n in measures])
    return runs.groupBy(key, out).agg(*[agg[how](n).alias(n) for n, (how, _) in measures.items()])
