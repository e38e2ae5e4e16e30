"""Dense surrogate keys without a single-partition window.

Range-partition by the natural key, sort within partitions, and write each
row's position (``monotonically_increasing_id``: partition id in the upper
bits, row number in the lower 33) once as a table in the shared folder; then
add per-partition offsets from a table with one row per partition.  Equals
``row_number() OVER (ORDER BY key)`` but every step is distributed, and both
readers of the positions see the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _join_ns(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner join on ``cols`` treating NULL = NULL."""
    ren = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = None
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = e if cond is None else cond & e
    return left.join(ren, cond, "inner").drop(*[f"_r_{c}" for c in cols])


def sequential_ids(df: DataFrame, order_cols: Sequence[str], out: str, partitions: int | None = None) -> DataFrame:
    """Dense 1-based ids in ``order_cols`` order (NULLs last).  ``order_cols``
    must be unique per row (a natural key).

    Only the key columns are range-partitioned; the ids (bigint) are joined
    back on the key."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = [F.col(c).asc_nulls_last() for c in order_cols]
    keys = df.select(*order_cols)
    r = keys.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered)
    r = materialize(r.withColumn("_mid", F.monotonically_increasing_id()), "positions")
    r = r.withColumns(
        {"_pid": F.shiftright(F.col("_mid"), 33), "_pos": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_pid",
        F.coalesce(
            F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_off"),
    )
    # One row per partition: a bounded broadcast.
    ids = (
        r.join(F.broadcast(offsets), "_pid")
        .select(*order_cols, (F.col("_off") + F.col("_pos") + 1).cast("bigint").alias(out))
    )
    return _join_ns(df, ids, list(order_cols))
