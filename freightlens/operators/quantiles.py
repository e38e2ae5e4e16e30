"""Exact quantiles without a single-task buffer.

Spark's ``percentile`` merges a map of every distinct value into one final
task per group, which is unbounded for continuous values or a hot group.
Here equal values are counted first (map-side combine), so a value that most
rows share is one row.  Distinct values are put in buckets by split points
fixed once as literals, bucket counts give the ranks at which each bucket
starts, and only buckets that hold a wanted rank (floor / ceil of q (n - 1))
are ranked inside.  The same answer as ``percentile`` / ``quantile_cont``,
whether or not Spark reuses an exchange: the bucket depends on the value alone.
Where all groups together have few distinct values, these are small enough for
``percentile`` over values and counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of (group, value, count) up to which one task may hold a group's: some tens of MB.
FEW_VALUES = 200_000


def _join_ns(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner join on ``cols`` treating NULL = NULL (group keys may be NULL)."""
    ren = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = None
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = e if cond is None else cond & e
    return left.join(ren, cond, "inner").drop(*[f"_r_{c}" for c in cols])


def _buckets(values: DataFrame, count: int) -> DataFrame:
    """``values`` with ``_b``, an order-preserving bucket of ``_x``.  At most ``count - 1``
    split points go through the driver."""
    probs = [i / count for i in range(1, count)]
    got = values.select(F.percentile_approx("_x", probs, 10_000)).first()[0] or []
    splits = sorted({x for x in got if x == x and abs(x) != float("inf")})
    if not splits:
        return values.withColumn("_b", F.lit(0.0))
    cut = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_x", outputCol="_b", handleInvalid="keep")
    return cut.transform(values)


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], groups: Sequence[str] = (),
                    names: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """One row per group with one column per quantile (NULL values ignored;
    a group without values is absent)."""
    count = max(2, partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = list(names or [f"q{i}" for i in range(len(qs))])
    g = list(groups)
    v = df.where(F.col(value).isNotNull()).select(*g, F.col(value).cast("double").alias("_x"))
    key = g
    if not g:
        v, key = v.withColumn("_g", F.lit(0)), ["_g"]
    # The counts are written once: split points, blocks and ranks all read that table.
    counts = materialize(v.groupBy(*key, "_x").agg(F.count(F.lit(1)).alias("_c")), "value-counts")
    if counts.count() <= FEW_VALUES:
        got = counts.groupBy(*key).agg(F.percentile("_x", F.array(*[F.lit(float(q)) for q in qs]), F.col("_c")).alias("_q"))
        return got.select(*g, *[F.get("_q", F.lit(i)).alias(nm) for i, nm in enumerate(names)])
    vc = _buckets(counts, count)
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = vc.groupBy(*key, "_b").agg(F.sum("_c").alias("_cnt")).select(
        *key, "_b", "_cnt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(*key)).alias("_n"),
    )
    # wanted ranks, each in the bucket that holds it
    want = blocks.select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("_q"))
    want = want.withColumn("_h", F.col("_q") * (F.col("_n") - 1))
    want = want.select("*", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))).alias("_rank")).where(
        (F.col("_rank") >= F.col("_off")) & (F.col("_rank") < F.col("_off") + F.col("_cnt"))
    )
    hot = want.groupBy(*key, "_b", "_off").agg(F.collect_list(F.struct("_q", "_h", "_rank")).alias("_want"))
    inside = Window.partitionBy(*key, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _join_ns(vc, hot, [*key, "_b"]).withColumn("_to", F.col("_off") + F.sum("_c").over(inside))
    picked = ranked.select(*key, "_x", "_c", "_to", F.inline("_want")).where(
        (F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_c"))
    )
    per_q = picked.groupBy(*key, "_q").agg(
        F.min_by("_x", "_rank").alias("_xlo"), F.max_by("_x", "_rank").alias("_xhi"), F.first("_h").alias("_h")
    )
    val = F.col("_xlo") + (F.col("_h") - F.floor("_h")) * (F.col("_xhi") - F.col("_xlo"))
    out = per_q.groupBy(*key).pivot("_q", [float(q) for q in qs]).agg(F.first(val))
    out = out.select(*[F.col(c) for c in key], *[F.col(f"`{float(q)}`").alias(nm) for q, nm in zip(qs, names)])
    return out.drop("_g") if not g else out
