"""KPI and segment tables over the enriched shipment frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import r
from .quantiles import exact_quantiles


def pct(rate: Column, n: int = 2) -> Column:
    """rate x 100 rounded to n decimals (tie-safe rounding)."""
    return r(rate * 100.0, n)


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def percentile(col: str, q: float, exact: bool = True) -> Column:
    """Inline percentile aggregate.  The exact form buffers every distinct
    value of a group in one task, so tables use ``exact_quantiles`` (a
    distributed sort) for exact answers and this only for approximations."""
    if exact:
        return F.percentile(F.col(col), F.lit(q))
    return F.percentile_approx(F.col(col), F.lit(q), F.lit(10000))


EXECUTIVE_COLUMNS = "total_bookings ontime_bookings ontime_rate_pct avg_trip_days avg_distance_km avg_delay_hours avg_wait_hours".split()


def executive_aggs(approx_distinct: bool = False) -> list[Column]:
    """A1 as aggregates over all rows; rows without a booking id don't count."""
    distinct = F.approx_count_distinct("booking_id") if approx_distinct else F.countDistinct("booking_id")
    of = lambda c: F.when(F.col("booking_id").isNotNull(), F.col(c))
    return [
        distinct.cast("bigint").alias("total_bookings"),
        F.coalesce(F.sum(of("is_ontime")), F.lit(0)).cast("bigint").alias("ontime_bookings"),
        pct(F.avg(of("is_ontime"))).alias("ontime_rate_pct"),
        *[r(F.avg(of(c)), 2).alias(f"avg_{c}") for c in ("trip_days", "distance_km", "delay_hours", "wait_hours")],
    ]


def executive_kpis(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """A1: one-row KPI table over rows having a booking id."""
    return df.agg(*executive_aggs(approx_distinct))


SEGMENT_MEASURES = (
    "total_bookings ontime_bookings ontime_rate avg_trip_days avg_delay_hours avg_distance_km "
    "avg_wait_hours avg_speed_kmph avg_idle_days ontime_rate_pct"
).split()


def segment_aggs() -> list[Column]:
    return [
        F.count("booking_id").alias("total_bookings"),
        F.coalesce(F.sum("is_ontime"), F.lit(0)).cast("bigint").alias("ontime_bookings"),
        F.avg("is_ontime").alias("ontime_rate"),
        F.avg("trip_days").alias("avg_trip_days"),
        F.avg("delay_hours").alias("avg_delay_hours"),
        F.avg("distance_km").alias("avg_distance_km"),
        F.avg("wait_hours").alias("avg_wait_hours"),
        F.avg("avg_speed_kmph").alias("avg_speed_kmph"),
        F.avg("idle_days_proxy").alias("avg_idle_days"),
    ]


def segment_performance(df: DataFrame, keys, min_bookings: int = 10) -> DataFrame:
    """A2: segment KPI table; NULL groups kept; HAVING total >= min."""
    ks = _keys(keys)
    return (
        df.groupBy(*ks)
        .agg(*segment_aggs())
        .withColumn("ontime_rate_pct", pct(F.col("ontime_rate")))
        .where(F.col("total_bookings") >= min_bookings)
        .orderBy(F.col("total_bookings").desc(), *[F.col(k).asc_nulls_last() for k in ks])
    )


def supplier_overall(df: DataFrame, min_n: int = 15) -> DataFrame:
    """A3."""
    return segment_performance(df, "supplier_name", min_n)


def supplier_segmented(df: DataFrame, min_n: int = 5) -> DataFrame:
    """A4: supplier x band x vehicle, NULL keys kept, >= min_n bookings."""
    keys = ["supplier_name", "distance_band", "vehicle_type"]
    return (
        df.groupBy(*keys)
        .agg(
            F.count("booking_id").alias("bookings"),
            F.avg("is_ontime").alias("ontime_rate"),
            F.avg("delay_hours").alias("avg_delay_h"),
            F.avg("trip_days").alias("avg_trip_days"),
        )
        .where(F.col("bookings") >= min_n)
        .withColumn("ontime_rate_pct", pct(F.col("ontime_rate")))
    )


def route_kpis(df: DataFrame, min_bookings: int = 5) -> DataFrame:
    """A5."""
    return segment_performance(df, "route_id", min_bookings)


def priority_routes(df: DataFrame, min_bookings: int = 10, delay_h: float = 48.0,
                    volume: int = 20, n: int = 15) -> DataFrame:
    """High-delay, high-volume routes, first n by volume."""
    return (
        route_kpis(df, min_bookings)
        .where((F.col("avg_delay_hours") > delay_h) & (F.col("total_bookings") >= volume))
        .orderBy(F.col("total_bookings").desc(), F.col("route_id"))
        .limit(n)
    )


def customer_scorecard(df: DataFrame, min_bookings: int = 20) -> DataFrame:
    """A7."""
    return segment_performance(df, "customer_name", min_bookings)


def _with_group_quantiles(df: DataFrame, aggs: DataFrame, key: str, value: str, qs, names,
                          exact: bool) -> DataFrame:
    """Attach per-group quantiles: exact ones from the distributed sort
    (bounded memory per task), or approximate sketches on request."""
    if exact:
        q = exact_quantiles(df, value, qs, [key], names)
        return aggs.join(q, key, "left")
    extra = df.groupBy(key).agg(*[percentile(value, qv, False).alias(nm) for qv, nm in zip(qs, names)])
    return aggs.join(extra, key, "left")


def material_lead_time(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per material group volume, median / p90 trip days, on-time, delay."""
    rows = df.where(F.col("material_group").isNotNull())
    aggs = rows.groupBy("material_group").agg(
        F.count("booking_id").alias("bookings"),
        F.avg("is_ontime").alias("ontime_rate"),
        F.avg("delay_hours").alias("avg_delay_h"),
    )
    out = _with_group_quantiles(rows, aggs, "material_group", "trip_days", [0.5, 0.9],
                                ["median_trip_days", "p90_trip_days"], exact)
    return out.select("material_group", "bookings", "median_trip_days", "p90_trip_days", "ontime_rate",
                      "avg_delay_h").orderBy(F.col("bookings").desc(), F.col("material_group"))


def delay_patterns(df: DataFrame) -> DataFrame:
    """Monthly delay pattern, sorted by month."""
    return (
        df.where(F.col("booking_month").isNotNull())
        .groupBy("booking_month")
        .agg(
            F.count("booking_id").alias("bookings"),
            F.avg("is_late").alias("late_rate"),
            F.avg("delay_hours").alias("avg_delay_h"),
            F.avg("wait_hours").alias("avg_wait_h"),
            F.avg("idle_days_proxy").alias("avg_idle_days"),
        )
        .withColumn("late_rate_pct", pct(F.col("late_rate")))
        .orderBy("booking_month")
    )


def fleet_utilization(df: DataFrame, exact: bool = True) -> DataFrame:
    """A10: per vehicle type (NULL dropped)."""
    rows = df.where(F.col("vehicle_type").isNotNull())
    aggs = rows.groupBy("vehicle_type").agg(
        F.count("booking_id").alias("trips"),
        F.avg("km_per_day").alias("avg_km_per_day"),
        F.avg("is_ontime").alias("ontime_rate"),
    )
    out = _with_group_quantiles(rows, aggs, "vehicle_type", "trip_days", [0.5], ["median_trip_days"], exact)
    return out.select("vehicle_type", "trips", "avg_km_per_day", "median_trip_days", "ontime_rate").orderBy(
        F.col("trips").desc(), F.col("vehicle_type")
    )


def driver_scorecard(df: DataFrame, min_trips: int = 10) -> DataFrame:
    """A11."""
    return segment_performance(df, "driver_name", min_trips)


def vehicle_band_segments(df: DataFrame, min_bookings: int = 5) -> DataFrame:
    """A12."""
    return segment_performance(df, ["vehicle_type", "distance_band"], min_bookings)


def origin_map(df: DataFrame) -> DataFrame:
    """Bookings and on-time % per origin point (rows with a NULL key dropped)."""
    keys = ["origin_location", "origin_lat", "origin_lon"]
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return (
        df.where(cond)
        .groupBy(*keys)
        .agg(F.count("booking_id").alias("bookings"), F.avg("is_ontime").alias("ontime_rate"))
        .withColumn("ontime_rate_pct", F.col("ontime_rate") * 100.0)
    )


def bookings_trend(df: DataFrame) -> DataFrame:
    """A15."""
    return (
        df.where(F.col("booking_month").isNotNull())
        .groupBy("booking_month")
        .agg(F.count("booking_id").alias("bookings"))
        .orderBy("booking_month")
    )


def top_suppliers(df: DataFrame, n: int = 12, min_n: int = 15) -> DataFrame:
    """First n suppliers of the scorecard by volume."""
    return supplier_overall(df, min_n).limit(n)


SLICER_DIMENSIONS = (
    "customer_name", "supplier_name", "driver_name", "vehicle_type", "material_group", "shipment_type",
)


def slicer(df: DataFrame, dims: Sequence[str] = SLICER_DIMENSIONS, min_bookings: int = 1) -> DataFrame:
    """The A2 measures for several dimensions in one GROUPING SETS pass.

    Output: (dimension, value, measures...).  One scan, one shuffle, instead
    of one job per dimension."""
    dims = list(dims)
    g = df.groupingSets([[d] for d in dims], *dims).agg(
        *segment_aggs(), F.grouping_id().alias("_gid")
    )
    n = len(dims)
    dim_expr = F.lit(None).cast("string")
    val_expr = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        dim_expr = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(dim_expr)
        val_expr = F.when(F.col("_gid") == gid, F.col(d).cast("string")).otherwise(val_expr)
    return (
        g.withColumn("dimension", dim_expr)
        .withColumn("value", val_expr)
        .withColumn("ontime_rate_pct", pct(F.col("ontime_rate")))
        .where(F.col("total_bookings") >= min_bookings)
        .select("dimension", "value", *SEGMENT_MEASURES)
    )


def shipment_status() -> Column:
    """Where a booking stands: ``delivered`` once its trip has ended, ``in_transit`` once it has begun, else ``planned``."""
    return F.when(F.col("trip_end").isNotNull(), "delivered").when(F.col("trip_start").isNotNull(), "in_transit").otherwise("planned")


def kpis_filtered(df: DataFrame, date_from: str | None = None, date_to: str | None = None,
                  customer: str | None = None, supplier: str | None = None,
                  shipment_type: str | None = None, status: str | None = None) -> DataFrame:
    """A1 scoped by booking date range / customer / supplier / type / status."""
    cond = F.lit(True)
    if date_from:
        cond = cond & (F.col("booking_date") >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        cond = cond & (F.col("booking_date") < F.to_timestamp(F.lit(date_to)))
    if customer:
        cond = cond & (F.col("customer_name") == customer)
    if supplier:
        cond = cond & (F.col("supplier_name") == supplier)
    if shipment_type:
        cond = cond & (F.col("shipment_type") == shipment_type)
    if status:
        cond = cond & (shipment_status() == status)
    return executive_kpis(df.where(cond))


def supplier_score(df: DataFrame, min_n: int = 15, cost_col: str | None = None) -> DataFrame:
    """Weighted supplier score in [0, 100].

    50 % on-time, 25 % delay severity (lower is better), 20 % cost per km
    (only when a cost column exists; weights renormalised otherwise), 5 %
    route handling (distinct routes served).  Each term is min-max
    normalised against one global aggregate row (no single-task window)."""
    aggs = [
        F.count("booking_id").alias("total_bookings"),
        F.avg("is_ontime").alias("ontime_rate"),
        F.avg("delay_hours").alias("avg_delay_hours"),
        F.countDistinct("route_id").alias("routes_served"),
    ]
    if cost_col:
        aggs.append((F.sum(cost_col) / F.sum("distance_km")).alias("cost_per_km"))
    s = (
        df.where(F.col("supplier_name").isNotNull())
        .groupBy("supplier_name")
        .agg(*aggs)
        .where(F.col("total_bookings") >= min_n)
    )
    terms = [("ontime_rate", 0.50, False), ("avg_delay_hours", 0.25, True), ("routes_served", 0.05, False)]
    if cost_col:
        terms.append(("cost_per_km", 0.20, True))
    total_w = sum(w for _, w, _ in terms)
    bounds = s.agg(*[F.min(c).alias(f"_min_{c}") for c, _, _ in terms],
                   *[F.max(c).alias(f"_max_{c}") for c, _, _ in terms])
    s = s.crossJoin(F.broadcast(bounds))  # one-row aggregate
    score = F.lit(0.0)
    for c, w, lower_better in terms:
        lo, hi = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        norm = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(1.0))
        if lower_better:
            norm = 1.0 - norm
        score = score + F.coalesce(norm, F.lit(0.0)) * (w / total_w)
    keep = [c for c in s.columns if not c.startswith("_")]
    return s.withColumn("supplier_score", score * 100.0).select(*keep, "supplier_score")


def rolling_kpis(df: DataFrame) -> DataFrame:
    """Weekly bookings with an 8-week trailing average and a 4-week
    rolling on-time rate (weeks start Monday; missing weeks count as 0).

    The window runs over the weekly table (one row per week), not rows."""
    weekly = (
        df.where(F.col("booking_date").isNotNull() & F.col("booking_id").isNotNull())
        .withColumn("week_start", F.to_date(F.date_trunc("week", F.col("booking_date"))))
        .groupBy("week_start")
        .agg(F.count(F.lit(1)).alias("bookings"), F.sum("is_ontime").cast("bigint").alias("ontime"))
        .withColumn("_wk", F.floor(F.unix_date("week_start") / 7))
    )
    w8 = Window.orderBy("_wk").rangeBetween(-7, 0)
    w4 = Window.orderBy("_wk").rangeBetween(-3, 0)
    return weekly.select(
        F.date_format("week_start", "yyyy-MM-dd").alias("week_start"),
        "bookings",
        "ontime",
        (F.sum("bookings").over(w8) / 8.0).alias("bookings_8w_avg"),
        (F.sum("ontime").over(w4) * 100.0 / F.sum("bookings").over(w4)).alias("ontime_4w_pct"),
    )
