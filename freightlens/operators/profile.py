"""Dataset profile as flat DataFrames (one per report part)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EXTREME_DELAY_HOURS
from ..functions.columns import hours_between
from .quantiles import exact_quantiles

DESCRIBE_COLUMNS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]


def describe_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """count / mean / sample std / min / quartiles (linear) / max for several
    columns; one output row per column.  Moments come from one aggregate;
    the quartiles from one distributed sort of the unpivoted values."""
    long = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns
        ])).alias("m")
    ).select("m.metric", "m.v")
    moments = long.groupBy("metric").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    quart = exact_quantiles(long, "v", [0.25, 0.5, 0.75], ["metric"], ["p25", "p50", "p75"])
    return moments.join(quart, "metric", "left").select("metric", *DESCRIBE_COLUMNS)


def pings_per_booking(df: DataFrame) -> DataFrame:
    return df.where(F.col("booking_id").isNotNull()).groupBy("booking_id").agg(F.count(F.lit(1)).alias("pings"))


def profile_counts(df: DataFrame) -> DataFrame:
    """Rows, unique bookings, tracking mode, booking date range."""
    base = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("booking_id").alias("unique_bookings"),
        F.date_format(F.min("booking_date"), "yyyy-MM-dd HH:mm:ss").alias("booking_min"),
        F.date_format(F.max("booking_date"), "yyyy-MM-dd HH:mm:ss").alias("booking_max"),
    )
    med = exact_quantiles(pings_per_booking(df), "pings", [0.5], names=["median_pings_per_booking"])
    out = base.join(F.broadcast(med), F.lit(True), "left")  # one row with at most one: no bookings give a NULL median
    return out.withColumn(
        "gps_tracking_mode",
        F.when(F.col("median_pings_per_booking") <= 1.5, "snapshot").otherwise("multi_ping_trajectory"),
    )


def profile_schema(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns in order with their type and how many rows have a value, from one pass over the rows."""
    columns = columns or [c for c in df.columns if not c.startswith("_")]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("dtype"), F.col(c).alias("non_null"))
                     for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def profile_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing % per column (2 dp) in one pass, then unpivoted."""
    columns = columns or [c for c in df.columns if not c.startswith("_")]
    wide = df.agg(
        *[(F.avg(F.col(c).isNull().cast("double")) * 100.0).alias(c) for c in columns]
    )
    return wide.unpivot([], columns, "column_name", "missing_pct").withColumn(
        "missing_pct", F.round(F.col("missing_pct") + F.lit(1e-9), 2)
    )


def profile_pings(df: DataFrame) -> DataFrame:
    """Describe of pings per booking."""
    return describe_long(pings_per_booking(df), ["pings"]).drop("metric")


def profile_flag_dist(df: DataFrame) -> DataFrame:
    """Raw on-time flag distribution, NULL counted."""
    return df.groupBy("ontime_flag").agg(F.count(F.lit(1)).alias("rows"))


def profile_shipment_types(df: DataFrame) -> DataFrame:
    """Shipment type distribution, NULL dropped."""
    return df.where(F.col("shipment_type").isNotNull()).groupBy("shipment_type").agg(
        F.count(F.lit(1)).alias("rows")
    )


def profile_entities(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct suppliers, customers, drivers, vehicles, materials, routes
    (routes are origin/destination pairs with both ends present)."""
    cd = (lambda *c: F.approx_count_distinct(F.concat_ws("\u0001", *c))) if approx else F.countDistinct
    return df.agg(
        cd("supplier_name").alias("suppliers"),
        cd("customer_name").alias("customers"),
        cd("driver_name").alias("drivers"),
        cd("vehicle_registration").alias("vehicles"),
        cd("material_shipped").alias("materials"),
        cd("origin_location", "destination_location").alias("routes"),
    )


def lifecycle_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "booking_to_trip_start_h": hours_between("trip_start", "booking_date"),
            "trip_duration_days": hours_between("trip_end", "trip_start") / 24.0,
            "planned_vs_actual_delay_h": hours_between("actual_eta", "planned_eta"),
        }
    )


LIFECYCLE = ["booking_to_trip_start_h", "trip_duration_days", "planned_vs_actual_delay_h"]


def profile_lifecycle(df: DataFrame) -> DataFrame:
    """P10: describe of the three lifecycle measures."""
    return describe_long(lifecycle_columns(df), LIFECYCLE)


LOW_FREQUENCY_FLAG = "low_frequency_gps: enterprise real-time engine required for trajectory analytics"


def profile_flags(df: DataFrame) -> DataFrame:
    """Data-quality flags that fire (one row per flag)."""
    lc = lifecycle_columns(df)
    stats = lc.agg(
        F.min("trip_duration_days").alias("min_trip"),
        F.max(F.abs("planned_vs_actual_delay_h")).alias("max_abs_delay"),
        F.avg(F.col("vehicle_type").isNull().cast("double")).alias("vt_missing"),
        F.avg(F.col("distance_km").isNull().cast("double")).alias("dist_missing"),
        F.count_if(F.col("booking_to_trip_start_h") < -24).alias("bad_wait"),
    ).crossJoin(F.broadcast(pings_per_booking(df).agg(F.max("pings").alias("max_pings"))))
    flags = F.array(
        F.when(F.col("min_trip") < 0, F.lit("negative_trip_duration")),
        F.when(F.col("max_abs_delay") > EXTREME_DELAY_HOURS, F.lit("extreme_delay_outliers")),
        F.when(F.col("vt_missing") > 0.15, F.lit("high_vehicle_type_missing")),
        F.when(F.col("dist_missing") > 0.05, F.lit("missing_distance")),
        F.when(F.col("max_pings") <= 3, F.lit(LOW_FREQUENCY_FLAG)),
        F.when(F.col("bad_wait") > 0, F.lit("booking_after_trip_start_anomalies")),
    )
    return stats.select(F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("flag"))


LEAD_TIME_PARTS = ["wait_hours", "moving_hours", "unloading_hours", "idle_days_proxy", "delay_hours"]


def lead_time_describe(enriched: DataFrame) -> DataFrame:
    """Describe of the lead-time parts and the delay."""
    return describe_long(enriched, LEAD_TIME_PARTS)


def multi_ping_bookings(df: DataFrame) -> DataFrame:
    """Raw rows of bookings that have more than one row.

    Aggregate + left-semi join rather than a window count, so a hot booking
    is combined map-side and AQE can split it in the join."""
    multi = pings_per_booking(df).where(F.col("pings") > 1).select("booking_id")
    return df.join(multi, "booking_id", "left_semi")
