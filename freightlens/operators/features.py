"""Lead-time decomposition, route complexity and segment features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ENTERPRISE_MIN_BOOKINGS, MID_MARKET_MIN_BOOKINGS, ROUTE_ARROW, TOP_MATERIALS
from ..functions.columns import (
    band_ordinal,
    clip0,
    distance_band,
    haversine_km,
    hours_between,
    label_for_ordinal,
    route_category,
)


def lead_time_columns() -> dict:
    """F2-F7."""
    moving = clip0(hours_between("trip_end", "trip_start"))
    delay = hours_between("actual_eta", "planned_eta")
    return {
        "wait_hours": clip0(hours_between("trip_start", "booking_date")),
        "moving_hours": moving,
        "delay_hours": delay,
        "trip_days": moving / 24.0,
        "is_late": F.coalesce(delay > 0, F.lit(False)).cast("int"),
        "unloading_hours": clip0(hours_between("actual_eta", "trip_end")),
    }


def top_materials(df: DataFrame, n: int = TOP_MATERIALS) -> DataFrame:
    """F15 lookup: the n most frequent materials (ties -> name order)."""
    return (
        df.where(F.col("material_shipped").isNotNull())
        .groupBy("material_shipped")
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.col("_n").desc(), F.col("material_shipped"))
        .limit(n)
        .select("material_shipped", F.lit(True).alias("_top_material"))
    )


def supplier_modal_band(df: DataFrame) -> DataFrame:
    """F16 lookup: modal distance band per supplier; ties -> lowest band."""
    return (
        df.where(F.col("supplier_name").isNotNull() & F.col("_band_ord").isNotNull())
        .groupBy("supplier_name")
        .agg(F.mode("_band_ord", deterministic=True).alias("_spec_ord"))
    )


def customer_volume(df: DataFrame) -> DataFrame:
    """F17 lookup: bookings per (non-null) customer."""
    return (
        df.where(F.col("customer_name").isNotNull())
        .groupBy("customer_name")
        .agg(F.count(F.lit(1)).alias("_cust_n"))
    )


def engineer_features(df: DataFrame, materialize=None) -> DataFrame:
    """Append F1-F21 to a cleaned shipment frame (row count unchanged).

    ``materialize(frame, name)`` writes the supplier and customer look-ups first, from the two columns
    each needs.  Their size is then known before the wide rows are joined, so small
    ones are broadcast and the rows stay where they are; large ones are joined by shuffle."""
    written = materialize or (lambda frame, name: frame)
    out = df.withColumns(lead_time_columns())
    geo = haversine_km("origin_lat", "origin_lon", "dest_lat", "dest_lon")
    out = out.withColumns(
        {
            "avg_speed_kmph": F.when(F.col("moving_hours") > 0, F.col("distance_km") / F.col("moving_hours")),
            "km_per_day": F.when(F.col("trip_days") > 0, F.col("distance_km") / F.col("trip_days")),
            "route_id": F.concat(
                F.coalesce(F.col("origin_location"), F.lit("nan")),
                F.lit(ROUTE_ARROW),
                F.coalesce(F.col("destination_location"), F.lit("nan")),
            ),
            "geo_distance_km": geo,
            "_band_ord": band_ordinal("distance_km"),
            "route_category": route_category("distance_km"),
            "booking_month": F.coalesce(F.date_format("booking_date", "yyyy-MM"), F.lit("NaT")),
            "booking_dow": F.date_format("booking_date", "EEEE"),
            "expected_days": F.when(
                (F.col("min_daily_km") > 0) & F.col("distance_km").isNotNull(),
                F.col("distance_km") / F.col("min_daily_km"),
            ),
            "gps_ping_lag_hours": hours_between("gps_ping_time", "trip_start"),
            "gps_position_drift_km": haversine_km("current_lat", "current_lon", "dest_lat", "dest_lon"),
        }
    )
    out = out.withColumns(
        {
            "route_detour_ratio": F.when(
                (F.col("geo_distance_km") > 0) & F.col("distance_km").isNotNull(),
                F.col("distance_km") / F.col("geo_distance_km"),
            ),
            "distance_band": distance_band("distance_km"),
            "idle_days_proxy": clip0(F.col("trip_days") - F.col("expected_days")),
        }
    )
    # at most TOP_MATERIALS rows -> bounded broadcast.
    out = out.join(F.broadcast(top_materials(out)), "material_shipped", "left")
    out = out.join(written(supplier_modal_band(df.withColumn("_band_ord", band_ordinal("distance_km"))), "supplier-band"), "supplier_name", "left")
    out = out.join(written(customer_volume(df), "customer-volume"), "customer_name", "left")
    cust_n = F.coalesce(F.col("_cust_n"), F.lit(0))
    out = out.withColumns(
        {
            "material_group": F.when(F.col("_top_material"), F.col("material_shipped")).otherwise(F.lit("Other")),
            "supplier_specialization": label_for_ordinal("_spec_ord"),
            "customer_tier": F.when(cust_n >= ENTERPRISE_MIN_BOOKINGS, "enterprise")
            .when(cust_n >= MID_MARKET_MIN_BOOKINGS, "mid_market")
            .otherwise("long_tail"),
        }
    )
    return out.drop("_top_material", "_spec_ord", "_cust_n")
