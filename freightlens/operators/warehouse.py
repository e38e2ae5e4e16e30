"""Star schema (5 dimensions, 3 facts) and the supplier view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band_sql, hours_between
from ..session import materialize
from .keys import sequential_ids

DEC = {
    "distance_km": "decimal(10,2)",
    "geo_distance_km": "decimal(10,2)",
    "route_detour_ratio": "decimal(8,4)",
    "wait_hours": "decimal(10,2)",
    "moving_hours": "decimal(10,2)",
    "unloading_hours": "decimal(10,2)",
    "delay_hours": "decimal(10,2)",
    "idle_days_proxy": "decimal(10,2)",
}


def _mode(col: str):
    return F.mode(col, deterministic=True)


def dim_customer(enriched: DataFrame) -> DataFrame:
    d = enriched.where(F.col("customer_name").isNotNull()).groupBy("customer_name").agg(
        _mode("customer_tier").alias("customer_tier")
    )
    return sequential_ids(d, ["customer_name"], "customer_id").select("customer_id", "customer_name", "customer_tier")


def dim_supplier(enriched: DataFrame) -> DataFrame:
    d = enriched.where(F.col("supplier_name").isNotNull()).groupBy("supplier_name").agg(
        _mode("supplier_specialization").alias("specialization"), _mode("gps_provider").alias("gps_provider")
    )
    return sequential_ids(d, ["supplier_name"], "supplier_id").select(
        "supplier_id", "supplier_name", "specialization", "gps_provider"
    )


def dim_vehicle(enriched: DataFrame) -> DataFrame:
    d = enriched.where(F.col("vehicle_registration").isNotNull()).groupBy("vehicle_registration").agg(
        _mode("vehicle_type").alias("vehicle_type"), _mode("min_daily_km").alias("min_daily_km")
    )
    return sequential_ids(d, ["vehicle_registration"], "vehicle_id").select(
        "vehicle_id", F.col("vehicle_registration").alias("registration"), "vehicle_type",
        F.col("min_daily_km").cast("decimal(10,2)").alias("min_daily_km"),
    )


def dim_driver(enriched: DataFrame, suppliers: DataFrame) -> DataFrame:
    d = (
        enriched.where(F.col("driver_name").isNotNull())
        .select("driver_name", F.col("driver_mobile").alias("mobile_no"), "supplier_name")
        .distinct()
    )
    d = d.join(suppliers.select("supplier_name", "supplier_id"), "supplier_name", "left")
    return sequential_ids(d, ["driver_name", "mobile_no", "supplier_name"], "driver_id").select(
        "driver_id", "driver_name", "mobile_no", "supplier_id", "supplier_name"
    )


def dim_location(enriched: DataFrame) -> DataFrame:
    o = enriched.select(
        F.col("origin_location").alias("location_name"), F.col("origin_lat").alias("latitude"),
        F.col("origin_lon").alias("longitude"),
    )
    d = enriched.select(
        F.col("destination_location").alias("location_name"), F.col("dest_lat").alias("latitude"),
        F.col("dest_lon").alias("longitude"),
    )
    loc = o.unionByName(d).where(F.col("location_name").isNotNull()).distinct()
    return sequential_ids(loc, ["location_name", "latitude", "longitude"], "location_id").select(
        "location_id", "location_name", "latitude", "longitude", F.lit(None).cast("string").alias("region")
    )


def dimensions(enriched: DataFrame) -> dict[str, DataFrame]:
    sup = materialize(dim_supplier(enriched), "dim-supplier")
    return {
        "dim_customer": dim_customer(enriched),
        "dim_supplier": sup,
        "dim_vehicle": dim_vehicle(enriched),
        "dim_driver": dim_driver(enriched, sup),
        "dim_location": dim_location(enriched),
    }


def fact_shipment(enriched: DataFrame, dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """Facts with surrogate keys (left lookups: a missing dimension value
    leaves the key NULL) and warehouse decimal types."""
    dims = dims or dimensions(enriched)
    loc = dims["dim_location"]
    f = (
        enriched.join(dims["dim_customer"].select("customer_name", "customer_id"), "customer_name", "left")
        .join(dims["dim_supplier"].select("supplier_name", "supplier_id"), "supplier_name", "left")
        .join(
            dims["dim_vehicle"].select(F.col("registration").alias("vehicle_registration"), "vehicle_id"),
            "vehicle_registration", "left",
        )
        .join(
            dims["dim_driver"].select(
                "driver_name", F.col("mobile_no").alias("driver_mobile"), "supplier_name", "driver_id"
            ),
            ["driver_name", "driver_mobile", "supplier_name"], "left",
        )
        .join(
            loc.select(F.col("location_name").alias("origin_location"), F.col("latitude").alias("origin_lat"),
                       F.col("longitude").alias("origin_lon"), F.col("location_id").alias("origin_location_id")),
            ["origin_location", "origin_lat", "origin_lon"], "left",
        )
        .join(
            loc.select(F.col("location_name").alias("destination_location"), F.col("latitude").alias("dest_lat"),
                       F.col("longitude").alias("dest_lon"), F.col("location_id").alias("dest_location_id")),
            ["destination_location", "dest_lat", "dest_lon"], "left",
        )
    )
    risk = F.col("risk_score") if "risk_score" in enriched.columns else F.lit(None)
    return f.select(
        "booking_id", "shipment_type", F.col("booking_date").alias("booking_ts"), "customer_id", "supplier_id",
        "vehicle_id", "driver_id", "origin_location_id", "dest_location_id",
        F.col("material_shipped").alias("material_code"),
        *[F.col(c).cast(t).alias(c) for c, t in DEC.items() if c in ("distance_km", "geo_distance_km",
                                                                    "route_detour_ratio")],
        F.col("trip_start").alias("trip_start_ts"), F.col("trip_end").alias("trip_end_ts"),
        F.col("planned_eta").alias("planned_eta_ts"), F.col("actual_eta").alias("actual_eta_ts"),
        (F.col("is_ontime") == 1).alias("is_ontime"),
        *[F.col(c).cast(t).alias(c) for c, t in DEC.items() if c in ("wait_hours", "moving_hours",
                                                                    "unloading_hours", "delay_hours",
                                                                    "idle_days_proxy")],
        risk.cast("decimal(5,2)").alias("risk_score"),
        "booking_month",
    )


def fact_gps_ping(segments: DataFrame) -> DataFrame:
    """Valid pings with speed/idle from the trajectory step.

    Pings a microsecond apart can lie half the globe apart, 7.2e13 km/h: 16 digits hold any speed."""
    p = segments.where(
        F.col("booking_id").isNotNull() & F.col("gps_ping_time").isNotNull()
        & F.col("current_lat").between(-90.0, 90.0) & F.col("current_lon").between(-180.0, 180.0)
    )
    return p.select(
        "booking_id",
        F.col("gps_ping_time").alias("ping_ts"),
        F.col("current_lat").cast("decimal(10,6)").alias("latitude"),
        F.col("current_lon").cast("decimal(10,6)").alias("longitude"),
        F.col("segment_speed_kmph").cast("decimal(18,2)").alias("speed_kmph"),
        F.lit(None).cast("decimal(6,2)").alias("heading_deg"),
        F.col("is_idle_segment").alias("is_idle"),
        "gps_provider",
        "ingest_ts",
        F.to_date("gps_ping_time").alias("ping_date"),
    )


def fact_prediction(scored: DataFrame, model_name: str, model_version: str = "1") -> DataFrame:
    """Prediction rows from a scored frame (late probability, risk)."""
    pred_delay = F.col("predicted_delay_h") if "predicted_delay_h" in scored.columns else F.lit(None)
    pred_eta = F.col("predicted_eta_ts") if "predicted_eta_ts" in scored.columns else F.lit(None)
    return scored.select(
        "booking_id",
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        pred_eta.cast("timestamp").alias("predicted_eta_ts"),
        pred_delay.cast("decimal(10,2)").alias("predicted_delay_h"),
        F.col("late_probability").cast("decimal(6,4)").alias("late_probability"),
        F.col("risk_score").cast("decimal(5,2)").alias("risk_score"),
        F.current_timestamp().alias("scored_at"),
    )


def mv_supplier_segment(facts: DataFrame, suppliers: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Fact x supplier x vehicle, view banding (NULL distance -> last band)."""
    f = facts.join(suppliers.select("supplier_id"), "supplier_id").join(
        vehicles.select("vehicle_id", "vehicle_type"), "vehicle_id"
    )
    return f.groupBy("supplier_id", band_sql("distance_km").alias("distance_band"), "vehicle_type").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.avg(F.when(F.col("is_ontime"), 1.0).otherwise(0.0)).alias("ontime_rate"),
        F.avg(F.col("delay_hours").cast("double")).alias("avg_delay_hours"),
        F.avg(hours_between("trip_start_ts", "booking_ts")).alias("avg_wait_hours"),
    )
