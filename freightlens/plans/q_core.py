"""Registered queries: sources, cleaning and feature projections
(S1-S5, C1-C10, F1-F21) with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clean as C
from ..session import ensure_checkpoint_dir, lean_shuffles, materialize
from ..sources import fixtures
from ..sources.shipments import load_shipments, read_dictionary, read_shipments
from . import context as ctx
from .common import rounded, ts_text
from .oracle_sql import rnd, with_clean, with_enriched, with_raw

Q: dict = {}
SQL: dict = {}


def _ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


# --- S3-S5: rename + coerce from the all-text sheet ------------------------
def _typed(sheet):
    return rounded(
        load_shipments(sheet).select(
            "booking_id", ts_text("booking_date"), ts_text("gps_ping_time"), ts_text("planned_eta"),
            ts_text("actual_eta"), ts_text("trip_start"), ts_text("trip_end"), "distance_km",
            "origin_lat", "origin_lon", "dest_lat", "dest_lon", "current_lat", "current_lon",
            "min_daily_km", "ontime_flag", "vehicle_type", "customer_name",
        )
    )


def ship_rename_cast(spark, sf_dir):
    return _typed(fixtures.shipments_source(spark, sf_dir))


Q["ship_rename_cast"] = ship_rename_cast
SQL["ship_rename_cast"] = with_raw(
    f"""SELECT booking_id, {_ts('booking_date')}, {_ts('gps_ping_time')}, {_ts('planned_eta')},
  {_ts('actual_eta')}, {_ts('trip_start')}, {_ts('trip_end')}, {rnd('distance_km')} AS distance_km,
  {rnd('origin_lat')} AS origin_lat, {rnd('origin_lon')} AS origin_lon, {rnd('dest_lat')} AS dest_lat,
  {rnd('dest_lon')} AS dest_lon, {rnd('current_lat')} AS current_lat, {rnd('current_lon')} AS current_lon,
  {rnd('min_daily_km')} AS min_daily_km, ontime_flag, vehicle_type, customer_name FROM raw"""
)


# --- S1/S2: the sheets as files ---------------------------------------------
RECORDS_PER_FILE = 1_000_000


def _written(df, name):
    """``df`` as compressed CSV files with a header, in a folder of its own; a file is read by one task, so it has an end."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/sheets/{name}-{uuid.uuid4().hex[:12]}"
    sheet = df.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
    with lean_shuffles(df):
        sheet.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).csv(path)
    return path


def sheet_scan(spark, sf_dir):
    """The sheet exported with its columns in another order and one more, scanned by header."""
    sheet = fixtures.shipments_source(spark, sf_dir).drop("_tie")
    return _typed(read_shipments(spark, _written(sheet.select(F.lit("x").alias("Remarks"), *sorted(sheet.columns)), "shipments")))


def dictionary_scan(spark, sf_dir):
    """A dictionary of the parts, exported and scanned."""
    parts = fixtures.table(spark, sf_dir, "part").select(F.col("p_name").alias("description"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("field"))
    return read_dictionary(spark, _written(parts, "dictionary"))


Q["sheet_scan"] = sheet_scan
SQL["sheet_scan"] = SQL["ship_rename_cast"]
Q["dictionary_scan"] = dictionary_scan
SQL["dictionary_scan"] = "SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS field, p_name AS description FROM part"


# --- C1 ----------------------------------------------------------------------
def _deduped(spark, sf_dir, *columns):
    """C1 on the landed sheet; only the columns asked for and those that choose the row are dealt out by booking."""
    needed = dict.fromkeys([*columns, "booking_id", "actual_eta", "gps_ping_time", "trip_start", "_tie"])
    return materialize(C.dedupe_bookings(ctx.landed(spark, sf_dir).select(*needed)).select(*columns), "deduped")


def dedupe_bookings(spark, sf_dir):
    d = _deduped(spark, sf_dir, "booking_id", "gps_ping_time", "actual_eta", "trip_start", "distance_km", "supplier_name",
                 "material_shipped", "vehicle_type", "ontime_flag")
    return rounded(
        d.select("booking_id", ts_text("gps_ping_time"), ts_text("actual_eta"), ts_text("trip_start"),
                 "distance_km", "supplier_name", "material_shipped", "vehicle_type", "ontime_flag")
    )


Q["dedupe_bookings"] = dedupe_bookings
SQL["dedupe_bookings"] = with_clean(
    f"""SELECT booking_id, {_ts('gps_ping_time')}, {_ts('actual_eta')}, {_ts('trip_start')},
  {rnd('distance_km')} AS distance_km, supplier_name, material_shipped, vehicle_type, ontime_flag FROM dedup"""
)


# --- C2/C3 -------------------------------------------------------------------
Q["flag_normalise"] = lambda spark, sf_dir: ctx.cleaned(spark, sf_dir).select(
    "booking_id", "ontime_flag", "is_ontime"
)
SQL["flag_normalise"] = with_clean("SELECT booking_id, ontime_flag, is_ontime FROM clean")

# --- C4 ----------------------------------------------------------------------
Q["distance_band"] = lambda spark, sf_dir: rounded(
    ctx.cleaned(spark, sf_dir).select("booking_id", "distance_km", "distance_band")
)
SQL["distance_band"] = with_clean(f"SELECT booking_id, {rnd('distance_km')} AS distance_km, distance_band FROM clean")


# --- C5 ----------------------------------------------------------------------
def mode_by_band(spark, sf_dir):
    d = _deduped(spark, sf_dir, "distance_km", "vehicle_type").withColumn("distance_band", C.distance_band("distance_km"))
    return C.vehicle_mode_by_band(d).withColumnRenamed("_band_vehicle", "mode_vehicle_type")


Q["mode_by_band"] = mode_by_band
SQL["mode_by_band"] = with_clean("SELECT distance_band, band_vehicle AS mode_vehicle_type FROM band_modes")

# --- C6-C9 -------------------------------------------------------------------
Q["impute_vehicle"] = lambda spark, sf_dir: ctx.cleaned(spark, sf_dir).select(
    "booking_id", "vehicle_type", "vehicle_type_imputed"
)
SQL["impute_vehicle"] = with_clean("SELECT booking_id, vehicle_type, vehicle_type_imputed FROM clean")

Q["null_invalid_trip"] = lambda spark, sf_dir: ctx.cleaned(spark, sf_dir).select("booking_id", ts_text("trip_end"))
SQL["null_invalid_trip"] = with_clean(f"SELECT booking_id, {_ts('trip_end')} FROM clean")

Q["null_extreme_delay"] = lambda spark, sf_dir: ctx.cleaned(spark, sf_dir).select(
    "booking_id", ts_text("actual_eta")
)
SQL["null_extreme_delay"] = with_clean(f"SELECT booking_id, {_ts('actual_eta')} FROM clean")

Q["fix_booking"] = lambda spark, sf_dir: ctx.cleaned(spark, sf_dir).select("booking_id", ts_text("booking_date"))
SQL["fix_booking"] = with_clean(f"SELECT booking_id, {_ts('booking_date')} FROM clean")

# --- C10 ---------------------------------------------------------------------
Q["quality_log"] = lambda spark, sf_dir: ctx.quality(spark, sf_dir)
SQL["quality_log"] = with_clean(
    """SELECT * FROM (VALUES
  ('dedupe_bookings', 'rows_removed', (SELECT count(*) FROM raw) - (SELECT count(*) FROM c3)),
  ('impute_vehicle_type', 'imputed_count', (SELECT count(*) FILTER (WHERE vehicle_type_imputed) FROM c3)),
  ('null_invalid_trip_end', 'count', (SELECT count(*) FILTER (WHERE m_trip) FROM c3)),
  ('null_extreme_delay_eta', 'count', (SELECT count(*) FILTER (WHERE m_delay) FROM c3)),
  ('fix_booking_after_start', 'count', (SELECT count(*) FILTER (WHERE m_wait) FROM c3))
) AS t(step, metric, value)"""
)


# --- Feature projections -----------------------------------------------------
def _proj(cols):
    return lambda spark, sf_dir: rounded(ctx.enriched(spark, sf_dir).select("booking_id", *cols))


def _proj_sql(cols, doubles):
    parts = [f"{rnd(c)} AS {c}" if c in doubles else c for c in cols]
    return with_enriched(f"SELECT booking_id, {', '.join(parts)} FROM enriched")


FEATURE_SETS = {
    "lead_time_features": (
        ["wait_hours", "moving_hours", "delay_hours", "trip_days", "is_late", "unloading_hours"],
        {"wait_hours", "moving_hours", "delay_hours", "trip_days", "unloading_hours"},
    ),
    "speed_features": (["avg_speed_kmph", "km_per_day"], {"avg_speed_kmph", "km_per_day"}),
    "route_features": (
        ["route_id", "geo_distance_km", "route_detour_ratio", "distance_band", "route_category",
         "booking_month", "booking_dow"],
        {"geo_distance_km", "route_detour_ratio"},
    ),
    "material_group": (["material_shipped", "material_group"], set()),
    "supplier_specialization": (["supplier_name", "supplier_specialization"], set()),
    "customer_tier": (["customer_name", "customer_tier"], set()),
    "idle_proxy": (["expected_days", "idle_days_proxy"], {"expected_days", "idle_days_proxy"}),
    "gps_snapshot_features": (
        ["gps_ping_lag_hours", "gps_position_drift_km"], {"gps_ping_lag_hours", "gps_position_drift_km"}
    ),
}
for _k, (_cols, _dbl) in FEATURE_SETS.items():
    Q[_k] = _proj(_cols)
    SQL[_k] = _proj_sql(_cols, _dbl)
