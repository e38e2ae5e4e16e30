"""Registered queries: profile (P1-P13) and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import COLUMN_MAP, SHIPMENT_SCHEMA
from ..functions.columns import r
from ..operators import diagnostics as D
from ..operators import profile as P
from . import context as ctx
from .common import rounded, ts_text
from .oracle_sql import clip0, hours, rnd, with_enriched, with_raw

Q: dict = {}
SQL: dict = {}


def _raw(spark, sf_dir):
    return ctx.landed(spark, sf_dir).drop("_tie")


def _on_raw(fn):
    return lambda spark, sf_dir: rounded(fn(_raw(spark, sf_dir)))


def _on_joined(fn):
    """For profiles that go over few columns once: only these are joined, and no table is written."""
    return lambda spark, sf_dir: rounded(fn(ctx.raw(spark, sf_dir)))


def _on_enriched(fn, *a):
    return lambda spark, sf_dir: rounded(fn(ctx.enriched(spark, sf_dir), *a))


PINGS_SQL = "(SELECT count(*) AS n FROM raw WHERE booking_id IS NOT NULL GROUP BY booking_id)"


def describe_sql(expr: str, src: str, label: str | None = None) -> str:
    head = f"'{label}' AS metric, " if label else ""
    return (
        f"SELECT {head}count({expr}) AS count, {rnd(f'avg({expr})')} AS mean, "
        f"{rnd(f'stddev_samp({expr})')} AS std, {rnd(f'CAST(min({expr}) AS DOUBLE)')} AS min, "
        f"{rnd(f'quantile_cont({expr}, 0.25)')} AS p25, {rnd(f'quantile_cont({expr}, 0.5)')} AS p50, "
        f"{rnd(f'quantile_cont({expr}, 0.75)')} AS p75, {rnd(f'CAST(max({expr}) AS DOUBLE)')} AS max FROM {src}"
    )


Q["profile_counts"] = _on_raw(P.profile_counts)
SQL["profile_counts"] = with_raw(
    f"""SELECT count(*) AS row_count, count(DISTINCT booking_id) AS unique_bookings,
  strftime(min(booking_date), '%Y-%m-%d %H:%M:%S') AS booking_min,
  strftime(max(booking_date), '%Y-%m-%d %H:%M:%S') AS booking_max,
  {rnd('(SELECT median(n) FROM ' + PINGS_SQL + ')')} AS median_pings_per_booking,
  CASE WHEN (SELECT median(n) FROM {PINGS_SQL}) <= 1.5 THEN 'snapshot' ELSE 'multi_ping_trajectory' END
    AS gps_tracking_mode
FROM raw"""
)

_CANON = list(COLUMN_MAP.values())
Q["profile_schema"] = lambda spark, sf_dir: P.profile_schema(_raw(spark, sf_dir), _CANON)
SQL["profile_schema"] = with_raw(
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS dtype, count({f.name}) AS non_null FROM raw"
        for i, f in enumerate(SHIPMENT_SCHEMA.fields))
)

Q["profile_missing"] = _on_raw(P.profile_missing)
SQL["profile_missing"] = with_raw(
    "SELECT column_name, " + rnd(rnd("v", 2)) + " AS missing_pct FROM (UNPIVOT (SELECT "
    + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0.0e0 END) * 100 AS {c}" for c in _CANON)
    + " FROM raw) ON COLUMNS(*) INTO NAME column_name VALUE v)"
)

Q["profile_pings"] = _on_joined(P.profile_pings)
SQL["profile_pings"] = with_raw(describe_sql("n", PINGS_SQL))

Q["profile_flag_dist"] = _on_joined(P.profile_flag_dist)
SQL["profile_flag_dist"] = with_raw("SELECT ontime_flag, count(*) AS rows FROM raw GROUP BY ontime_flag")

Q["profile_shipment_types"] = _on_joined(P.profile_shipment_types)
SQL["profile_shipment_types"] = with_raw(
    "SELECT shipment_type, count(*) AS rows FROM raw WHERE shipment_type IS NOT NULL GROUP BY shipment_type"
)

Q["profile_entities"] = _on_raw(P.profile_entities)
SQL["profile_entities"] = with_raw(
    """SELECT count(DISTINCT supplier_name) AS suppliers, count(DISTINCT customer_name) AS customers,
  count(DISTINCT driver_name) AS drivers, count(DISTINCT vehicle_registration) AS vehicles,
  count(DISTINCT material_shipped) AS materials,
  count(DISTINCT origin_location || chr(1) || destination_location) AS routes FROM raw"""
)

_LC = {
    "booking_to_trip_start_h": hours("trip_start", "booking_date"),
    "trip_duration_days": f"{hours('trip_end', 'trip_start')} / 24",
    "planned_vs_actual_delay_h": hours("actual_eta", "planned_eta"),
}
_LC_CTE = "lc AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _LC.items()) + " FROM raw)"
Q["profile_lifecycle"] = _on_raw(P.profile_lifecycle)
SQL["profile_lifecycle"] = with_raw(" UNION ALL ".join(describe_sql(k, "lc", k) for k in _LC), _LC_CTE)

Q["profile_flags"] = lambda spark, sf_dir: P.profile_flags(_raw(spark, sf_dir))
SQL["profile_flags"] = with_raw(
    f"""SELECT flag FROM st, (VALUES
  (1, 'negative_trip_duration'), (2, 'extreme_delay_outliers'), (3, 'high_vehicle_type_missing'),
  (4, 'missing_distance'), (5, '{P.LOW_FREQUENCY_FLAG}'), (6, 'booking_after_trip_start_anomalies')) AS f(id, flag)
WHERE (id = 1 AND min_trip < 0) OR (id = 2 AND max_abs_delay > 8760) OR (id = 3 AND vt_missing > 0.15)
   OR (id = 4 AND dist_missing > 0.05) OR (id = 5 AND max_pings <= 3) OR (id = 6 AND bad_wait > 0)""",
    _LC_CTE + """,
st AS (SELECT min(trip_duration_days) AS min_trip, max(abs(planned_vs_actual_delay_h)) AS max_abs_delay,
  avg(CASE WHEN vehicle_type IS NULL THEN 1.0e0 ELSE 0.0e0 END) AS vt_missing,
  avg(CASE WHEN distance_km IS NULL THEN 1.0e0 ELSE 0.0e0 END) AS dist_missing,
  count(*) FILTER (WHERE booking_to_trip_start_h < -24) AS bad_wait,
  (SELECT max(n) FROM """ + PINGS_SQL + """) AS max_pings FROM lc)""",
)

Q["lead_time_describe"] = _on_enriched(P.lead_time_describe)
SQL["lead_time_describe"] = with_enriched(
    " UNION ALL ".join(describe_sql(c, "enriched", c) for c in P.LEAD_TIME_PARTS)
)


def multi_ping(spark, sf_dir):
    rows = P.multi_ping_bookings(_raw(spark, sf_dir))
    return rounded(rows.select("booking_id", ts_text("gps_ping_time"), "current_lat", "current_lon", "distance_km"))


Q["multi_ping_bookings"] = multi_ping
SQL["multi_ping_bookings"] = with_raw(
    f"""SELECT booking_id, strftime(gps_ping_time, '%Y-%m-%d %H:%M:%S') AS gps_ping_time,
  {rnd('current_lat')} AS current_lat, {rnd('current_lon')} AS current_lon, {rnd('distance_km')} AS distance_km
FROM raw WHERE booking_id IN (SELECT booking_id FROM raw GROUP BY booking_id HAVING count(*) > 1)"""
)

# --- R1-R5 -------------------------------------------------------------------
Q["peer_benchmark"] = _on_enriched(D.peer_benchmark)
SQL["peer_benchmark"] = with_enriched(
    f"""SELECT distance_band, vehicle_type, {rnd('avg(is_ontime)')} AS peer_ontime,
  {rnd('avg(delay_hours)')} AS peer_delay FROM enriched GROUP BY distance_band, vehicle_type"""
)

_GAP_MEASURES = f"""count(e.booking_id) AS bookings, {rnd('avg(e.is_ontime)')} AS ontime_rate,
  {rnd('max(p.peer_ontime)')} AS peer_ontime, {rnd('avg(e.is_ontime - p.peer_ontime)')} AS ontime_gap,
  {rnd('avg(e.delay_hours)')} AS avg_delay_h, {rnd('max(p.peer_delay)')} AS peer_delay_h"""
_PEER_CTE = """peer AS (SELECT distance_band, vehicle_type, avg(is_ontime) AS peer_ontime,
  avg(delay_hours) AS peer_delay FROM enriched GROUP BY distance_band, vehicle_type)"""


def capability_gap(spark, sf_dir):
    e = ctx.enriched(spark, sf_dir)
    return rounded(D.capability_gap(e, D.largest_supplier(e)))


Q["capability_gap"] = capability_gap
SQL["capability_gap"] = with_enriched(
    f"""SELECT e.distance_band, e.vehicle_type, {_GAP_MEASURES}
FROM enriched e LEFT JOIN peer p ON e.distance_band = p.distance_band AND e.vehicle_type = p.vehicle_type
WHERE e.supplier_name = (SELECT supplier_name FROM enriched WHERE supplier_name IS NOT NULL
                         GROUP BY supplier_name ORDER BY count(booking_id) DESC, supplier_name LIMIT 1)
  AND e.distance_band IS NOT NULL AND e.vehicle_type IS NOT NULL
GROUP BY e.distance_band, e.vehicle_type""",
    _PEER_CTE,
)

Q["capability_gap_all"] = _on_enriched(D.capability_gap_all)
SQL["capability_gap_all"] = with_enriched(
    f"""SELECT e.supplier_name, e.distance_band, e.vehicle_type, {_GAP_MEASURES}
FROM enriched e LEFT JOIN peer p ON e.distance_band = p.distance_band AND e.vehicle_type = p.vehicle_type
WHERE e.supplier_name IS NOT NULL AND e.distance_band IS NOT NULL AND e.vehicle_type IS NOT NULL
GROUP BY e.supplier_name, e.distance_band, e.vehicle_type""",
    _PEER_CTE,
)


def bottleneck(spark, sf_dir):
    b = D.bottleneck(ctx.enriched(spark, sf_dir))
    return rounded(b.withColumn("hours_sum", r(F.col("hours_sum"), 2)))


Q["bottleneck"] = bottleneck
SQL["bottleneck"] = with_enriched(
    f"""SELECT component, {rnd(rnd('hours_sum', 2))} AS hours_sum,
  {rnd('CASE WHEN pool > 0 THEN ' + rnd('hours_sum / pool * 100', 2) + ' ELSE 0.0e0 END')}
    AS share_of_positive_delay_pool
FROM (SELECT coalesce(sum({clip0('delay_hours')}), 0) AS pool,
        coalesce(sum(wait_hours), 0) AS c0,
        coalesce(sum({clip0('moving_hours - distance_km / 50.0e0')}), 0) AS c1,
        coalesce(sum(unloading_hours), 0) AS c2,
        coalesce(sum(idle_days_proxy * 24.0e0), 0) AS c3 FROM enriched) s,
LATERAL (VALUES ('waiting_before_dispatch', c0), ('slow_moving_trip', c1),
                ('unloading_after_arrival', c2), ('idle_beyond_contract_pace', c3)) AS v(component, hours_sum)"""
)

Q["model_frame"] = _on_enriched(D.model_frame)
SQL["model_frame"] = with_enriched(
    "SELECT booking_id, "
    + ", ".join(f"{rnd(c)} AS {c}" for c in D.MODEL_NUMERIC)
    + ", " + ", ".join(D.MODEL_CATEGORICAL)
    + f", {rnd('delay_hours')} AS delay_hours, is_late, is_ontime FROM enriched WHERE delay_hours IS NOT NULL AND "
    + " AND ".join(f"{c} IS NOT NULL" for c in D.MODEL_NUMERIC)
)
