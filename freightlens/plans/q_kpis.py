"""Registered queries: KPI tables A1-A20 with their SQL twins."""

from __future__ import annotations

from ..operators import kpis as K
from . import context as ctx
from .common import rounded
from .oracle_sql import SEG_MEASURES, rnd, segment_sql, with_enriched

Q: dict = {}
SQL: dict = {}


def _on_enriched(fn, *args, **kw):
    return lambda spark, sf_dir: rounded(fn(ctx.enriched(spark, sf_dir), *args, **kw))


Q["executive_kpis"] = _on_enriched(K.executive_kpis)
SQL["executive_kpis"] = with_enriched(
    f"""SELECT count(DISTINCT booking_id) AS total_bookings,
  CAST(coalesce(sum(is_ontime), 0) AS BIGINT) AS ontime_bookings,
  {rnd(rnd('avg(is_ontime) * 100', 2))} AS ontime_rate_pct,
  {rnd(rnd('avg(trip_days)', 2))} AS avg_trip_days,
  {rnd(rnd('avg(distance_km)', 2))} AS avg_distance_km,
  {rnd(rnd('avg(delay_hours)', 2))} AS avg_delay_hours,
  {rnd(rnd('avg(wait_hours)', 2))} AS avg_wait_hours
FROM enriched WHERE booking_id IS NOT NULL"""
)

Q["segment_performance"] = _on_enriched(K.segment_performance, "shipment_type", 10)
SQL["segment_performance"] = with_enriched(segment_sql("shipment_type", 10))

Q["supplier_overall"] = _on_enriched(K.supplier_overall, 15)
SQL["supplier_overall"] = with_enriched(segment_sql("supplier_name", 15))

Q["supplier_segmented"] = _on_enriched(K.supplier_segmented, 5)
SQL["supplier_segmented"] = with_enriched(
    f"""SELECT supplier_name, distance_band, vehicle_type, count(booking_id) AS bookings,
  {rnd('avg(is_ontime)')} AS ontime_rate, {rnd('avg(delay_hours)')} AS avg_delay_h,
  {rnd('avg(trip_days)')} AS avg_trip_days, {rnd(rnd('avg(is_ontime) * 100', 2))} AS ontime_rate_pct
FROM enriched GROUP BY supplier_name, distance_band, vehicle_type HAVING count(booking_id) >= 5"""
)

Q["route_kpis"] = _on_enriched(K.route_kpis, 5)
SQL["route_kpis"] = with_enriched(segment_sql("route_id", 5))

Q["priority_routes"] = _on_enriched(K.priority_routes, 10, 48.0, 20, 15)
SQL["priority_routes"] = with_enriched(
    f"""SELECT * FROM ({segment_sql('route_id', 10)}) r
WHERE avg_delay_hours > 48 AND total_bookings >= 20 ORDER BY total_bookings DESC, route_id LIMIT 15"""
)

Q["customer_scorecard"] = _on_enriched(K.customer_scorecard, 20)
SQL["customer_scorecard"] = with_enriched(segment_sql("customer_name", 20))

Q["material_lead_time"] = _on_enriched(K.material_lead_time)
SQL["material_lead_time"] = with_enriched(
    f"""SELECT material_group, count(booking_id) AS bookings,
  {rnd('quantile_cont(trip_days, 0.5)')} AS median_trip_days,
  {rnd('quantile_cont(trip_days, 0.9)')} AS p90_trip_days,
  {rnd('avg(is_ontime)')} AS ontime_rate, {rnd('avg(delay_hours)')} AS avg_delay_h
FROM enriched WHERE material_group IS NOT NULL GROUP BY material_group"""
)

Q["delay_patterns"] = _on_enriched(K.delay_patterns)
SQL["delay_patterns"] = with_enriched(
    f"""SELECT booking_month, count(booking_id) AS bookings, {rnd('avg(is_late)')} AS late_rate,
  {rnd('avg(delay_hours)')} AS avg_delay_h, {rnd('avg(wait_hours)')} AS avg_wait_h,
  {rnd('avg(idle_days_proxy)')} AS avg_idle_days, {rnd(rnd('avg(is_late) * 100', 2))} AS late_rate_pct
FROM enriched GROUP BY booking_month"""
)

Q["fleet_utilization"] = _on_enriched(K.fleet_utilization)
SQL["fleet_utilization"] = with_enriched(
    f"""SELECT vehicle_type, count(booking_id) AS trips, {rnd('avg(km_per_day)')} AS avg_km_per_day,
  {rnd('quantile_cont(trip_days, 0.5)')} AS median_trip_days, {rnd('avg(is_ontime)')} AS ontime_rate
FROM enriched WHERE vehicle_type IS NOT NULL GROUP BY vehicle_type"""
)

Q["driver_scorecard"] = _on_enriched(K.driver_scorecard, 10)
SQL["driver_scorecard"] = with_enriched(segment_sql("driver_name", 10))

Q["vehicle_band_segments"] = _on_enriched(K.vehicle_band_segments, 5)
SQL["vehicle_band_segments"] = with_enriched(segment_sql("vehicle_type, distance_band", 5))

Q["origin_map"] = _on_enriched(K.origin_map)
SQL["origin_map"] = with_enriched(
    f"""SELECT origin_location, {rnd('origin_lat')} AS origin_lat, {rnd('origin_lon')} AS origin_lon,
  count(booking_id) AS bookings, {rnd('avg(is_ontime)')} AS ontime_rate,
  {rnd('avg(is_ontime) * 100')} AS ontime_rate_pct
FROM enriched WHERE origin_location IS NOT NULL AND origin_lat IS NOT NULL AND origin_lon IS NOT NULL
GROUP BY origin_location, origin_lat, origin_lon"""
)

Q["bookings_trend"] = _on_enriched(K.bookings_trend)
SQL["bookings_trend"] = with_enriched(
    "SELECT booking_month, count(booking_id) AS bookings FROM enriched GROUP BY booking_month"
)

Q["top_suppliers"] = _on_enriched(K.top_suppliers, 12, 15)
SQL["top_suppliers"] = with_enriched(
    f"SELECT * FROM ({segment_sql('supplier_name', 15)}) ORDER BY total_bookings DESC, supplier_name LIMIT 12"
)

_DIMS = K.SLICER_DIMENSIONS
_slicer_parts = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value,{SEG_MEASURES} FROM enriched GROUP BY {d}"
    for d in _DIMS
)
Q["slicer_grouping_sets"] = _on_enriched(K.slicer)
SQL["slicer_grouping_sets"] = with_enriched(_slicer_parts)

Q["kpis_filtered"] = _on_enriched(
    K.kpis_filtered, date_from="1996-01-01", date_to="1998-01-01", shipment_type="Regular"
)

def _kpi_sql(where: str) -> str:
    return f"""SELECT count(DISTINCT booking_id) AS total_bookings,
  CAST(coalesce(sum(is_ontime), 0) AS BIGINT) AS ontime_bookings,
  {rnd(rnd('avg(is_ontime) * 100', 2))} AS ontime_rate_pct,
  {rnd(rnd('avg(trip_days)', 2))} AS avg_trip_days,
  {rnd(rnd('avg(distance_km)', 2))} AS avg_distance_km,
  {rnd(rnd('avg(delay_hours)', 2))} AS avg_delay_hours,
  {rnd(rnd('avg(wait_hours)', 2))} AS avg_wait_hours
FROM enriched WHERE booking_id IS NOT NULL AND {where}"""


SQL["kpis_filtered"] = with_enriched(
    _kpi_sql("booking_date >= TIMESTAMP '1996-01-01' AND booking_date < TIMESTAMP '1998-01-01' AND shipment_type = 'Regular'")
)
Q["kpis_in_transit"] = _on_enriched(K.kpis_filtered, status="in_transit")
SQL["kpis_in_transit"] = with_enriched(_kpi_sql("trip_start IS NOT NULL AND trip_end IS NULL"))

Q["supplier_score"] = _on_enriched(K.supplier_score, 15)
SQL["supplier_score"] = with_enriched(
    f"""SELECT supplier_name, total_bookings, {rnd('ontime_rate')} AS ontime_rate,
  {rnd('avg_delay_hours')} AS avg_delay_hours, routes_served,
  {rnd('''100 * (
     coalesce(CASE WHEN a1 > a0 THEN (ontime_rate - a0) / (a1 - a0) ELSE 1.0e0 END, 0) * (0.5e0 / 0.8e0)
   + coalesce(1.0e0 - CASE WHEN d1 > d0 THEN (avg_delay_hours - d0) / (d1 - d0) ELSE 1.0e0 END, 0) * (0.25e0 / 0.8e0)
   + coalesce(CASE WHEN r1 > r0 THEN (routes_served - r0) / (r1 - r0) ELSE 1.0e0 END, 0) * (0.05e0 / 0.8e0))''')}
   AS supplier_score
FROM s, b""",
    """s AS (
  SELECT supplier_name, count(booking_id) AS total_bookings, avg(is_ontime) AS ontime_rate,
         avg(delay_hours) AS avg_delay_hours, count(DISTINCT route_id) AS routes_served
  FROM enriched WHERE supplier_name IS NOT NULL GROUP BY supplier_name HAVING count(booking_id) >= 15),
b AS (SELECT min(ontime_rate) a0, max(ontime_rate) a1, min(avg_delay_hours) d0, max(avg_delay_hours) d1,
             min(routes_served) r0, max(routes_served) r1 FROM s)""",
)

Q["rolling_kpis"] = _on_enriched(K.rolling_kpis)
SQL["rolling_kpis"] = with_enriched(
    f"""SELECT strftime(week_start, '%Y-%m-%d') AS week_start, bookings, ontime,
  {rnd('sum(bookings) OVER w8 / 8.0e0')} AS bookings_8w_avg,
  {rnd('sum(ontime) OVER w4 * 100.0e0 / sum(bookings) OVER w4')} AS ontime_4w_pct
FROM (SELECT CAST(date_trunc('week', booking_date) AS DATE) AS week_start, count(*) AS bookings,
             CAST(sum(is_ontime) AS BIGINT) AS ontime
      FROM enriched WHERE booking_date IS NOT NULL AND booking_id IS NOT NULL GROUP BY 1) w
WINDOW w8 AS (ORDER BY (week_start - DATE '1970-01-01') // 7 RANGE BETWEEN 7 PRECEDING AND CURRENT ROW),
       w4 AS (ORDER BY (week_start - DATE '1970-01-01') // 7 RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)"""
)
