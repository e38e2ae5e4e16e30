"""Registered queries: warehouse (S6-S8, A13) and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gps as G
from ..operators import rules as N
from ..operators import warehouse as W
from . import context as ctx
from .common import rounded
from .oracle_sql import hours, rnd, segment_sql, with_enriched

Q: dict = {}
SQL: dict = {}

CUSTOMER_PATTERN = "machinery"
MATERIAL = "red plate"


def _e(spark, sf_dir):
    return ctx.enriched(spark, sf_dir)


# --- S6 dimensions -------------------------------------------------------------
def _dim(name):
    return lambda spark, sf_dir: rounded(ctx.dimensions(spark, sf_dir)[name])


Q["dim_customer"] = _dim("dim_customer")
Q["dim_supplier"] = _dim("dim_supplier")
Q["dim_vehicle"] = lambda spark, sf_dir: rounded(
    ctx.dimensions(spark, sf_dir)["dim_vehicle"].withColumn("min_daily_km", F.col("min_daily_km").cast("double"))
)
Q["dim_driver"] = _dim("dim_driver")
Q["dim_location"] = _dim("dim_location")


def _mode_sql(key: str, col: str, alias: str) -> str:
    return (
        f"(SELECT {key}, {col} AS {alias} FROM (SELECT {key}, {col}, row_number() OVER (PARTITION BY {key} "
        f"ORDER BY count(*) DESC, {col}) AS rn FROM enriched WHERE {key} IS NOT NULL AND {col} IS NOT NULL "
        f"GROUP BY {key}, {col}) WHERE rn = 1)"
    )


DIM_CTES = f"""
dcust AS (
  SELECT row_number() OVER (ORDER BY k.customer_name) AS customer_id, k.customer_name, m.customer_tier
  FROM (SELECT DISTINCT customer_name FROM enriched WHERE customer_name IS NOT NULL) k
  LEFT JOIN {_mode_sql('customer_name', 'customer_tier', 'customer_tier')} m USING (customer_name)),
dsup AS (
  SELECT row_number() OVER (ORDER BY k.supplier_name) AS supplier_id, k.supplier_name,
         m1.specialization, m2.gps_provider
  FROM (SELECT DISTINCT supplier_name FROM enriched WHERE supplier_name IS NOT NULL) k
  LEFT JOIN {_mode_sql('supplier_name', 'supplier_specialization', 'specialization')} m1 USING (supplier_name)
  LEFT JOIN {_mode_sql('supplier_name', 'gps_provider', 'gps_provider')} m2 USING (supplier_name)),
dveh AS (
  SELECT row_number() OVER (ORDER BY k.vehicle_registration) AS vehicle_id, k.vehicle_registration AS registration,
         m1.vehicle_type, CAST(m2.min_daily_km AS DECIMAL(10,2)) AS min_daily_km
  FROM (SELECT DISTINCT vehicle_registration FROM enriched WHERE vehicle_registration IS NOT NULL) k
  LEFT JOIN {_mode_sql('vehicle_registration', 'vehicle_type', 'vehicle_type')} m1 USING (vehicle_registration)
  LEFT JOIN {_mode_sql('vehicle_registration', 'min_daily_km', 'min_daily_km')} m2 USING (vehicle_registration)),
ddrv AS (
  SELECT row_number() OVER (ORDER BY d.driver_name, d.mobile_no, d.supplier_name) AS driver_id,
         d.driver_name, d.mobile_no, s.supplier_id, d.supplier_name
  FROM (SELECT DISTINCT driver_name, driver_mobile AS mobile_no, supplier_name FROM enriched
        WHERE driver_name IS NOT NULL) d LEFT JOIN dsup s ON d.supplier_name = s.supplier_name),
dloc AS (
  SELECT row_number() OVER (ORDER BY location_name, latitude, longitude) AS location_id, location_name,
         latitude, longitude, CAST(NULL AS VARCHAR) AS region
  FROM (SELECT DISTINCT * FROM (
          SELECT origin_location AS location_name, origin_lat AS latitude, origin_lon AS longitude FROM enriched
          UNION ALL
          SELECT destination_location, dest_lat, dest_lon FROM enriched) WHERE location_name IS NOT NULL))"""

SQL["dim_customer"] = with_enriched("SELECT * FROM dcust", DIM_CTES)
SQL["dim_supplier"] = with_enriched("SELECT * FROM dsup", DIM_CTES)
SQL["dim_vehicle"] = with_enriched(
    f"SELECT vehicle_id, registration, vehicle_type, {rnd('CAST(min_daily_km AS DOUBLE)')} AS min_daily_km FROM dveh",
    DIM_CTES,
)
SQL["dim_driver"] = with_enriched("SELECT * FROM ddrv", DIM_CTES)
SQL["dim_location"] = with_enriched(
    f"SELECT location_id, location_name, {rnd('latitude')} AS latitude, {rnd('longitude')} AS longitude, region "
    "FROM dloc",
    DIM_CTES,
)


# --- S7 fact_shipment ------------------------------------------------------------
def fact_shipment(spark, sf_dir):
    f = W.fact_shipment(_e(spark, sf_dir), ctx.dimensions(spark, sf_dir))
    return rounded(
        f.select("booking_id", "customer_id", "supplier_id", "vehicle_id", "driver_id", "origin_location_id",
                 "dest_location_id", "is_ontime", F.col("delay_hours").cast("double").alias("delay_hours"),
                 F.col("wait_hours").cast("double").alias("wait_hours"), "booking_month")
    )


FACT_CTE = DIM_CTES + """,
fact AS (
  SELECT e.booking_id, e.shipment_type, e.booking_date AS booking_ts, c.customer_id, s.supplier_id, v.vehicle_id,
         d.driver_id, o.location_id AS origin_location_id, t.location_id AS dest_location_id,
         CAST(e.distance_km AS DECIMAL(10,2)) AS distance_km, e.trip_start AS trip_start_ts, e.is_ontime = 1 AS is_ontime,
         CAST(e.delay_hours AS DECIMAL(10,2)) AS delay_hours, CAST(e.wait_hours AS DECIMAL(10,2)) AS wait_hours,
         e.booking_month
  FROM enriched e
  LEFT JOIN dcust c ON e.customer_name = c.customer_name
  LEFT JOIN dsup s ON e.supplier_name = s.supplier_name
  LEFT JOIN dveh v ON e.vehicle_registration = v.registration
  LEFT JOIN ddrv d ON e.driver_name = d.driver_name AND e.driver_mobile = d.mobile_no
                  AND e.supplier_name = d.supplier_name
  LEFT JOIN dloc o ON e.origin_location = o.location_name AND e.origin_lat = o.latitude
                  AND e.origin_lon = o.longitude
  LEFT JOIN dloc t ON e.destination_location = t.location_name AND e.dest_lat = t.latitude
                  AND e.dest_lon = t.longitude)"""

Q["fact_shipment"] = fact_shipment
SQL["fact_shipment"] = with_enriched(
    f"""SELECT booking_id, customer_id, supplier_id, vehicle_id, driver_id, origin_location_id, dest_location_id,
  is_ontime, {rnd('CAST(delay_hours AS DOUBLE)')} AS delay_hours, {rnd('CAST(wait_hours AS DOUBLE)')} AS wait_hours,
  booking_month FROM fact""",
    FACT_CTE,
)

# --- S8: decimal sink of the trajectory (written and read back in q_sinks) ----------
Q["fact_gps_ping"] = lambda spark, sf_dir: W.fact_gps_ping(G.preprocess_trajectory(ctx.pings(spark, sf_dir)))


# --- A13 --------------------------------------------------------------------------
def mv_supplier_segment(spark, sf_dir):
    e = _e(spark, sf_dir)
    dims = ctx.dimensions(spark, sf_dir)
    facts = W.fact_shipment(e, dims)
    return rounded(W.mv_supplier_segment(facts, dims["dim_supplier"], dims["dim_vehicle"]))


Q["mv_supplier_segment"] = mv_supplier_segment
_VIEW_EDGES = [(100, "0-100km"), (300, "100-300km"), (600, "300-600km"), (1200, "600-1200km")]
_VIEW_BAND = "CASE " + " ".join(f"WHEN km <= {edge} THEN '{name}'" for edge, name in _VIEW_EDGES) + " ELSE '1200km+' END"
SQL["mv_supplier_segment"] = with_enriched(
    f"""SELECT supplier_id, distance_band, vehicle_type, count(*) AS bookings, {rnd('sum(punctual) / count(*)')} AS ontime_rate,
  {rnd('avg(late_h)')} AS avg_delay_hours, {rnd('avg(wait_h)')} AS avg_wait_hours
FROM (SELECT supplier_id, {_VIEW_BAND} AS distance_band, kind AS vehicle_type, punctual, late_h, wait_h FROM (
  SELECT fact.supplier_id, fact.distance_km AS km, dveh.vehicle_type AS kind, CASE WHEN is_ontime THEN 1.0e0 ELSE 0.0e0 END AS punctual,
    CAST(delay_hours AS DOUBLE) AS late_h, {hours('trip_start_ts', 'booking_ts')} AS wait_h
  FROM fact SEMI JOIN dsup USING (supplier_id) JOIN dveh USING (vehicle_id)))
GROUP BY ALL""",
    FACT_CTE,
)

# --- N1-N11 -----------------------------------------------------------------------
def rec_sql(rule: str, prio: str, metric: str, subject: str, n: str, b: str, c: str, t: str, src: str) -> str:
    return (
        f"SELECT '{rule}' AS rule_id, '{prio}' AS priority, '{metric}' AS metric, CAST({subject} AS VARCHAR) AS subject, "
        f"CAST({n} AS BIGINT) AS n, {rnd(f'CAST({b} AS DOUBLE)')} AS baseline_value, "
        f"{rnd(f'CAST({c} AS DOUBLE)')} AS comparison_value, {rnd(f'CAST({t} AS DOUBLE)')} AS target_value FROM {src}"
    )


def _on(fn, *a):
    return lambda spark, sf_dir: rounded(fn(_e(spark, sf_dir), *a))


_PCT = rnd("avg(is_ontime) * 100", 2)
_TGT = f"least({rnd('b + 12', 1)}, 55.0e0)"
Q["rec_network"] = _on(N.rec_network)
SQL["rec_network"] = with_enriched(
    rec_sql("N1", "P0", "network_ontime_pct", "'network'",
            "n", "b", f"{_TGT} - b", _TGT,
            f"(SELECT count(DISTINCT booking_id) AS n, {_PCT} AS b FROM enriched WHERE booking_id IS NOT NULL)")
)

Q["rec_lanes"] = _on(N.lane_plans)
_LANE_ROWS = rec_sql("N2", "P0", "lane_ontime_pct", "route_id", "total_bookings",
                     "ontime_rate_pct", "avg_delay_hours", "50.0e0",
                     f"(SELECT * FROM ({segment_sql('route_id', 20)}) WHERE total_bookings >= 25 "
                     "ORDER BY ontime_rate_pct, total_bookings DESC, route_id LIMIT 3)")
SQL["rec_lanes"] = with_enriched(f"SELECT *, 'Lane recovery plan: ' || replace(subject, '→', ' to ') AS initiative FROM ({_LANE_ROWS})")

Q["rec_suppliers"] = _on(N.rec_suppliers)
SQL["rec_suppliers"] = with_enriched(
    rec_sql("N3", "P1", "supplier_ontime_pct", "supplier_name", "total_bookings", "ontime_rate_pct", "avg_delay_hours", "NULL",
            f"(SELECT * FROM ({segment_sql('supplier_name', 40)}) "
            "ORDER BY ontime_rate_pct, total_bookings DESC, supplier_name LIMIT 3)")
)

Q["rec_customer"] = _on(N.rec_customer, CUSTOMER_PATTERN)
SQL["rec_customer"] = with_enriched(
    rec_sql("N4", "P1", "customer_ontime_pct", "customer_name",
            "total_bookings", "ontime_rate_pct", "NULL", "35.0e0",
            f"(SELECT * FROM ({segment_sql('customer_name', 30)}) WHERE customer_name ILIKE '%{CUSTOMER_PATTERN}%' "
            "ORDER BY total_bookings DESC, customer_name LIMIT 1)")
)

MAT_SQL = """(SELECT material_group, count(booking_id) AS bookings, quantile_cont(trip_days, 0.5) AS median_trip_days,
  quantile_cont(trip_days, 0.9) AS p90_trip_days, avg(is_ontime) AS ontime_rate, avg(delay_hours) AS avg_delay_h
  FROM enriched WHERE material_group IS NOT NULL GROUP BY material_group)"""
Q["rec_material"] = _on(N.rec_material, MATERIAL)
SQL["rec_material"] = with_enriched(
    rec_sql("N5", "P1", "material_ontime_pct", "material_group", "bookings", "ontime_rate * 100", "median_trip_days",
            "greatest(median_trip_days * 0.85e0, 3.0e0)", f"{MAT_SQL} WHERE material_group = '{MATERIAL}'")
)


def _cohort(name: str, cond: str) -> str:
    c = f"coalesce({cond}, false)"
    return (f"count(*) FILTER (WHERE {c}) AS {name}_n, "
            f"avg(CASE WHEN {c} THEN is_ontime END) * 100 AS {name}_ot")


COH = "(SELECT " + ", ".join([
    _cohort("detour_high", "route_detour_ratio > 1.5"), _cohort("detour_low", "route_detour_ratio <= 1.2"),
    _cohort("long_haul", "route_category = 'long_haul'"), _cohort("short_haul", "route_category = 'short_haul'"),
    _cohort("market", "shipment_type = 'Market'"), _cohort("regular", "shipment_type = 'Regular'"),
]) + (", avg(CASE WHEN coalesce(idle_days_proxy > 1, false) THEN 1.0e0 ELSE 0.0e0 END) * 100 AS idle_pct, "
      "avg(CASE WHEN vehicle_type_imputed THEN 1.0e0 ELSE 0.0e0 END) * 100 AS imputed_pct, count(*) AS rows "
      "FROM enriched)")

Q["rec_detour"] = _on(N.rec_detour)
SQL["rec_detour"] = with_enriched(
    rec_sql("N6", "P1", "high_detour_ontime_pct", "'detour_ratio>1.5'", "detour_high_n", "detour_high_ot", "detour_low_ot",
            "detour_high_ot + (detour_low_ot - detour_high_ot) / 2.0e0",
            f"{COH} WHERE detour_high_n > 50 AND detour_low_n > 50")
)

Q["rec_haul"] = _on(N.rec_haul)
SQL["rec_haul"] = with_enriched(
    rec_sql("N7", "P2", "haul_ontime_pct", "'long_haul'", "long_haul_n",
            "long_haul_ot", "NULL", "long_haul_ot + 7", f"{COH} WHERE long_haul_n >= 100")
    + " UNION ALL "
    + rec_sql("N7", "P2", "haul_ontime_pct", "'short_haul'",
              "short_haul_n", "short_haul_ot", "NULL", "short_haul_ot + 7", f"{COH} WHERE short_haul_n >= 100")
)

Q["rec_shipment_type"] = _on(N.rec_shipment_type)
SQL["rec_shipment_type"] = with_enriched(
    rec_sql("N8", "P2", "market_ontime_pct", "'Market'", "market_n",
            "market_ot", "regular_ot", "regular_ot - 5", f"{COH} WHERE market_n >= 20")
)

Q["rec_idle"] = _on(N.rec_idle)
SQL["rec_idle"] = with_enriched(
    rec_sql("N9", "P1", "idle_over_one_day_pct", "'idle_days_proxy>1'", "rows", "idle_pct", "NULL", "idle_pct * 0.75e0", COH)
)

Q["rec_imputed"] = _on(N.rec_imputed)
SQL["rec_imputed"] = with_enriched(
    rec_sql("N10", "P2", "vehicle_type_complete_pct", "'vehicle_type'", "rows", "100 - imputed_pct", "imputed_pct", "99.0e0", f"{COH} WHERE imputed_pct > 5")
)

MONTHLY_SQL = f"""(SELECT booking_month, count(booking_id) AS bookings,
  {rnd('avg(is_late) * 100', 2)} AS late_rate_pct, avg(delay_hours) AS avg_delay_h FROM enriched GROUP BY booking_month)"""
Q["rec_peak"] = _on(N.rec_peak)
SQL["rec_peak"] = with_enriched(
    rec_sql("N11", "P1", "peak_month_late_pct", "booking_month", "bookings", "late_rate_pct", "NULL", "late_rate_pct - 10",
            f"(SELECT * FROM {MONTHLY_SQL} ORDER BY late_rate_pct DESC, booking_month LIMIT 1) "
            f"WHERE (SELECT count(*) FROM {MONTHLY_SQL}) >= 3")
)

Q["recommendations"] = _on(N.recommendations, CUSTOMER_PATTERN, MATERIAL)
SQL["recommendations"] = with_enriched(
    " UNION ALL ".join(
        f"SELECT * FROM ({_LANE_ROWS if k == 'rec_lanes' else SQL[k][len(with_enriched('')):]})"
        for k in ("rec_network", "rec_lanes", "rec_suppliers", "rec_customer", "rec_material", "rec_detour", "rec_haul", "rec_shipment_type",
                  "rec_idle", "rec_imputed", "rec_peak")
    )
)

# --- S10 metric extract ---------------------------------------------------------------
Q["metric_extract"] = _on(N.metric_extract, CUSTOMER_PATTERN, MATERIAL)


def _long(section: str, key: str, metrics: list[str], src: str) -> str:
    vals = ", ".join(f"('{m}', CAST({m} AS DOUBLE))" for m in metrics)
    return (f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, v.metric, {rnd('v.value')} AS value "
            f"FROM {src} s, LATERAL (VALUES {vals}) AS v(metric, value)")


_SEG3 = ["total_bookings", "ontime_rate_pct", "avg_delay_hours"]
SQL["metric_extract"] = with_enriched(
    " UNION ALL ".join([
        _long("kpis", "NULL", ["total_bookings", "ontime_bookings", "ontime_rate_pct", "avg_trip_days",
                               "avg_distance_km", "avg_delay_hours", "avg_wait_hours"],
              f"""(SELECT count(DISTINCT booking_id) AS total_bookings,
                   CAST(coalesce(sum(is_ontime), 0) AS BIGINT) AS ontime_bookings, {_PCT} AS ontime_rate_pct,
                   {rnd('avg(trip_days)', 2)} AS avg_trip_days, {rnd('avg(distance_km)', 2)} AS avg_distance_km,
                   {rnd('avg(delay_hours)', 2)} AS avg_delay_hours, {rnd('avg(wait_hours)', 2)} AS avg_wait_hours
                   FROM enriched WHERE booking_id IS NOT NULL)"""),
        _long("bad_routes", "route_id", _SEG3, f"(SELECT * FROM ({segment_sql('route_id', 20)}) "
              "ORDER BY ontime_rate_pct, total_bookings DESC, route_id LIMIT 5)"),
        _long("worst_suppliers", "supplier_name", _SEG3, f"(SELECT * FROM ({segment_sql('supplier_name', 40)}) "
              "ORDER BY ontime_rate_pct, total_bookings DESC, supplier_name LIMIT 5)"),
        _long("customer", "customer_name", _SEG3 + ["ontime_bookings"],
              f"(SELECT * FROM ({segment_sql('customer_name', 30)}) WHERE customer_name ILIKE '%{CUSTOMER_PATTERN}%' "
              "ORDER BY total_bookings DESC, customer_name LIMIT 1)"),
        _long("material", "material_group", ["bookings", "median_trip_days", "p90_trip_days", "ontime_rate",
                                             "avg_delay_h"], f"(SELECT * FROM {MAT_SQL} WHERE material_group = '{MATERIAL}')"),
        _long("peak_month", "booking_month", ["bookings", "late_rate_pct", "avg_delay_h"],
              f"(SELECT * FROM {MONTHLY_SQL} ORDER BY late_rate_pct DESC, booking_month LIMIT 1)"),
        _long("cohorts", "NULL", ["detour_high_ot", "detour_low_ot", "long_haul_ot", "short_haul_ot", "market_ot",
                                  "regular_ot"], COH),
    ])
)
