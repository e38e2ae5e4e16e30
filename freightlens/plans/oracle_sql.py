"""DuckDB SQL twins of the Spark plans (the correctness oracle).

The CTE chain below re-derives the shipment rows from the driver tables,
cleans and enriches them exactly as the Spark operators do, written
independently in plain SQL.  Every floating output is rounded with
``round(x + 1e-9, n)`` on both sides.
"""

from __future__ import annotations


def hours(a: str, b: str) -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 3600000000.0e0)"


def clip0(x: str) -> str:
    return f"(CASE WHEN ({x}) < 0 THEN 0.0e0 ELSE ({x}) END)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    )
    return f"(2 * 6371.0e0 * asin(sqrt(CASE WHEN {a} > 1 THEN 1.0e0 ELSE {a} END)))"


def band(d: str) -> str:
    return (
        f"(CASE WHEN {d} IS NULL OR {d} < 0 THEN NULL WHEN {d} <= 100 THEN '0-100km' "
        f"WHEN {d} <= 300 THEN '100-300km' WHEN {d} <= 600 THEN '300-600km' "
        f"WHEN {d} <= 1200 THEN '600-1200km' ELSE '1200km+' END)"
    )


def band_ord(d: str) -> str:
    return (
        f"(CASE WHEN {d} IS NULL OR {d} < 0 THEN NULL WHEN {d} <= 100 THEN 0 WHEN {d} <= 300 THEN 1 "
        f"WHEN {d} <= 600 THEN 2 WHEN {d} <= 1200 THEN 3 ELSE 4 END)"
    )


def ord_label(o: str) -> str:
    return (
        f"(CASE {o} WHEN 0 THEN '0-100km' WHEN 1 THEN '100-300km' WHEN 2 THEN '300-600km' "
        f"WHEN 3 THEN '600-1200km' WHEN 4 THEN '1200km+' END)"
    )


def rnd(x: str, n: int = 4) -> str:
    return f"round(({x}) + 1e-9, {n})"


def addh(ts: str, h: str) -> str:
    return f"({ts} + to_hours(CAST({h} AS BIGINT)))"


def s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


RAW = f"""
raw AS (
  SELECT
    'G' || {s('l.l_suppkey % 3')} AS gps_provider,
    {s('l.l_orderkey')} || '-' || {s('l.l_linenumber')} AS booking_id,
    CASE WHEN l.l_orderkey % 5 = 0 THEN 'Market' ELSE 'Regular' END AS shipment_type,
    {addh('l.l_shipdate', '-((l.l_partkey * 7) % 121 - 30)')} AS booking_date,
    'R' || {s('l.l_partkey % 500')} AS vehicle_registration,
    sn.n_name AS origin_location,
    cn.n_name AS destination_location,
    CAST(8.0e0 + sn.n_nationkey AS DOUBLE) AS origin_lat,
    CAST(68.0e0 + sn.n_nationkey AS DOUBLE) AS origin_lon,
    CAST(9.5e0 + cn.n_nationkey AS DOUBLE) AS dest_lat,
    CAST(68.5e0 + (cn.n_nationkey * 7) % 25 AS DOUBLE) AS dest_lon,
    {addh('l.l_shipdate', '(l.l_partkey * l.l_linenumber) % 200')} AS gps_ping_time,
    {addh('l.l_shipdate', '(l.l_partkey * 3 + CAST(l.l_quantity AS BIGINT)) % 240')} AS planned_eta,
    CASE WHEN p.p_size % 7 = 0 THEN NULL ELSE cn.n_name END AS current_location,
    CASE WHEN l.l_orderkey % 17 = 0 THEN NULL ELSE
      {addh('l.l_shipdate', '(l.l_orderkey * 11 + l.l_suppkey) % (CASE WHEN l.l_partkey % 53 = 0 THEN 2400 ELSE 360 END)')}
    END AS actual_eta,
    CASE WHEN p.p_size % 13 = 0 THEN NULL ELSE (9.5e0 + cn.n_nationkey) - l.l_linenumber * 0.3e0 END AS current_lat,
    CASE WHEN p.p_size % 13 = 0 THEN NULL ELSE (68.5e0 + (cn.n_nationkey * 7) % 25) - l.l_linenumber * 0.2e0 END AS current_lon,
    CASE l.l_returnflag WHEN 'A' THEN ' YES ' WHEN 'R' THEN 'no' ELSE NULL END AS ontime_flag,
    CAST(l.l_shipdate AS TIMESTAMP) AS trip_start,
    CASE WHEN l.l_partkey % 29 = 0 THEN NULL ELSE
      {addh('l.l_shipdate', '(l.l_suppkey * 13 + l.l_orderkey * 5) % 400 - 4')} END AS trip_end,
    CASE WHEN l.l_partkey % 41 = 0 THEN NULL ELSE l.l_extendedprice / 50 END AS distance_km,
    CASE WHEN (l.l_suppkey + l.l_partkey) % 6 = 0 THEN NULL ELSE 'V' || {s('p.p_size % 5')} END AS vehicle_type,
    CASE WHEN p.p_size % 11 = 0 THEN NULL ELSE 100.0e0 + (p.p_size % 4) * 75.0e0 END AS min_daily_km,
    CASE WHEN l.l_suppkey % 9 = 0 THEN NULL ELSE 'D' || {s('l.l_suppkey % 50')} END AS driver_name,
    'M' || {s('l.l_suppkey % 50')} AS driver_mobile,
    CASE c.c_custkey % 3
      WHEN 0 THEN c.c_mktsegment || '-' || {s('c.c_nationkey % 5')}
      WHEN 1 THEN c.c_mktsegment || '-N' || {s('c.c_nationkey')}
      ELSE c.c_name END AS customer_name,
    su.s_name AS supplier_name,
    p.p_name AS material_shipped,
    l.l_partkey AS t1, l.l_suppkey AS t2, l.l_quantity AS t3, l.l_extendedprice AS t4,
    l.l_discount AS t5, l.l_tax AS t6
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN supplier su ON l.l_suppkey = su.s_suppkey
  JOIN nation sn ON su.s_nationkey = sn.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

_FLAG = "trim(ontime_flag, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
_TITLE = f"(upper(substr({_FLAG}, 1, 1)) || lower(substr({_FLAG}, 2)))"

CLEAN = f"""
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY booking_id
      ORDER BY (actual_eta IS NULL), gps_ping_time DESC NULLS LAST, trip_start ASC NULLS LAST,
               t1, t2, t3, t4, t5, t6) AS rn
    FROM raw) WHERE rn = 1
),
c0 AS (
  SELECT * REPLACE (CASE WHEN {_TITLE} = 'Nan' THEN NULL ELSE {_TITLE} END AS ontime_flag)
  FROM dedup
),
c1 AS (
  SELECT *, CASE WHEN ontime_flag = 'Yes' THEN 1 ELSE 0 END AS is_ontime,
         {band('distance_km')} AS distance_band
  FROM c0
),
band_modes AS (
  SELECT distance_band, vehicle_type AS band_vehicle FROM (
    SELECT distance_band, vehicle_type,
           row_number() OVER (PARTITION BY distance_band ORDER BY count(*) DESC, vehicle_type) AS rn
    FROM c1 WHERE vehicle_type IS NOT NULL AND distance_band IS NOT NULL
    GROUP BY distance_band, vehicle_type) WHERE rn = 1
),
c2 AS (
  SELECT c1.* REPLACE (coalesce(c1.vehicle_type, m.band_vehicle) AS vehicle_type),
         (c1.vehicle_type IS NULL AND m.band_vehicle IS NOT NULL) AS vehicle_type_imputed
  FROM c1 LEFT JOIN band_modes m ON c1.distance_band = m.distance_band
),
c3 AS (
  SELECT *,
    coalesce({hours('trip_end', 'trip_start')} / 24 < 0 OR {hours('trip_end', 'trip_start')} / 24 > 90, false) AS m_trip,
    coalesce(abs({hours('actual_eta', 'planned_eta')}) > 720, false) AS m_delay,
    coalesce({hours('trip_start', 'booking_date')} < -24, false) AS m_wait
  FROM c2
),
clean AS (
  SELECT * EXCLUDE (m_trip, m_delay, m_wait) REPLACE (
    CASE WHEN m_trip THEN NULL ELSE trip_end END AS trip_end,
    CASE WHEN m_delay THEN NULL ELSE actual_eta END AS actual_eta,
    CASE WHEN m_wait THEN trip_start ELSE booking_date END AS booking_date)
  FROM c3
)"""

FEATURES = f"""
f0 AS (
  SELECT *,
    {clip0(hours('trip_start', 'booking_date'))} AS wait_hours,
    {clip0(hours('trip_end', 'trip_start'))} AS moving_hours,
    {hours('actual_eta', 'planned_eta')} AS delay_hours,
    {clip0(hours('actual_eta', 'trip_end'))} AS unloading_hours,
    coalesce(origin_location, 'nan') || ' → ' || coalesce(destination_location, 'nan') AS route_id,
    {hav('origin_lat', 'origin_lon', 'dest_lat', 'dest_lon')} AS geo_distance_km,
    {band_ord('distance_km')} AS band_ord,
    CASE WHEN distance_km <= 150 THEN 'short_haul' WHEN distance_km <= 600 THEN 'mid_haul'
         ELSE 'long_haul' END AS route_category,
    coalesce(strftime(booking_date, '%Y-%m'), 'NaT') AS booking_month,
    dayname(booking_date) AS booking_dow,
    CASE WHEN min_daily_km > 0 AND distance_km IS NOT NULL THEN distance_km / min_daily_km END AS expected_days,
    {hours('gps_ping_time', 'trip_start')} AS gps_ping_lag_hours,
    {hav('current_lat', 'current_lon', 'dest_lat', 'dest_lon')} AS gps_position_drift_km
  FROM clean
),
f1 AS (
  SELECT *,
    moving_hours / 24 AS trip_days,
    CASE WHEN delay_hours > 0 THEN 1 ELSE 0 END AS is_late,
    CASE WHEN moving_hours > 0 THEN distance_km / moving_hours END AS avg_speed_kmph,
    CASE WHEN moving_hours / 24 > 0 THEN distance_km / (moving_hours / 24) END AS km_per_day,
    CASE WHEN geo_distance_km > 0 AND distance_km IS NOT NULL THEN distance_km / geo_distance_km END
      AS route_detour_ratio,
    {clip0('moving_hours / 24 - expected_days')} AS idle_days_proxy
  FROM f0
),
mat_top AS (
  SELECT material_shipped FROM f1 WHERE material_shipped IS NOT NULL
  GROUP BY material_shipped ORDER BY count(*) DESC, material_shipped LIMIT 15
),
spec AS (
  SELECT supplier_name, band_ord AS spec_ord FROM (
    SELECT supplier_name, band_ord,
           row_number() OVER (PARTITION BY supplier_name ORDER BY count(*) DESC, band_ord) AS rn
    FROM f1 WHERE supplier_name IS NOT NULL AND band_ord IS NOT NULL
    GROUP BY supplier_name, band_ord) WHERE rn = 1
),
cust AS (
  SELECT customer_name, count(*) AS cust_n FROM f1 WHERE customer_name IS NOT NULL GROUP BY customer_name
),
enriched AS (
  SELECT f1.*,
    CASE WHEN mt.material_shipped IS NOT NULL THEN f1.material_shipped ELSE 'Other' END AS material_group,
    {ord_label('sp.spec_ord')} AS supplier_specialization,
    CASE WHEN coalesce(cu.cust_n, 0) >= 200 THEN 'enterprise'
         WHEN coalesce(cu.cust_n, 0) >= 50 THEN 'mid_market' ELSE 'long_tail' END AS customer_tier
  FROM f1
  LEFT JOIN mat_top mt ON f1.material_shipped = mt.material_shipped
  LEFT JOIN spec sp ON f1.supplier_name = sp.supplier_name
  LEFT JOIN cust cu ON f1.customer_name = cu.customer_name
)"""


def _extra(ctes: str) -> str:
    return f",\n{ctes}" if ctes else ""


def with_enriched(body: str, ctes: str = "") -> str:
    """``body`` runs over the CTE ``enriched``; ``ctes`` adds more CTEs."""
    return f"WITH {RAW},{CLEAN},{FEATURES}{_extra(ctes)}\n{body}"


def with_clean(body: str, ctes: str = "") -> str:
    return f"WITH {RAW},{CLEAN}{_extra(ctes)}\n{body}"


def with_raw(body: str, ctes: str = "") -> str:
    return f"WITH {RAW}{_extra(ctes)}\n{body}"


# Segment measures (A2) in SQL.
SEG_MEASURES = f"""
    count(booking_id) AS total_bookings,
    CAST(coalesce(sum(is_ontime), 0) AS BIGINT) AS ontime_bookings,
    {rnd('avg(is_ontime)')} AS ontime_rate,
    {rnd('avg(trip_days)')} AS avg_trip_days,
    {rnd('avg(delay_hours)')} AS avg_delay_hours,
    {rnd('avg(distance_km)')} AS avg_distance_km,
    {rnd('avg(wait_hours)')} AS avg_wait_hours,
    {rnd('avg(avg_speed_kmph)')} AS avg_speed_kmph,
    {rnd('avg(idle_days_proxy)')} AS avg_idle_days,
    {rnd(rnd('avg(is_ontime) * 100', 2))} AS ontime_rate_pct"""


def segment_sql(keys: str, min_n: int, src: str = "enriched") -> str:
    return f"SELECT {keys},{SEG_MEASURES}\nFROM {src} GROUP BY {keys} HAVING count(booking_id) >= {min_n}"
