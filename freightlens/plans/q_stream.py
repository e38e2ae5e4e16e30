"""Registered streaming queries (D1-D10) and their batch twins.

Each streaming key runs a real Structured Streaming query (``availableNow``)
into Parquet under the checkpoint folder and returns the written result.
Stateful keys run over a live feed derived from ``events``: four batches of
messages with pings out of order, too late and sent again, the query
restarted from its checkpoint for each.  The twin's SQL states which pings
the watermark lets through and which it has passed at the end.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import geofence as GF
from ..sources import fixtures
from ..session import materialize
from ..streaming import pings as S
from ..streaming.latest import latest_position_table, positions
from . import context as ctx
from .common import rounded
from .oracle_sql import hav, hours, rnd, with_raw
from .q_gps import FEED_CTE, PINGS_CTE, wsql

Q: dict = {}
SQL: dict = {}


def _stream_table(spark: SparkSession, sf_dir: str, name: str):
    base = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    # A single-file table as a stream source: a glob that matches just that
    # file (a plain file path is not accepted as a stream folder).
    return spark.readStream.schema(schema).parquet(f"{base}/{name}.parque[t]")


def _stream_pings(spark, sf_dir):
    return fixtures.gps_pings(spark, sf_dir, events=_stream_table(spark, sf_dir, "events"))


def _us(c):
    return F.unix_micros(F.col(c)).alias(f"{c}_us")


# --- the live feed: messages in batches, some late, some sent again ---------------------
#: A booking that is silent for so long starts a new trip in the registered streams.
EXPIRE_HOURS = 24.0


def _feed(spark, sf_dir):
    messages = materialize(fixtures.ping_feed(spark, sf_dir), "feed")
    return [messages.where(F.col("batch") == b) for b in range(fixtures.FEED_BATCHES)]


def _pings_of(messages):
    """Parsed, validated, one ping for each booking and time."""
    return S.dedupe_stream(S.parse_payload(messages))


def _run(spark, sf_dir, build, name):
    return S.run_feed(spark, _feed(spark, sf_dir), build, name)[0]


# The watermark of batch b is the latest time sent in the batches before, less an hour; a ping up to it is too late.
# ``ripe``: what the last watermark has passed.
ACCEPTED_CTE = FEED_CTE + f""",
marks AS (SELECT m.b, (max(us) // 1000) * 1000 - 3600000000 AS w FROM range(0, {fixtures.FEED_BATCHES + 1}) AS m(b) LEFT JOIN valid v ON v.b < m.b GROUP BY m.b),
acc AS (SELECT DISTINCT booking_id, gps_ping_time, us, current_lat, current_lon, gps_provider
  FROM valid JOIN marks USING (b) WHERE w IS NULL OR us > w),
ripe AS (SELECT acc.* FROM acc, marks WHERE marks.b = {fixtures.FEED_BATCHES} AND us <= w)"""

LIVE_CTE = ACCEPTED_CTE + f""",
live0 AS (SELECT *, lag(us) OVER o AS pus, lag(gps_ping_time) OVER o AS pt, lag(current_lat) OVER o AS plat, lag(current_lon) OVER o AS plon
  FROM ripe WINDOW o AS (PARTITION BY booking_id ORDER BY us)),
live1 AS (SELECT * EXCLUDE (pus, pt, plat, plon), CASE WHEN us - pus <= 86400000000 THEN pt END AS prev_time,
  CASE WHEN us - pus <= 86400000000 THEN plat END AS prev_lat, CASE WHEN us - pus <= 86400000000 THEN plon END AS prev_lon FROM live0),
live2 AS (SELECT *, {hours('gps_ping_time', 'prev_time')} AS delta_hours,
  {hav('prev_lat', 'prev_lon', 'current_lat', 'current_lon')} AS segment_km FROM live1),
live AS (SELECT *, CASE WHEN delta_hours > 0 THEN segment_km / delta_hours END AS segment_speed_kmph,
  coalesce(CASE WHEN delta_hours > 0 THEN segment_km / delta_hours END < 2 AND delta_hours >= 2, false) AS is_idle_segment FROM live2)"""


# --- D1/D2 --------------------------------------------------------------------------
def stream_dedupe(spark, sf_dir):
    out = _run(spark, sf_dir, _pings_of, "dedupe")
    return rounded(out.select("booking_id", _us("gps_ping_time"), "current_lat", "current_lon", "gps_provider"))


Q["stream_dedupe"] = stream_dedupe
SQL["stream_dedupe"] = wsql(
    f"""SELECT booking_id, us AS gps_ping_time_us, {rnd('current_lat')} AS current_lat, {rnd('current_lon')} AS current_lon,
  gps_provider FROM acc""",
    ACCEPTED_CTE,
)


def stream_late_rows(spark, sf_dir):
    """How many messages came after the watermark had passed their time."""
    late = S.run_feed(spark, _feed(spark, sf_dir), _pings_of, "late")[1]
    return spark.range(1).select(F.lit(late).cast("long").alias("late_rows"))


Q["stream_late_rows"] = stream_late_rows
SQL["stream_late_rows"] = wsql("SELECT count(*) AS late_rows FROM valid JOIN marks USING (b) WHERE us <= w", ACCEPTED_CTE)


# --- D4 -----------------------------------------------------------------------------
def stream_idle(spark, sf_dir):
    out = _run(spark, sf_dir, lambda m: S.live_segments(_pings_of(m), watermark=None, expire_hours=EXPIRE_HOURS), "segments")
    return rounded(out.select("booking_id", _us("gps_ping_time"), "delta_hours", "segment_km", "segment_speed_kmph",
                              "is_idle_segment"))


Q["stream_idle"] = stream_idle
SQL["stream_idle"] = wsql(
    f"""SELECT booking_id, us AS gps_ping_time_us, {rnd('delta_hours')} AS delta_hours, {rnd('segment_km')} AS segment_km,
  {rnd('segment_speed_kmph')} AS segment_speed_kmph, is_idle_segment FROM live""",
    LIVE_CTE,
)


# --- D5 -----------------------------------------------------------------------------
def _fences(spark, sf_dir):
    return GF.depot_fences(ctx.pings(spark, sf_dir), 3.0)


def geofence_events(spark, sf_dir):
    ev = GF.geofence_events(ctx.pings(spark, sf_dir), _fences(spark, sf_dir))
    return ev.select("booking_id", _us("gps_ping_time"), "ping_seq", "event_type", "fence_id")


def stream_geofence(spark, sf_dir):
    fences = materialize(_fences(spark, sf_dir), "fences")
    out = _run(spark, sf_dir, lambda m: S.live_geofence(_pings_of(m), fences, watermark=None, expire_hours=EXPIRE_HOURS), "geofence")
    return out.select("booking_id", _us("gps_ping_time"), "event_type", "fence_id")


_FENCES_CTE = f""",
fences AS (SELECT 'depot-' || booking_id AS fid, current_lat AS flat, current_lon AS flon FROM (
  SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY gps_ping_time, ping_seq) AS rn FROM pings
  WHERE current_lat IS NOT NULL AND current_lon IS NOT NULL AND booking_id IS NOT NULL AND gps_ping_time IS NOT NULL) WHERE rn = 1)"""


def _nearest_cte(rows: str, key: str) -> str:
    """best: the nearest fence within 3 km of each row."""
    d = hav("p.current_lat", "p.current_lon", "f.flat", "f.flon")
    return f""",
cand AS (SELECT p.booking_id, p.{key}, f.fid, {d} AS d
  FROM {rows} p JOIN fences f ON abs(p.current_lat - f.flat) < 0.1 AND abs(p.current_lon - f.flon) < 0.2),
best AS (SELECT booking_id, {key}, fid FROM (
  SELECT *, row_number() OVER (PARTITION BY booking_id, {key} ORDER BY d, fid) AS rn FROM cand WHERE d <= 3.0) WHERE rn = 1)"""


_EVENTS = """SELECT booking_id, epoch_us(gps_ping_time) AS gps_ping_time_us, {more}event_type, fence_id FROM (
  SELECT *, 'exit' AS event_type, prev_fence AS fence_id FROM gf WHERE prev_fence IS NOT NULL AND fence IS DISTINCT FROM prev_fence
  UNION ALL
  SELECT *, 'enter', fence FROM gf WHERE fence IS NOT NULL AND fence IS DISTINCT FROM prev_fence)"""
Q["geofence_events"] = geofence_events
SQL["geofence_events"] = wsql(
    _EVENTS.format(more="ping_seq, "),
    PINGS_CTE + _FENCES_CTE + """,
vp AS (SELECT * FROM pings WHERE current_lat IS NOT NULL AND current_lon IS NOT NULL AND booking_id IS NOT NULL)"""
    + _nearest_cte("vp", "ping_seq") + """,
gf AS (SELECT vp.booking_id, vp.gps_ping_time, vp.ping_seq, b.fid AS fence, lag(b.fid) OVER (
    PARTITION BY vp.booking_id ORDER BY vp.gps_ping_time ASC NULLS LAST, vp.ping_seq) AS prev_fence
  FROM vp LEFT JOIN best b ON vp.booking_id = b.booking_id AND vp.ping_seq = b.ping_seq)""",
)
FENCED_CTE = LIVE_CTE + _FENCES_CTE + _nearest_cte("live", "us") + """,
gf AS (SELECT live.*, b.fid AS fence, CASE WHEN live.prev_time IS NOT NULL THEN lag(b.fid) OVER (
    PARTITION BY live.booking_id ORDER BY live.us) END AS prev_fence
  FROM live LEFT JOIN best b ON live.booking_id = b.booking_id AND live.us = b.us)"""
Q["stream_geofence"] = stream_geofence
SQL["stream_geofence"] = wsql(_EVENTS.format(more=""), FENCED_CTE)


# --- D1 -> D2 -> D5 -> D4 -> D3 -> D6 -> D8 in one query ----------------------------------
RULES = [
    S.AlertRule("IDLE", "idle", (("segment_speed_kmph", "<", 2.0), ("delta_hours", ">=", 2.0))),
    S.AlertRule("FAST_AND_LONG", "speed", (("segment_speed_kmph", ">", 10.0), ("delta_hours", ">", 1.0))),
    S.AlertRule("LATE", "delay", (("slack_hours", "<", 0.0),)),
]


def _live_chain(spark, sf_dir):
    fences = materialize(_fences(spark, sf_dir), "fences")
    context = materialize(fixtures.booking_context(spark, sf_dir), "booking-context")

    def build(messages):
        near = S.near_fences(_pings_of(messages), fences)
        return S.with_delay(S.enrich(S.with_motion(S.live_trips(near, EXPIRE_HOURS)), context))

    return build


def stream_enriched(spark, sf_dir):
    out = _run(spark, sf_dir, _live_chain(spark, sf_dir), "enriched")
    return rounded(out.select("booking_id", _us("gps_ping_time"), "delta_hours", "segment_km", "is_idle_segment", "fence_id", "version",
                              "customer_name", "remaining_hours", _us("predicted_arrival"), "is_delayed", "slack_hours"))


_REM_LIVE = f"CASE WHEN min_daily_km / 24 > 0 THEN {hav('current_lat', 'current_lon', 'dest_lat', 'dest_lon')} / (min_daily_km / 24) END"
ENRICHED_CTE = FENCED_CTE + f""",
context AS (SELECT 'U' || CAST(c_custkey AS VARCHAR) AS booking_id, CAST(v + 1 AS INTEGER) AS version,
    CASE v WHEN 0 THEN TIMESTAMP '1970-01-01' ELSE TIMESTAMP '2024-01-15' END AS valid_from,
    CASE v WHEN 0 THEN TIMESTAMP '2024-01-15' ELSE TIMESTAMP '9999-01-01' END AS valid_to,
    'C' || CAST(c_custkey AS VARCHAR) AS customer_name, 9.5e0 + (c_nationkey + v) % 25 AS dest_lat,
    68.5e0 + (c_nationkey * 7) % 25 AS dest_lon, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 100.0e0 + (c_custkey % 4) * 75.0e0 END AS min_daily_km,
    TIMESTAMP '2024-01-08' + to_hours(CAST((c_custkey % 20) * 24 + v * 48 AS BIGINT)) AS planned_eta
  FROM customer, range(0, 2) AS r(v)),
enr0 AS (SELECT gf.*, c.* EXCLUDE (booking_id), {_REM_LIVE} AS rem FROM gf LEFT JOIN context c
  ON gf.booking_id = c.booking_id AND gf.gps_ping_time >= c.valid_from AND gf.gps_ping_time < c.valid_to),
enr AS (SELECT *, us + CAST(trunc(rem * 3600000000.0e0) AS BIGINT) AS pa,
  (epoch_us(planned_eta) - (us + CAST(trunc(rem * 3600000000.0e0) AS BIGINT))) / 3600000000.0e0 AS slack_hours FROM enr0),
raised AS (
  SELECT *, 'IDLE' AS rule_id, 'idle' AS kind, NULL AS detail FROM enr WHERE segment_speed_kmph < 2 AND delta_hours >= 2
  UNION ALL SELECT *, 'FAST_AND_LONG', 'speed', NULL FROM enr WHERE segment_speed_kmph > 10 AND delta_hours > 1
  UNION ALL SELECT *, 'LATE', 'delay', NULL FROM enr WHERE slack_hours < 0
  UNION ALL SELECT *, 'IN_FENCE', 'geofence', fence FROM enr WHERE fence IS NOT NULL)"""
Q["stream_enriched"] = stream_enriched
SQL["stream_enriched"] = wsql(
    f"""SELECT booking_id, us AS gps_ping_time_us, {rnd('delta_hours')} AS delta_hours, {rnd('segment_km')} AS segment_km, is_idle_segment,
  fence AS fence_id, version, customer_name, {rnd('rem')} AS remaining_hours, pa AS predicted_arrival_us,
  coalesce(pa > epoch_us(planned_eta), false) AS is_delayed, {rnd('slack_hours')} AS slack_hours FROM enr""",
    ENRICHED_CTE,
)


def _alert_log(spark, sf_dir):
    chain = _live_chain(spark, sf_dir)
    return _run(spark, sf_dir, lambda m: S.live_alerts(chain(m), RULES), "alert-log")


def stream_alert_feed(spark, sf_dir):
    """All alerts of all pings."""
    out = _alert_log(spark, sf_dir).select("booking_id", _us("gps_ping_time"), F.explode("alerts").alias("a"))
    return out.select("booking_id", "gps_ping_time_us", "a.*")


def stream_active_alerts(spark, sf_dir):
    """The alerts that hold now."""
    return S.active_alerts(_alert_log(spark, sf_dir)).select("booking_id", _us("gps_ping_time"), "rule_id", "kind", "detail")


Q["stream_alert_feed"] = stream_alert_feed
SQL["stream_alert_feed"] = wsql("SELECT booking_id, us AS gps_ping_time_us, rule_id, kind, detail FROM raised", ENRICHED_CTE)
Q["stream_active_alerts"] = stream_active_alerts
SQL["stream_active_alerts"] = wsql(
    """SELECT booking_id, us AS gps_ping_time_us, rule_id, kind, detail FROM raised
WHERE us = (SELECT max(us) FROM enr WHERE enr.booking_id = raised.booking_id)""",
    ENRICHED_CTE,
)


# --- D6 -----------------------------------------------------------------------------
def _delay_out(df):
    return rounded(df.select("booking_id", _us("gps_ping_time"), "remaining_hours", _us("predicted_arrival"),
                             "is_delayed", "slack_hours"))


Q["delay_alerts"] = lambda spark, sf_dir: _delay_out(GF.delay_alerts(ctx.raw(spark, sf_dir)))


def stream_delay_alerts(spark, sf_dir):
    snaps = fixtures.shipments(spark, sf_dir, lineitem=_stream_table(spark, sf_dir, "lineitem"))
    return _delay_out(S.run_append(S.live_delay_alerts(snaps), "delay"))


Q["stream_delay_alerts"] = stream_delay_alerts
_REM = f"CASE WHEN min_daily_km / 24 > 0 THEN {hav('current_lat', 'current_lon', 'dest_lat', 'dest_lon')} / (min_daily_km / 24) END"
DELAY_SQL = with_raw(
    f"""SELECT booking_id, epoch_us(gps_ping_time) AS gps_ping_time_us, {rnd('rem')} AS remaining_hours,
  pa AS predicted_arrival_us, coalesce(pa > epoch_us(planned_eta), false) AS is_delayed,
  {rnd('(epoch_us(planned_eta) - pa) / 3600000000.0e0')} AS slack_hours
FROM (SELECT *, epoch_us(gps_ping_time) + CAST(trunc(rem * 3600000000.0e0) AS BIGINT) AS pa
      FROM (SELECT *, {_REM} AS rem FROM raw))"""
)
SQL["delay_alerts"] = DELAY_SQL
SQL["stream_delay_alerts"] = DELAY_SQL


# --- D7 -----------------------------------------------------------------------------
def stream_latest(spark, sf_dir):
    table = latest_position_table(spark, S.scratch_folder(spark, "latest"), merge_every=3)
    S.run_feed(spark, _feed(spark, sf_dir), lambda m: positions(_pings_of(m)), "latest", table.upsert)
    return rounded(table.read().select("booking_id", _us("last_ping_time"), "lat", "lon", "pings"))


Q["stream_latest"] = stream_latest
SQL["stream_latest"] = wsql(
    f"""SELECT booking_id, us AS last_ping_time_us, {rnd('current_lat')} AS lat, {rnd('current_lon')} AS lon, n AS pings FROM (
  SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY us DESC) AS rn, count(*) OVER (PARTITION BY booking_id) AS n FROM acc)
WHERE rn = 1""",
    ACCEPTED_CTE,
)

# --- D8 -----------------------------------------------------------------------------
# Alert thresholds (a parameter table, not data).
ALERT_RULES = [("SPEED_HIGH", "segment_speed_kmph", ">", 80.0), ("GPS_GAP", "delta_hours", ">", 6.0),
               ("LONG_JUMP", "segment_km", ">", 100.0)]


def stream_alerts(spark, sf_dir):
    rules = spark.createDataFrame(ALERT_RULES, "rule_id string, metric string, op string, threshold double")
    out = _run(spark, sf_dir, lambda m: S.alerts(S.live_segments(_pings_of(m), watermark=None, expire_hours=EXPIRE_HOURS), rules), "alerts")
    return rounded(out.select("rule_id", "booking_id", _us("gps_ping_time"), "metric", "value", "threshold"))


Q["stream_alerts"] = stream_alerts
SQL["stream_alerts"] = wsql(
    f"""SELECT r.rule_id, m.booking_id, epoch_us(m.gps_ping_time) AS gps_ping_time_us, m.metric, {rnd('m.value')} AS value,
  {rnd('r.threshold')} AS threshold
FROM (SELECT booking_id, gps_ping_time, 'segment_speed_kmph' AS metric, segment_speed_kmph AS value FROM live
      UNION ALL SELECT booking_id, gps_ping_time, 'delta_hours', delta_hours FROM live
      UNION ALL SELECT booking_id, gps_ping_time, 'segment_km', segment_km FROM live) m
JOIN (VALUES {', '.join(f"('{a}', '{b}', '{c}', {d}e0)" for a, b, c, d in ALERT_RULES)}) AS r(rule_id, metric, op, threshold)
  ON m.metric = r.metric
WHERE m.value IS NOT NULL AND m.value > r.threshold""",
    LIVE_CTE,
)


# --- D9 -----------------------------------------------------------------------------
def stream_windows(spark, sf_dir):
    keys = ["kind", "start", "gps_provider"]
    t = S.run_update(S.fleet_windows(_stream_pings(spark, sf_dir)), "tumbling", keys)
    s = S.run_update(S.sliding_windows(_stream_pings(spark, sf_dir)), "sliding", keys)
    t = t.select("kind", "start", "end", "gps_provider", "pings")
    return t.unionByName(s).select("kind", _us("start"), _us("end"), "gps_provider", "pings")


_VP = ("SELECT * FROM pings WHERE booking_id IS NOT NULL AND gps_ping_time IS NOT NULL "
       "AND current_lat BETWEEN -90 AND 90 AND current_lon BETWEEN -180 AND 180")
Q["stream_windows"] = stream_windows
SQL["stream_windows"] = wsql(
    f"""SELECT 'tumbling_1h' AS kind, epoch_us(date_trunc('hour', gps_ping_time)) AS start_us,
  epoch_us(date_trunc('hour', gps_ping_time)) + 3600000000 AS end_us, gps_provider, count(*) AS pings
FROM ({_VP}) GROUP BY 2, 3, 4
UNION ALL
SELECT 'sliding_1h_15m', s AS start_us, s + 3600000000 AS end_us, gps_provider, count(*) FROM (
  SELECT gps_provider, epoch_us(gps_ping_time) - (epoch_us(gps_ping_time) % 900000000) - k * 900000000 AS s
  FROM ({_VP}), range(0, 4) AS t(k)) GROUP BY 2, 3, 4""",
    PINGS_CTE,
)


def stream_sessions(spark, sf_dir):
    out = S.run_update(S.trip_sessions(_stream_pings(spark, sf_dir)), "sessions", ["booking_id", "session_start"],
                       mode="complete")
    return out.select("booking_id", _us("session_start"), _us("session_end"), "pings")


Q["stream_sessions"] = stream_sessions
SQL["stream_sessions"] = wsql(
    f"""SELECT booking_id, epoch_us(min(gps_ping_time)) AS session_start_us,
  epoch_us(max(gps_ping_time)) + 7200000000 AS session_end_us, count(*) AS pings FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(gps_ping_time) - epoch_us(prev) >= 7200000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY booking_id ORDER BY gps_ping_time, ping_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
  FROM (SELECT *, lag(gps_ping_time) OVER (PARTITION BY booking_id ORDER BY gps_ping_time, ping_seq) AS prev
        FROM ({_VP})))
GROUP BY booking_id, sid""",
    PINGS_CTE,
)


# --- D10 ------------------------------------------------------------------------------
def _lag_windows(spark, sf_dir):
    return S.run_update(S.ingest_lag(_stream_pings(spark, sf_dir)), "ingest_lag", ["start"])


def ingest_lag(spark, sf_dir):
    return rounded(_lag_windows(spark, sf_dir).select(_us("start"), _us("end"), "pings", "p50_lag_s", "p95_lag_s", "max_lag_s",
                                                      "late_ingest_alerts"))


def ingest_lag_by_day(spark, sf_dir):
    """Hourly sketches merged by day; the quantiles' ranks are compared with exact ones."""
    days = S.merged_lag(_lag_windows(spark, sf_dir), F.to_date("start").alias("day"))
    lag = S.validate(ctx.pings(spark, sf_dir)).select(F.to_date("gps_ping_time").alias("day"), S.lag_seconds().alias("lag_s"))
    out = [F.count(F.lit(1)).alias("n")]
    for q in ("p50", "p95"):
        out += [F.count_if(F.col("lag_s") < F.col(f"{q}_lag_s")).alias(f"{q}_below"), F.count_if(F.col("lag_s") <= F.col(f"{q}_lag_s")).alias(f"{q}_upto")]
    ranks = lag.join(days, "day").groupBy("day", "pings", "max_lag_s", "late_ingest_alerts").agg(*out)
    ok = lambda q, p: (F.col(f"{q}_below") <= (p + S.LAG_RANK_ERROR) * F.col("n")) & (F.col(f"{q}_upto") >= (p - S.LAG_RANK_ERROR) * F.col("n"))
    return rounded(ranks.select(F.col("day").cast("string").alias("day"), "pings", "max_lag_s", "late_ingest_alerts", ok("p50", 0.5).alias("p50_within"),
                                ok("p95", 0.95).alias("p95_within")))


Q["ingest_lag"] = ingest_lag
Q["ingest_lag_by_day"] = ingest_lag_by_day
SQL["ingest_lag_by_day"] = wsql(
    f"""SELECT CAST(CAST(gps_ping_time AS DATE) AS VARCHAR) AS day, count(*) AS pings, {rnd('max(lag_s)')} AS max_lag_s,
  count(*) FILTER (WHERE lag_s > 60) AS late_ingest_alerts, true AS p50_within, true AS p95_within
FROM (SELECT *, (epoch_us(ingest_ts) - epoch_us(gps_ping_time)) / 1000000.0e0 AS lag_s FROM ({_VP})) GROUP BY 1""",
    PINGS_CTE,
)
