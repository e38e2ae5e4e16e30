"""Registered queries: GPS (G1-G9) with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gps as G
from ..sources import fixtures
from ..streaming.pings import parse_payload
from . import context as ctx
from .common import rounded
from .oracle_sql import hav, hours, rnd, with_enriched

Q: dict = {}
SQL: dict = {}

PINGS_CTE = """pings AS (
  SELECT 'U' || CAST(user_id AS VARCHAR) AS booking_id, CAST(ts AS TIMESTAMP) AS gps_ping_time,
    CASE WHEN event_id % 101 = 0 THEN NULL ELSE 10.0e0 + (user_id % 1000) * 0.05e0
      + CASE WHEN event_type IN ('view', 'signup') THEN 0.0e0 ELSE (event_id % 50) * 0.04e0 END END AS current_lat,
    70.0e0 + (user_id % 1000) * 0.05e0 AS current_lon,
    'G' || CAST(user_id % 3 AS VARCHAR) AS gps_provider,
    CAST(ts AS TIMESTAMP) + to_seconds(CAST(event_id % 120 AS BIGINT)) AS ingest_ts,
    event_id AS ping_seq
  FROM events)"""

SEG_CTE = PINGS_CTE + f""",
seg AS (
  SELECT *, lag(current_lat) OVER w AS prev_lat, lag(current_lon) OVER w AS prev_lon,
         lag(gps_ping_time) OVER w AS prev_time
  FROM pings WINDOW w AS (PARTITION BY booking_id ORDER BY gps_ping_time ASC NULLS LAST, ping_seq)),
seg2 AS (
  SELECT *, {hours('gps_ping_time', 'prev_time')} AS delta_hours,
         {hav('prev_lat', 'prev_lon', 'current_lat', 'current_lon')} AS segment_km FROM seg),
segs AS (
  SELECT *, CASE WHEN delta_hours > 0 THEN segment_km / delta_hours END AS segment_speed_kmph,
         coalesce(CASE WHEN delta_hours > 0 THEN segment_km / delta_hours END < 2 AND delta_hours >= 2, false)
           AS is_idle_segment
  FROM seg2)"""


_LAST = fixtures.FEED_BATCHES - 1

# The live feed: late pings, and pings sent again in their own or the next batch (see fixtures.ping_feed).
FEED_CTE = PINGS_CTE + f""",
feed0 AS (SELECT *, epoch_us(gps_ping_time) AS us, epoch_us(gps_ping_time) + CASE WHEN ping_seq % 10 = 3 THEN 2400000000
  WHEN ping_seq % 97 = 5 THEN 259200000000 ELSE 0 END AS arrival FROM pings WHERE gps_ping_time IS NOT NULL),
sent AS (SELECT feed0.*, least({_LAST}, ((arrival - lo) * {fixtures.FEED_BATCHES}) // (hi - lo + 1)) AS b0 FROM feed0,
  (SELECT min(us) AS lo, max(us) AS hi FROM feed0)),
feed AS (SELECT *, b0 AS b FROM sent UNION ALL SELECT *, least({_LAST}, b0 + 1) FROM sent WHERE ping_seq % 13 = 2
  UNION ALL SELECT *, b0 FROM sent WHERE ping_seq % 29 = 4),
valid AS (SELECT * FROM feed WHERE booking_id IS NOT NULL AND current_lat BETWEEN -90 AND 90 AND current_lon BETWEEN -180 AND 180)"""


def wsql(body: str, ctes: str = SEG_CTE) -> str:
    return f"WITH {ctes}\n{body}"


def _us(c: str):
    return F.unix_micros(F.col(c)).alias(f"{c}_us")


def _segments(spark, sf_dir):
    return G.preprocess_trajectory(ctx.pings(spark, sf_dir))


Q["trajectory_lag"] = lambda spark, sf_dir: rounded(
    _segments(spark, sf_dir).select("booking_id", _us("gps_ping_time"), "prev_lat", "prev_lon", _us("prev_time"))
)
SQL["trajectory_lag"] = wsql(
    f"""SELECT booking_id, epoch_us(gps_ping_time) AS gps_ping_time_us, {rnd('prev_lat')} AS prev_lat,
  {rnd('prev_lon')} AS prev_lon, epoch_us(prev_time) AS prev_time_us FROM segs"""
)

Q["trajectory_speed"] = lambda spark, sf_dir: rounded(
    _segments(spark, sf_dir).select("booking_id", _us("gps_ping_time"), "delta_hours", "segment_km",
                                    "segment_speed_kmph")
)
SQL["trajectory_speed"] = wsql(
    f"""SELECT booking_id, epoch_us(gps_ping_time) AS gps_ping_time_us, {rnd('delta_hours')} AS delta_hours,
  {rnd('segment_km')} AS segment_km, {rnd('segment_speed_kmph')} AS segment_speed_kmph FROM segs"""
)

Q["idle_segments"] = lambda spark, sf_dir: _segments(spark, sf_dir).select(
    "booking_id", _us("gps_ping_time"), "is_idle_segment"
)
SQL["idle_segments"] = wsql("SELECT booking_id, epoch_us(gps_ping_time) AS gps_ping_time_us, is_idle_segment FROM segs")

Q["snapshot_summary"] = lambda spark, sf_dir: rounded(G.snapshot_summary(ctx.enriched(spark, sf_dir)))
SQL["snapshot_summary"] = with_enriched(
    f"""SELECT count(DISTINCT booking_id) AS bookings,
  {rnd('avg(CASE WHEN current_location IS NULL THEN 1.0e0 ELSE 0.0e0 END)')} AS missing_current_location,
  {rnd('avg(CASE WHEN current_lat IS NULL OR current_lon IS NULL THEN 1.0e0 ELSE 0.0e0 END)')} AS missing_gps_coords,
  {rnd('median(gps_ping_lag_hours)')} AS avg_ping_lag_from_trip_start_h,
  {rnd('(SELECT median(n) FROM (SELECT count(*) AS n FROM enriched WHERE booking_id IS NOT NULL GROUP BY booking_id))')}
    AS median_pings_per_booking,
  '{G.TRACKING_RECOMMENDATION}' AS tracking_recommendation
FROM enriched"""
)

Q["moving_idle_split"] = lambda spark, sf_dir: rounded(G.moving_idle_split(_segments(spark, sf_dir)))
SQL["moving_idle_split"] = wsql(
    f"""SELECT booking_id, count(*) AS pings,
  {rnd('coalesce(sum(CASE WHEN is_idle_segment THEN delta_hours END), 0)')} AS idle_hours,
  {rnd('coalesce(sum(CASE WHEN NOT is_idle_segment AND delta_hours IS NOT NULL THEN delta_hours END), 0)')}
    AS moving_hours,
  {rnd('coalesce(sum(CASE WHEN is_idle_segment THEN segment_km END), 0)')} AS idle_km,
  {rnd('coalesce(sum(CASE WHEN NOT is_idle_segment THEN segment_km END), 0)')} AS moving_km,
  count(*) FILTER (WHERE is_idle_segment) AS idle_segments
FROM segs WHERE booking_id IS NOT NULL GROUP BY booking_id"""
)


def idle_episodes(spark, sf_dir):
    ep = G.idle_episodes(G.preprocess_trajectory(ctx.pings(spark, sf_dir), keep_bucket=True))
    return rounded(ep.select("booking_id", "episode_no", _us("episode_start"), _us("episode_end"),
                             "idle_hours", "idle_km", "segments"))


Q["idle_episodes"] = idle_episodes
SQL["idle_episodes"] = wsql(
    f"""SELECT booking_id, episode_no, epoch_us(min(prev_time)) AS episode_start_us,
  epoch_us(max(gps_ping_time)) AS episode_end_us, {rnd('sum(delta_hours)')} AS idle_hours,
  {rnd('sum(segment_km)')} AS idle_km, count(*) AS segments
FROM e2 WHERE is_idle_segment AND booking_id IS NOT NULL GROUP BY booking_id, episode_no
HAVING sum(delta_hours) >= 0""",
    SEG_CTE + """,
e1 AS (SELECT *, CASE WHEN is_idle_segment AND NOT coalesce(lag(is_idle_segment) OVER w, false) THEN 1 ELSE 0 END
         AS start_flag FROM segs WINDOW w AS (PARTITION BY booking_id ORDER BY gps_ping_time ASC NULLS LAST, ping_seq)),
e2 AS (SELECT *, CAST(sum(start_flag) OVER (PARTITION BY booking_id ORDER BY gps_ping_time ASC NULLS LAST, ping_seq
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS episode_no FROM e1)""",
)

Q["ping_compliance"] = lambda spark, sf_dir: rounded(G.ping_compliance(ctx.pings(spark, sf_dir)))
SQL["ping_compliance"] = wsql(
    f"""SELECT booking_id, pings, {rnd('span_hours')} AS span_hours, expected_pings,
  {rnd('pings / expected_pings')} AS compliance, pings / expected_pings < 0.9 AS below_threshold
FROM (SELECT booking_id, count(*) AS pings, {hours('max(gps_ping_time)', 'min(gps_ping_time)')} AS span_hours,
        CAST(floor({hours('max(gps_ping_time)', 'min(gps_ping_time)')} * 60.0e0 / 15.0e0) AS BIGINT) + 1
          AS expected_pings
      FROM pings WHERE booking_id IS NOT NULL AND gps_ping_time IS NOT NULL GROUP BY booking_id)""",
    PINGS_CTE,
)


def last_position(spark, sf_dir):
    lp = G.last_position(ctx.pings(spark, sf_dir))
    return rounded(lp.select("booking_id", _us("last_ping_time"), "lat", "lon", "pings"))


Q["last_position"] = last_position
SQL["last_position"] = wsql(
    f"""SELECT booking_id, epoch_us(gps_ping_time) AS last_ping_time_us, {rnd('current_lat')} AS lat,
  {rnd('current_lon')} AS lon, n AS pings FROM (
  SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY gps_ping_time DESC, ping_seq DESC) AS rn,
         count(*) OVER (PARTITION BY booking_id) AS n
  FROM pings WHERE booking_id IS NOT NULL AND gps_ping_time IS NOT NULL) WHERE rn = 1""",
    PINGS_CTE,
)


def track(spark, sf_dir):
    t = G.track(ctx.pings(spark, sf_dir))
    return rounded(t.select("booking_id", "point_index", _us("gps_ping_time"), "current_lat", "current_lon"))


Q["track"] = track
SQL["track"] = wsql(
    f"""SELECT booking_id, row_number() OVER (PARTITION BY booking_id ORDER BY gps_ping_time ASC NULLS LAST, ping_seq)
    AS point_index, epoch_us(gps_ping_time) AS gps_ping_time_us, {rnd('current_lat')} AS current_lat,
  {rnd('current_lon')} AS current_lon FROM pings WHERE booking_id IS NOT NULL""",
    PINGS_CTE,
)


def dedupe_pings(spark, sf_dir):
    d = G.dedupe_pings(parse_payload(fixtures.ping_feed(spark, sf_dir)))
    return rounded(d.select("booking_id", _us("gps_ping_time"), "current_lat", "current_lon", "gps_provider"))


Q["dedupe_pings"] = dedupe_pings
SQL["dedupe_pings"] = wsql(
    f"""SELECT DISTINCT booking_id, us AS gps_ping_time_us, {rnd('current_lat')} AS current_lat, {rnd('current_lon')} AS current_lon,
  gps_provider FROM valid""",
    FEED_CTE,
)
