"""GPS trajectories, idle detection and ping summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IDLE_MIN_HOURS, IDLE_SPEED_KMPH
from ..functions.columns import haversine_km, hours_between, null_false
from .dedupe import keep_first
from .quantiles import exact_quantiles
from .trajectory import lag_by_key, running_count_by_key, runs_by_key

TRACKING_RECOMMENDATION = "Deploy continuous GPS (30-60s) for idle/moving decomposition"


def preprocess_trajectory(pings: DataFrame, booking_col: str = "booking_id", time_col: str = "gps_ping_time",
                          lat_col: str = "current_lat", lon_col: str = "current_lon", tie_col: str = "ping_seq",
                          idle_speed: float = IDLE_SPEED_KMPH, idle_hours: float = IDLE_MIN_HOURS,
                          bucket_hours: int = 24, keep_bucket: bool = False) -> DataFrame:
    """Previous point, segment hours / km / speed, idle flag."""
    df = pings if tie_col in pings.columns else pings.withColumn(tie_col, F.monotonically_increasing_id())
    df = lag_by_key(df, booking_col, time_col, tie_col, [lat_col, lon_col, time_col], "_p_", bucket_hours, keep_bucket)
    df = df.withColumnsRenamed(
        {f"_p_{lat_col}": "prev_lat", f"_p_{lon_col}": "prev_lon", f"_p_{time_col}": "prev_time"}
    )
    delta = hours_between(time_col, "prev_time")
    df = df.withColumns(
        {
            "delta_hours": delta,
            "segment_km": haversine_km("prev_lat", "prev_lon", lat_col, lon_col),
        }
    )
    df = df.withColumn(
        "segment_speed_kmph", F.when(F.col("delta_hours") > 0, F.col("segment_km") / F.col("delta_hours"))
    )
    return df.withColumn(
        "is_idle_segment",
        null_false((F.col("segment_speed_kmph") < idle_speed) & (F.col("delta_hours") >= idle_hours)),
    )


def snapshot_summary(enriched: DataFrame) -> DataFrame:
    """One-row summary of snapshot-style GPS data."""
    base = enriched.agg(
        F.countDistinct("booking_id").alias("bookings"),
        F.avg(F.col("current_location").isNull().cast("double")).alias("missing_current_location"),
        F.avg((F.col("current_lat").isNull() | F.col("current_lon").isNull()).cast("double")).alias(
            "missing_gps_coords"
        ),
    )
    # median lag and median pings per booking: exact, from distributed sorts
    lag = exact_quantiles(enriched, "gps_ping_lag_hours", [0.5], names=["avg_ping_lag_from_trip_start_h"])
    per = enriched.where(F.col("booking_id").isNotNull()).groupBy("booking_id").agg(F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(per, "n", [0.5], names=["median_pings_per_booking"])
    one = lambda d, c: F.broadcast(d.agg(F.first(c).alias(c)))  # noqa: E731  (one row even if empty)
    return (
        base.crossJoin(one(lag, "avg_ping_lag_from_trip_start_h"))
        .crossJoin(one(med, "median_pings_per_booking"))
        .withColumn("tracking_recommendation", F.lit(TRACKING_RECOMMENDATION))
    )


def moving_idle_split(segments: DataFrame, booking_col: str = "booking_id") -> DataFrame:
    """Idle vs moving hours and km per booking (segments with a time step)."""
    idle = F.col("is_idle_segment")
    has = F.col("delta_hours").isNotNull()
    return segments.where(F.col(booking_col).isNotNull()).groupBy(booking_col).agg(
        F.count(F.lit(1)).alias("pings"),
        F.coalesce(F.sum(F.when(idle, F.col("delta_hours"))), F.lit(0.0)).alias("idle_hours"),
        F.coalesce(F.sum(F.when(~idle & has, F.col("delta_hours"))), F.lit(0.0)).alias("moving_hours"),
        F.coalesce(F.sum(F.when(idle, F.col("segment_km"))), F.lit(0.0)).alias("idle_km"),
        F.coalesce(F.sum(F.when(~idle, F.col("segment_km"))), F.lit(0.0)).alias("moving_km"),
        F.count_if(idle).alias("idle_segments"),
    )


def idle_episodes(segments: DataFrame, booking_col: str = "booking_id", time_col: str = "gps_ping_time",
                  tie_col: str = "ping_seq", min_hours: float = 0.0, bucket_hours: int = 24) -> DataFrame:
    """Runs of consecutive idle segments (gaps and islands).

    Segments that carry their bucket (``keep_bucket``) are not shuffled again."""
    ep = runs_by_key(
        segments, booking_col, time_col, tie_col, F.col("is_idle_segment"),
        {"episode_start": ("min", F.col("prev_time")), "episode_end": ("max", F.col(time_col)), "idle_hours": ("sum", F.col("delta_hours")),
         "idle_km": ("sum", F.col("segment_km")), "segments": ("sum", F.lit(1).cast("bigint"))},
        "episode_no", bucket_hours,
    )
    return ep.where(F.col("idle_hours") >= min_hours)


def ping_compliance(pings: DataFrame, cadence_minutes: float = 15.0, threshold: float = 0.9,
                    booking_col: str = "booking_id", time_col: str = "gps_ping_time") -> DataFrame:
    """Pings received vs expected at a cadence over the tracked span."""
    g = pings.where(F.col(booking_col).isNotNull() & F.col(time_col).isNotNull()).groupBy(booking_col).agg(
        F.count(F.lit(1)).alias("pings"),
        F.min(time_col).alias("first_ping"),
        F.max(time_col).alias("last_ping"),
    )
    span_h = hours_between("last_ping", "first_ping")
    expected = F.floor(span_h * 60.0 / cadence_minutes) + 1
    return g.select(
        booking_col,
        "pings",
        span_h.alias("span_hours"),
        expected.alias("expected_pings"),
        (F.col("pings") / expected).alias("compliance"),
        ((F.col("pings") / expected) < threshold).alias("below_threshold"),
    )


def last_position(pings: DataFrame, booking_col: str = "booking_id", time_col: str = "gps_ping_time",
                  tie_col: str = "ping_seq") -> DataFrame:
    """Latest point per booking (max_by is combined map-side)."""
    pt = F.struct(F.col(time_col).alias("ts"), F.col("current_lat").alias("lat"), F.col("current_lon").alias("lon"))
    return (
        pings.where(F.col(booking_col).isNotNull() & F.col(time_col).isNotNull())
        .groupBy(booking_col)
        .agg(F.max_by(pt, F.struct(F.col(time_col), F.col(tie_col))).alias("p"), F.count(F.lit(1)).alias("pings"))
        .select(booking_col, F.col("p.ts").alias("last_ping_time"), F.col("p.lat").alias("lat"),
                F.col("p.lon").alias("lon"), "pings")
    )


def track(pings: DataFrame, booking_col: str = "booking_id", time_col: str = "gps_ping_time",
          tie_col: str = "ping_seq", bucket_hours: int = 24) -> DataFrame:
    """The ordered track as rows (booking, point_index, time, lat, lon);
    never one array per booking."""
    p = pings.where(F.col(booking_col).isNotNull())
    p = running_count_by_key(p, booking_col, time_col, tie_col, "point_index", None, bucket_hours)
    return p.select(booking_col, "point_index", time_col, "current_lat", "current_lon")


def valid_pings(pings: DataFrame) -> DataFrame:
    lat, lon = F.col("current_lat"), F.col("current_lon")
    return pings.where(
        F.col("booking_id").isNotNull() & F.col("gps_ping_time").isNotNull()
        & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    )


def dedupe_pings(pings: DataFrame, tie_col: str = "ping_seq") -> DataFrame:
    """Drop invalid coordinates, keep the first ping per (booking, time)."""
    return keep_first(valid_pings(pings), ["booking_id", "gps_ping_time"], [F.col(tie_col)])
