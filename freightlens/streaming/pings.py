"""Live GPS ping processing with Structured Streaming.

Sources are Kafka (JSON payload) or files; sinks are Parquet (append) or an
idempotent foreachBatch upsert (update mode: each micro-batch writes its own
folder, so a replayed batch overwrites itself and readers keep the newest
row per key).  Checkpoints live under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IDLE_MIN_HOURS, IDLE_SPEED_KMPH, PAYLOAD_SCHEMA, PING_SCHEMA
from ..operators.dedupe import keep_first
from ..operators.geofence import CELL, delay_alerts, fence_cells, levels_of, places, with_cells
from ..functions.columns import haversine_km, hours_between
from ..session import ensure_checkpoint_dir, materialize
from .trips import EXPIRE_HOURS, fence_events, live_trips, with_motion


# --- D1 sources ----------------------------------------------------------------
MESSAGE_SCHEMA = "booking_id string, value string, ingest_ts timestamp"


def parse_payload(messages: DataFrame) -> DataFrame:
    """Pings from messages (booking_id, value, ingest_ts): the documented JSON body, by the library's names.

    ``ping_seq``, which orders pings of one booking and time, is a hash of the body, so a replayed
    message has the same one.  A body that can't be parsed gives a ping without time, which validation drops.
    """
    body = messages.select("booking_id", "ingest_ts", F.from_json("value", PAYLOAD_SCHEMA).alias("p"), F.xxhash64("value").alias("ping_seq"))
    return body.select(
        "booking_id", F.col("p.ping_ts").alias("gps_ping_time"), F.col("p.latitude").alias("current_lat"),
        F.col("p.longitude").alias("current_lon"), "p.speed_kmph", "p.heading_deg", "p.gps_provider", "ingest_ts", "ping_seq",
    )


def kafka_pings(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Ping payloads from a Kafka topic keyed by booking id (needs the Kafka connector on the classpath)."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .options(**options).load()
    )
    return parse_payload(raw.select(F.col("key").cast("string").alias("booking_id"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_ts")))


def file_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Messages from Parquet files landing in a folder; ``max_files`` bounds what one trigger reads."""
    r = spark.readStream.schema(MESSAGE_SCHEMA)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def file_pings(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = PING_SCHEMA,
               max_files: int | None = None) -> DataFrame:
    """Ping files landing in a folder (one or more files per trigger)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


# --- D2 validate + dedupe -----------------------------------------------------------
def validate(pings: DataFrame) -> DataFrame:
    lat, lon = F.col("current_lat"), F.col("current_lon")
    return pings.where(
        F.col("booking_id").isNotNull() & F.col("gps_ping_time").isNotNull()
        & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    )


def dedupe_stream(pings: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Valid pings, one per (booking_id, gps_ping_time) inside the watermark."""
    return validate(pings).withWatermark("gps_ping_time", watermark).dropDuplicatesWithinWatermark(
        ["booking_id", "gps_ping_time"]
    )


# --- D4 live segments, D5 geofence events (stateful, see trips.py) ----------------
def live_segments(pings: DataFrame, idle_speed: float = IDLE_SPEED_KMPH, idle_hours: float = IDLE_MIN_HOURS,
                  watermark: str | None = "1 hour", expire_hours: float = EXPIRE_HOURS) -> DataFrame:
    """The batch trajectory (G1-G3) of every ping that the watermark has passed.
    ``watermark=None`` if the input already carries one."""
    p = pings if watermark is None else pings.withWatermark("gps_ping_time", watermark)
    return with_motion(live_trips(p, expire_hours), idle_speed, idle_hours)


def near_fences(pings: DataFrame, fences: DataFrame) -> DataFrame:
    """Stream-static grid join: a row for each place of fences within whose radius a ping lies, and rows without a fence."""
    cells = materialize(fence_cells(places(fences)), "fence-cells")
    levels = levels_of(cells)
    cells = cells.select(*CELL, F.col("fence_id").alias("_fence"), F.col("lat").alias("_flat"), F.col("lon").alias("_flon"), F.col("radius_km").alias("_rad"))
    j = with_cells(pings, levels).join(cells, CELL, "left")
    dist = haversine_km("current_lat", "current_lon", "_flat", "_flon")
    inside = dist <= F.col("_rad")
    return j.select(*pings.columns, F.when(inside, F.col("_fence")).alias("fence_id"), F.when(inside, dist).alias("fence_km"))


def live_geofence(pings: DataFrame, fences: DataFrame, watermark: str | None = "1 hour", expire_hours: float = EXPIRE_HOURS) -> DataFrame:
    """Enter and exit events of every ping with coordinates that the watermark has passed."""
    p = pings.where(F.col("current_lat").isNotNull() & F.col("current_lon").isNotNull())
    p = p if watermark is None else p.withWatermark("gps_ping_time", watermark)
    return fence_events(live_trips(near_fences(p, fences), expire_hours))


# --- D3 / D6 enrichment and delay detection ---------------------------------------
def enrich(pings: DataFrame, context: DataFrame) -> DataFrame:
    """D3: stream-static left join with the version of the booking's context that was valid at the ping's time.

    ``context`` has one row for each booking and version, with valid_from <= t < valid_to.
    """
    c = context.withColumnRenamed("booking_id", "_booking")
    at = F.col("gps_ping_time")
    on = (F.col("booking_id") == F.col("_booking")) & (at >= F.col("valid_from")) & (at < F.col("valid_to"))
    return pings.join(c, on, "left").drop("_booking", "valid_from", "valid_to")


def with_delay(enriched: DataFrame) -> DataFrame:
    """D6 on enriched pings: remaining hours at contract pace, whether that is after the planned ETA, and the slack."""
    pace = F.col("min_daily_km") / 24.0
    remaining = F.when(pace > 0, haversine_km("current_lat", "current_lon", "dest_lat", "dest_lon") / pace)
    arrival = F.timestamp_micros(F.unix_micros("gps_ping_time") + (F.col("remaining_hours") * 3.6e9).cast("bigint"))
    e = enriched.withColumn("remaining_hours", remaining).withColumn("predicted_arrival", arrival)
    return e.withColumns({
        "is_delayed": F.coalesce(F.col("predicted_arrival") > F.col("planned_eta"), F.lit(False)),
        "slack_hours": hours_between("planned_eta", "predicted_arrival"),
    })


def live_delay_alerts(snapshots: DataFrame) -> DataFrame:
    """D6: 'now' is the ping time, so replays give the same answer as batch."""
    return delay_alerts(snapshots)


# --- D7 latest position -----------------------------------------------------------
def latest_positions(pings: DataFrame) -> DataFrame:
    """Newest point per booking (update mode)."""
    pt = F.struct(F.col("gps_ping_time").alias("ts"), F.col("current_lat").alias("lat"),
                  F.col("current_lon").alias("lon"))
    return validate(pings).groupBy("booking_id").agg(
        F.max_by(pt, F.struct("gps_ping_time", "ping_seq")).alias("p"), F.count(F.lit(1)).alias("pings")
    ).select("booking_id", F.col("p.ts").alias("last_ping_time"), F.col("p.lat").alias("lat"),
             F.col("p.lon").alias("lon"), "pings")


# --- D8 alert rules ----------------------------------------------------------------
def breaches(op: Column, value: Column, threshold: Column) -> Column:
    return (
        ((op == ">") & (value > threshold)) | ((op == ">=") & (value >= threshold))
        | ((op == "<") & (value < threshold)) | ((op == "<=") & (value <= threshold))
    )


def alerts(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """Per-segment metrics unpivoted and matched to a static rule table
    (rule_id, metric, op, threshold); one alert row per breached rule."""
    m = segments.select(
        "booking_id", "gps_ping_time",
        F.expr("stack(3, 'segment_speed_kmph', segment_speed_kmph, 'delta_hours', delta_hours, "
               "'segment_km', segment_km) AS (metric, value)"),
    ).where(F.col("value").isNotNull())
    hit = breaches(F.col("op"), F.col("value"), F.col("threshold"))
    return m.join(rules, "metric").where(hit).select("rule_id", "booking_id", "gps_ping_time", "metric", "value", "threshold")


@dataclass(frozen=True)
class AlertRule:
    """An alert that holds while all conditions (metric, op, threshold) do; a NULL metric fails its condition."""

    rule_id: str
    kind: str
    conditions: tuple[tuple[str, str, float], ...]

    def holds(self) -> Column:
        tests = [breaches(F.lit(op), F.col(metric), F.lit(threshold)) for metric, op, threshold in self.conditions]
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def live_alerts(trips: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """One row for each ping, with the alerts it raises in one list: (rule_id, kind, detail).

    ``trips`` carry motion and delay.  Rules are configuration, compiled into the plan; being in a fence is an alert
    of kind ``geofence`` with the fence as its detail.
    """
    found = [F.when(r.holds(), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.kind).alias("kind"), F.lit(None).cast("string").alias("detail"))) for r in rules]
    found.append(F.when(F.col("fence_id").isNotNull(), F.struct(F.lit("IN_FENCE").alias("rule_id"), F.lit("geofence").alias("kind"), F.col("fence_id").alias("detail"))))
    return trips.select("booking_id", "gps_ping_time", "ping_seq", F.filter(F.array(*found), lambda a: a.isNotNull()).alias("alerts"))


def active_alerts(alert_log: DataFrame) -> DataFrame:
    """The alerts that hold at each booking's last ping, and since when the booking has been seen."""
    last = alert_log.groupBy("booking_id").agg(F.max_by(F.struct("gps_ping_time", "alerts"), F.struct("gps_ping_time", "ping_seq")).alias("l"))
    return last.select("booking_id", F.col("l.gps_ping_time").alias("gps_ping_time"), F.explode("l.alerts").alias("a")).select("booking_id", "gps_ping_time", "a.*")


# --- D9 / D10 windows -----------------------------------------------------------------
def fleet_windows(pings: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Tumbling 1 h and sliding 1 h / 15 min ping counts per provider."""
    p = validate(pings).withWatermark("gps_ping_time", watermark)
    tumble = p.groupBy(F.window("gps_ping_time", "1 hour").alias("w"), "gps_provider").agg(
        F.count(F.lit(1)).alias("pings"), F.approx_count_distinct("booking_id").alias("bookings")
    ).select(F.lit("tumbling_1h").alias("kind"), "w.start", "w.end", "gps_provider", "pings", "bookings")
    return tumble


def sliding_windows(pings: DataFrame, watermark: str = "1 hour") -> DataFrame:
    p = validate(pings).withWatermark("gps_ping_time", watermark)
    return p.groupBy(F.window("gps_ping_time", "1 hour", "15 minutes").alias("w"), "gps_provider").agg(
        F.count(F.lit(1)).alias("pings")
    ).select(F.lit("sliding_1h_15m").alias("kind"), "w.start", "w.end", "gps_provider", "pings")


def trip_sessions(pings: DataFrame, gap: str = "2 hours", watermark: str = "1 hour") -> DataFrame:
    """Per booking, sessions of pings separated by less than ``gap``."""
    p = validate(pings).withWatermark("gps_ping_time", watermark)
    return p.groupBy(F.session_window("gps_ping_time", gap).alias("s"), "booking_id").agg(
        F.count(F.lit(1)).alias("pings")
    ).select("booking_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "pings")


#: Size of the lag sketches, and the rank error they stay within (by their authors' bound, at 99 % confidence).
LAG_K = 800
LAG_RANK_ERROR = 0.006


def lag_seconds() -> Column:
    return (F.unix_micros("ingest_ts") - F.unix_micros("gps_ping_time")) / 1e6


def _lag_columns() -> list[Column]:
    return [F.kll_sketch_get_quantile_double("lag_sketch", F.lit(q)).alias(name) for name, q in (("p50_lag_s", 0.5), ("p95_lag_s", 0.95))]


def ingest_lag(pings: DataFrame, watermark: str = "1 hour", alert_s: float = 60.0) -> DataFrame:
    """Ingest lag (ingest_ts - ping time) per hour: p50, p95, max, alerts, and the sketch the quantiles
    come from.  The state holds a sketch of fixed size for each open hour; sketches merge (``merged_lag``)."""
    p = validate(pings).withColumn("lag_s", lag_seconds()).withWatermark("gps_ping_time", watermark)
    hours = p.groupBy(F.window("gps_ping_time", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("pings"), F.kll_sketch_agg_double("lag_s", LAG_K).alias("lag_sketch"), F.max("lag_s").alias("max_lag_s"),
        F.count_if(F.col("lag_s") > alert_s).alias("late_ingest_alerts"),
    )
    return hours.select("w.start", "w.end", "pings", *_lag_columns(), "max_lag_s", "late_ingest_alerts", "lag_sketch")


def merged_lag(windows: DataFrame, by: Column) -> DataFrame:
    """Coarser windows from ``ingest_lag``'s, without its input: counts and alerts add up, sketches merge."""
    merged = windows.groupBy(by).agg(
        F.sum("pings").alias("pings"), F.kll_merge_agg_double("lag_sketch").alias("lag_sketch"), F.max("max_lag_s").alias("max_lag_s"),
        F.sum("late_ingest_alerts").alias("late_ingest_alerts"),
    )
    return merged.select(merged.columns[0], "pings", *_lag_columns(), "max_lag_s", "late_ingest_alerts", "lag_sketch")


# --- runners ---------------------------------------------------------------------------
def scratch_folder(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/streams/{name}-{uuid.uuid4().hex[:12]}"


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run to the end of the available input into Parquet (append mode)."""
    spark = stream.sparkSession
    root = scratch_folder(spark, name)
    q = (
        stream.writeStream.format("parquet").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_update(stream: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run in update (or complete) mode; every micro-batch writes its own
    folder (an idempotent upsert log) and the reader keeps the newest row
    per key."""
    spark = stream.sparkSession
    root = scratch_folder(spark, name)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    q = (
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint")
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0)).write.mode("overwrite").parquet(f"{root}/out/batch=-1")
    logged = spark.read.parquet(f"{root}/out").drop("batch")
    return keep_first(logged, keys, [-F.col("_batch")]).drop("_batch")


def run_feed(spark: SparkSession, batches: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], name: str,
             sink: Callable[[DataFrame, int], None] | None = None) -> tuple[DataFrame | None, int]:
    """Land each batch of messages in a folder and run ``build`` (messages -> append-mode stream) over it.

    The query is stopped after each batch and started again from its checkpoint for the next, as
    after a failure.  Returns what was written (None with a ``sink``, which gets the
    micro-batches), and how many rows were too late for the watermark.
    """
    root = scratch_folder(spark, name)
    spark.createDataFrame([], MESSAGE_SCHEMA).write.parquet(f"{root}/in")  # the folder must be there
    stream = build(file_messages(spark, f"{root}/in"))
    late = 0
    for batch in batches:
        batch.select("booking_id", "value", "ingest_ts").write.mode("append").parquet(f"{root}/in")
        writer = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True)
        q = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{root}/out")).start()
        q.awaitTermination()
        late += sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    return None if sink else spark.read.schema(stream.schema).parquet(f"{root}/out"), late
