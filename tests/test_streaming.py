import json
import os
import random
import tempfile
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from freightlens.config import PING_SCHEMA
from freightlens.operators.gps import preprocess_trajectory
from freightlens.streaming import pings as S
from freightlens.streaming import trips
from freightlens.streaming.latest import latest_position_table, positions


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of a stateful batch starts a Python worker."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def _write(folder, name, rows):
    with open(os.path.join(folder, name), "w") as fh:
        for r in rows:
            fh.write(json.dumps(r) + "\n")


def _ping(b, t, lat=10.0, lon=70.0):
    return {"booking_id": b, "gps_ping_time": t, "current_lat": lat, "current_lon": lon, "gps_provider": "G0",
            "ingest_ts": t}


def test_stream_dedupe_late_duplicate_invalid(spark):
    src = tempfile.mkdtemp(prefix="fl-stream-src-")
    out = tempfile.mkdtemp(prefix="fl-stream-out-")
    stream = S.dedupe_stream(S.file_pings(spark, src, "json", PING_SCHEMA, max_files=1))
    q = (stream.writeStream.format("memory").queryName("dedupe_t").option("checkpointLocation", out)
         .outputMode("append").start())
    try:
        _write(src, "a.json", [_ping("A", "2024-01-02T00:00:00"), _ping("A", "2024-01-02T00:00:00"),
                               _ping("B", "2024-01-02T00:10:00", lat=95.0)])
        q.processAllAvailable()
        _write(src, "b.json", [_ping("A", "2024-01-02T05:00:00")])
        q.processAllAvailable()
        _write(src, "c.json", [_ping("A", "2024-01-01T01:00:00")])  # far behind the watermark
        q.processAllAvailable()
        rows = spark.sql("SELECT booking_id, gps_ping_time FROM dedupe_t").collect()
    finally:
        q.stop()
    times = sorted(str(r.gps_ping_time) for r in rows)
    assert times == ["2024-01-02 00:00:00", "2024-01-02 05:00:00"]


def _messages(spark, rows):
    """Messages of (booking, time, lat, lon) in the documented payload."""
    data = [(b, json.dumps({"ping_ts": t, "latitude": lat, "longitude": lon, "speed_kmph": 42.5, "heading_deg": 180, "gps_provider": "G0"}), None)
            for b, t, lat, lon in rows]
    return spark.createDataFrame(data, S.MESSAGE_SCHEMA)


def _hours(b, hours, lat=10.0, step=0.01):
    return [(b, f"2024-01-01T{h:02d}:00:00Z", lat + h * step, 70.0) for h in hours]


def _segments(spark, batches, **options):
    build = lambda m: S.live_segments(S.dedupe_stream(S.parse_payload(m)), watermark=None, **options)
    return S.run_feed(spark, [_messages(spark, b) for b in batches], build, "seg-test")


def _seen(df):
    return sorted((r.booking_id, str(r.gps_ping_time), str(r.prev_time), None if r.segment_km is None else round(r.segment_km, 6), r.is_idle_segment)
                  for r in df.collect())


def test_live_segments_equal_batch(spark):
    """Pings out of order within the watermark, a replay and a restart for each batch give the batch trajectory."""
    a, b = _hours("A", range(0, 20, 3)), _hours("B", range(1, 20, 4), 11.0, 0.0)
    end = [("C", "2024-01-02T06:00:00Z", 1.0, 1.0)]
    late = [("A", "2024-01-01T05:20:00Z", 10.02, 70.0)]  # 40 minutes before the latest: in time
    live, n = _segments(spark, [a[:2] + b[:1], a[2:3] + b[1:2] + late + a[1:2], a[3:] + b[2:], end])
    rows = [r for r in a + b + late]
    batch = preprocess_trajectory(spark.createDataFrame(rows, "booking_id string, t string, current_lat double, current_lon double").select(
        "booking_id", F.col("t").cast("timestamp").alias("gps_ping_time"), "current_lat", "current_lon", F.lit(0).alias("ping_seq")))
    assert _seen(live) == _seen(batch)
    assert n == 0  # the replay of A's second ping came in time and was dropped as a duplicate
    assert any(r[4] for r in _seen(live))


def test_late_pings_are_held_or_counted(spark):
    """A ping 15 minutes late in a batch of its own is kept and put in its place; one too late is counted."""
    pings = [("A", "2024-01-01T10:00:00Z", 10.0, 70.0), ("A", "2024-01-01T10:30:00Z", 10.2, 70.0), ("A", "2024-01-01T10:15:00Z", 10.1, 70.0),
             ("A", "2024-01-01T15:00:00Z", 10.3, 70.0), ("A", "2024-01-01T09:00:00Z", 9.0, 70.0), ("Z", "2024-01-01T23:00:00Z", 0.0, 0.0)]
    live, late = _segments(spark, [[p] for p in pings])
    assert [(str(r.gps_ping_time)[11:16], r.prev_lat) for r in live.orderBy("gps_ping_time").collect()] == [
        ("10:00", None), ("10:15", 10.0), ("10:30", 10.1), ("15:00", 10.2)]
    assert late == 1


def test_state_expires_with_the_trip(spark):
    """After a silence the next ping has no predecessor, whether its state was removed yet or not."""
    pings = [("A", "2024-01-01T10:00:00Z", 10.0, 70.0), ("B", "2024-01-03T10:00:00Z", 10.0, 70.0), ("A", "2024-01-04T10:00:00Z", 10.0, 70.0),
             ("A", "2024-01-04T12:00:00Z", 11.0, 70.0), ("Z", "2024-01-09T00:00:00Z", 0.0, 0.0)]
    for batches in ([[p] for p in pings], [pings[:4], pings[4:]]):
        live, _ = _segments(spark, batches, expire_hours=24.0)
        assert [(r.gps_ping_time.day, r.gps_ping_time.hour, r.prev_time is None) for r in live.where("booking_id = 'A'").orderBy("gps_ping_time").collect()] == [
            (1, 10, True), (4, 10, True), (4, 12, False)]


def test_payload(spark):
    """The documented body parses; one that is no JSON, or has no time, gives a ping that validation drops."""
    body = '{"ping_ts": "2026-05-24T14:32:11Z", "latitude": 19.0760, "longitude": 72.8777, "speed_kmph": 42.5, "heading_deg": 180, "gps_provider": "Consent Track"}'
    m = spark.createDataFrame([("BK-10293", body, None), ("X", "no json", None), ("Y", '{"latitude": 1.0}', None), ("Z", None, None)], S.MESSAGE_SCHEMA)
    p = S.parse_payload(m)
    r = S.validate(p).collect()
    assert len(r) == 1 and p.count() == 4
    assert (r[0].booking_id, str(r[0].gps_ping_time), r[0].current_lat, r[0].current_lon, r[0].speed_kmph, r[0].heading_deg, r[0].gps_provider) == (
        "BK-10293", "2026-05-24 14:32:11", 19.0760, 72.8777, 42.5, 180.0, "Consent Track")


def test_fences_across_the_date_line(spark):
    """A fence at 179.99 degrees finds the ping two kilometres east of it, on the other side; enter and exit follow."""
    fences = spark.createDataFrame([("F", 10.0, 179.99, 3.0), ("N", 89.995, 0.0, 3.0)], "fence_id string, lat double, lon double, radius_km double")
    pings = [("A", "2024-01-01T10:00:00Z", 10.0, 170.0), ("A", "2024-01-01T11:00:00Z", 10.0, -179.992), ("A", "2024-01-01T12:00:00Z", 10.0, -170.0),
             ("P", "2024-01-01T12:00:00Z", 89.99, 180.0), ("Z", "2024-01-02T12:00:00Z", 0.0, 0.0)]
    build = lambda m: S.live_geofence(S.dedupe_stream(S.parse_payload(m)), fences, watermark=None)
    got, _ = S.run_feed(spark, [_messages(spark, pings[:2]), _messages(spark, pings[2:])], build, "fence-test")
    assert sorted((r.booking_id, r.gps_ping_time.hour, r.event_type, r.fence_id) for r in got.collect()) == [
        ("A", 11, "enter", "F"), ("A", 12, "exit", "F"), ("P", 12, "enter", "N")]


def test_rules_over_two_metrics(spark):
    rules = [S.AlertRule("IDLE", "idle", (("segment_speed_kmph", "<", 2.0), ("delta_hours", ">=", 2.0)))]
    t = spark.createDataFrame([("A", 1, 1.0, 3.0, None), ("B", 1, 1.0, 1.0, "F"), ("C", 1, None, 3.0, None), ("A", 2, 9.0, 3.0, "G")],
                              "booking_id string, ping_seq long, segment_speed_kmph double, delta_hours double, fence_id string")
    t = t.withColumn("gps_ping_time", F.timestamp_seconds("ping_seq"))
    log = S.live_alerts(t, rules)
    assert {(r.booking_id, r.ping_seq): [(a.rule_id, a.detail) for a in r.alerts] for r in log.collect()} == {
        ("A", 1): [("IDLE", None)], ("B", 1): [("IN_FENCE", "F")], ("C", 1): [], ("A", 2): [("IN_FENCE", "G")]}
    assert sorted((r.booking_id, r.rule_id, r.detail) for r in S.active_alerts(log).collect()) == [("A", "IN_FENCE", "G"), ("B", "IN_FENCE", "F")]


def test_latest_table_is_bounded_and_replayable(spark):
    """Twenty batches, some sent again later: one row a booking, each ping counted once, few folders."""
    root = S.scratch_folder(spark, "latest-test")
    batches = [[(f"B{i % 7}", i, 10.0 + i * 0.01), (f"B{i % 3}", max(i - 2, 0), 1.0 * i)] for i in range(20)]
    want = {}
    sizes = []
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "booking_id string, ping_seq long, current_lat double").select(
            "*", F.timestamp_seconds("ping_seq").alias("gps_ping_time"), F.lit(70.0).alias("current_lon"))
        table = latest_position_table(spark, root, buckets=2, merge_every=4)  # a new writer each time, as after a failure
        table.upsert(positions(df), i)
        if i % 6 == 5:
            table.upsert(positions(df), i)
            table.upsert(positions(df), i - 4)
        for b, seq, lat in rows:
            n, best = want.get(b, (0, (-1, 0.0)))
            want[b] = n + 1, max(best, (seq, lat))
        sizes.append(sum(len(f) for _, _, f in os.walk(root)))
    got = {r.booking_id: (r.pings, (r.ping_seq, r.lat)) for r in latest_position_table(spark, root).read().collect()}
    assert {b: (n, best[0]) for b, (n, best) in want.items()} == {b: (n, best[0]) for b, (n, best) in got.items()}
    assert len(os.listdir(f"{root}/delta")) < 4 + 1 and len(os.listdir(f"{root}/snapshot")) <= 2
    assert max(sizes[12:]) <= max(sizes[:12]) + 2
    assert latest_position_table(spark, S.scratch_folder(spark, "none")).read().count() == 0


def test_fences_of_one_place_are_one(spark):
    """However many fences share a place and radius, a ping meets one of them, the least id."""
    fences = spark.createDataFrame([(f"F{i:03d}", 10.0, 70.0, 3.0) for i in range(1, 200)] + [("A-WIDE", 10.0, 70.0, 9.0)], "fence_id string, lat double, lon double, radius_km double")
    pings = spark.createDataFrame([("A", 10.0, 70.0), ("B", 10.05, 70.0), ("C", 11.0, 70.0)], "booking_id string, current_lat double, current_lon double")
    got = sorted((r.booking_id, r.fence_id) for r in S.near_fences(pings, fences).where("fence_id IS NOT NULL").collect())
    assert got == [("A", "A-WIDE"), ("A", "F001"), ("B", "A-WIDE")]


class _State:
    """A list or value state that counts its calls."""

    calls = 0

    def __init__(self):
        self.rows = None

    def exists(self):
        return self.rows is not None

    def get(self):
        _State.calls += 1
        return self.rows

    def put(self, rows):
        _State.calls += 1
        self.rows = list(rows)

    update = put

    def appendValue(self, row):
        self.put([*(self.rows or []), row])

    def clear(self):
        _State.calls += 1
        self.rows = None


class _Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema):
        return _State()

    getValueState = getListState

    def registerTimer(self, ms):
        _State.calls += 1
        self.timers.add(ms)


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_bucket_is_one_state(monkeypatch):
    """400 bookings of a bucket, over batches, with equal times, several fences a ping and silences: as one by one, with few calls."""
    monkeypatch.setattr(_State, "calls", 0)
    monkeypatch.setattr(trips, "CHUNK", 100)
    rng, hour, expire = random.Random(5), 3_600_000_000, 30 * 3_600_000_000
    op, handle, out, sent = trips.InOrder(expire), _Handle(), [], []
    op.init(handle)
    for batch in range(6):
        low = batch * 20 * hour
        rows = []
        for i in range(400):
            for _ in range(rng.randint(0, 3)):
                us = low + rng.randint(1, 22) * hour + rng.choice([0, 1, 999])
                for f, km in rng.choice([[(None, None)], [("F", 2.0), (None, None), ("E", 2.0), ("G", 3.0)]]):
                    rows.append((f"B{i}", us, rng.choice([-7, 1 << 62]) if f is None and km is None else 5, rng.choice([None, 1.0, 2.5]), 70.0, f, km))
        sent += rows
        list(op.handleInputRows((1,), iter([pd.DataFrame(rows, columns=trips._PING.names)]), None))
        mark = (low + 20 * hour) // 1000
        for t in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(t)
            for df in op.handleExpiredTimer((1,), _Mark(mark), None):
                out += df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)
    want = []
    for b in sorted({r[0] for r in sent}):
        last, seen = None, set()
        for r in sorted((r for r in sent if r[0] == b and r[1] <= 120 * hour), key=lambda r: (r[1], r[2], r[6] is None, r[6] or 0.0, r[5] or "")):
            if r[1:3] in seen:
                continue
            seen.add(r[1:3])
            old = last if last is not None and r[1] - last[1] <= expire else (None,) * 7
            want.append((*r[:3], r[4], r[5], old[1], old[5]))
            last = r
    assert sorted(((*r[:3], *r[4:7], r[9]) for r in out), key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])
    assert any(r[6] == "E" for r in want) and sum(r[5] is None for r in want) > 400 and _State.calls < 500
