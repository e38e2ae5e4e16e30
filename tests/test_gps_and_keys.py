import pytest
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from freightlens.operators.forecast import forecast_monthly_volume
from freightlens.operators.gps import idle_episodes, preprocess_trajectory, track
from freightlens.operators.keys import sequential_ids
from freightlens.operators.trajectory import lag_by_key, running_count_by_key


def _pings(spark, rows):
    return spark.createDataFrame(rows, "booking_id string, gps_ping_time timestamp, current_lat double, "
                                       "current_lon double, ping_seq long")


def test_bucketed_lag_equals_plain_window_with_hot_key(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("HOT", t0 + timedelta(hours=7 * i), 10.0 + i * 0.01, 70.0, i) for i in range(300)]
    rows += [(f"K{i % 5}", t0 + timedelta(hours=13 * i), 11.0, 71.0 + i * 0.01, 1000 + i) for i in range(50)]
    rows += [("HOT", None, 12.0, 72.0, 5000), (None, t0, 1.0, 1.0, 6000)]
    df = _pings(spark, rows)
    got = lag_by_key(df, "booking_id", "gps_ping_time", "ping_seq", ["current_lat", "gps_ping_time"], "p_")
    w = Window.partitionBy("booking_id").orderBy(F.col("gps_ping_time").asc_nulls_last(), "ping_seq")
    want = df.select("ping_seq", F.lag("current_lat").over(w).alias("a"), F.lag("gps_ping_time").over(w).alias("b"),
                     "booking_id")
    want = {r.ping_seq: (r.a, r.b) if r.booking_id is not None else (None, None) for r in want.collect()}
    got = {r.ping_seq: (r.p_current_lat, r.p_gps_ping_time) for r in got.collect()}
    assert got == want


def test_running_count_and_track(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("A", t0 + timedelta(hours=5 * i), 1.0, 1.0, i) for i in range(40)]
    df = _pings(spark, rows)
    rc = running_count_by_key(df, "booking_id", "gps_ping_time", "ping_seq", "n", bucket_hours=24)
    assert sorted(r.n for r in rc.collect()) == list(range(1, 41))
    idx = [r.point_index for r in track(df).orderBy("gps_ping_time").collect()]
    assert idx == list(range(1, 41))


def test_idle_flags_and_episodes(spark):
    t0 = datetime(2024, 1, 1)
    rows = [
        ("A", t0, 10.0, 70.0, 1),
        ("A", t0 + timedelta(hours=2), 10.0, 70.0 + 1.0 / 111.0, 2),   # ~1 km in 2 h -> idle
        ("A", t0 + timedelta(hours=2), 10.5, 70.0, 3),                   # delta 0 -> speed null
        ("A", t0 + timedelta(hours=5), 10.5, 70.0, 4),                   # 0 km in 3 h -> idle
        ("A", t0 + timedelta(hours=8), 10.5, 70.0, 5),                   # idle again (same episode)
    ]
    seg = preprocess_trajectory(_pings(spark, rows))
    flags = {r.ping_seq: r.is_idle_segment for r in seg.collect()}
    assert flags == {1: False, 2: True, 3: False, 4: True, 5: True}
    speed3 = [r.segment_speed_kmph for r in seg.collect() if r.ping_seq == 3][0]
    assert speed3 is None
    eps = idle_episodes(seg).orderBy("episode_no").collect()
    assert [(e.episode_no, e.segments) for e in eps] == [(1, 1), (2, 2)]


def test_sequential_ids_match_row_number(spark):
    names = [f"n{i:03d}" for i in range(0, 300, 7)] + [None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.id for r in sequential_ids(df, ["name"], "id", partitions=5).collect()}
    ordered = sorted([n for n in names if n is not None]) + [None]
    assert got == {n: i + 1 for i, n in enumerate(ordered)}


def test_forecast_min_months_and_level(spark):
    def frame(counts):
        rows = []
        for m, c in enumerate(counts):
            rows += [(f"b{m}-{k}", f"2024-{m + 1:02d}") for k in range(c)]
        return spark.createDataFrame(rows, "booking_id string, booking_month string")

    assert forecast_monthly_volume(frame([1, 2, 3])).count() == 0
    out = forecast_monthly_volume(frame([10, 20, 30, 40, 50])).orderBy("booking_month").collect()
    level = 10.0
    for y in [10, 20, 30, 40, 50]:
        level = 0.35 * y + 0.65 * level
    assert [r.booking_month for r in out] == ["2024-06", "2024-07", "2024-08"]
    assert all(r.forecast_bookings == round(level) for r in out)


def test_exact_quantiles_match_percentile(spark):
    import random

    from freightlens.operators.quantiles import exact_quantiles

    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.random() * 100 if rnd.random() > 0.1 else None)
            for _ in range(3000)] + [("solo", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.p50, r.p90) for r in exact_quantiles(df, "x", [0.5, 0.9], ["g"], ["p50", "p90"]).collect()}
    want = {r.g: (r.p50, r.p90) for r in df.groupBy("g").agg(
        F.percentile("x", F.lit(0.5)).alias("p50"), F.percentile("x", F.lit(0.9)).alias("p90")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9


def test_sequential_ids_with_sampled_range_bounds(spark):
    # enough keys (and a payload column) that the range partitioner samples
    rows = [(f"k{(i * 7919) % 60000:05d}", i % 13) for i in range(60000)]
    df = spark.createDataFrame(rows, "name string, payload int")
    got = sequential_ids(df, ["name"], "id", partitions=8).select("name", "id", "payload")
    w = Window.orderBy("name")
    want = df.select("name", F.row_number().over(w).alias("id"), "payload")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.fixture
def no_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield spark
    spark.conf.unset("spark.sql.exchange.reuse")


def test_quantiles_and_ids_do_not_need_exchange_reuse(no_reuse):
    from pyspark.sql import functions as F

    from freightlens.operators.quantiles import exact_quantiles

    df = no_reuse.range(0, 200_000, 1, 6).select((F.xxhash64("id") % 1_000_003).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect()}
    got = {r.g: [r.a, r.b] for r in exact_quantiles(df, "x", [0.1, 0.5], ["g"], ["a", "b"]).collect()}
    assert all(abs(x - y) < 1e-6 for g in want for x, y in zip(want[g], got[g]))
    ids = sequential_ids(df.select("x").distinct(), ["x"], "id", partitions=7).orderBy("x").collect()
    assert [r.id for r in ids] == list(range(1, len(ids) + 1))


def test_quantiles_of_equal_values_and_of_nothing(spark):
    from pyspark.sql import functions as F

    from freightlens.operators.profile import profile_counts
    from freightlens.operators.quantiles import exact_quantiles

    same = spark.range(1000).select(F.lit(7.0).alias("x"))
    assert exact_quantiles(same, "x", [0.25, 0.5], names=["a", "b"]).collect() == [(7.0, 7.0)]
    assert exact_quantiles(same.limit(0), "x", [0.5]).collect() == []
    none = spark.createDataFrame([], "booking_id string, booking_date timestamp")
    row = profile_counts(none).collect()
    assert len(row) == 1 and row[0].row_count == 0 and row[0].median_pings_per_booking is None


def test_fence_cells_find_all_and_few(spark):
    """Fences of very different radius, at the poles and the date line: all pings within are found, and few others looked at."""
    import math
    import random

    from pyspark.sql import functions as F

    from freightlens.operators import geofence as GF

    rng = random.Random(4)
    fences = [(f"F{i}", rng.uniform(-89.9, 89.9), rng.uniform(-180, 180), rng.choice([0.05, 1.0, 3.0, 40.0, 900.0])) for i in range(300)]
    fences += [("N", 89.99, 10.0, 30.0), ("S", -90.0, 0.0, 5.0), ("E", 0.0, 180.0, 3.0), ("W", 5.0, -179.999, 50.0)]
    pings = []
    for _, lat, lon, rad in fences:
        for share in (0.2, 0.97, 1.03):
            a, d = rng.uniform(0, 2 * math.pi), rad * share / 6371.0
            p, q = math.radians(lat), math.radians(lon)
            y = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(a))
            x = q + math.atan2(math.sin(a) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(y))
            pings.append((len(pings), math.degrees(y), (math.degrees(x) + 180) % 360 - 180))

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1.0)))

    want = {}
    for i, lat, lon in pings:
        near = [(km(lat, lon, y, x), f) for f, y, x, rad in fences if km(lat, lon, y, x) <= rad]
        want[i] = min(near)[1] if near else None
    fs = spark.createDataFrame(fences, "fence_id string, lat double, lon double, radius_km double")
    ps = spark.createDataFrame(pings, "i long, current_lat double, current_lon double")
    got = {r.i: r.fence_id for r in GF.nearest_fence(ps, fs, ["i"]).collect()}
    assert got == want and sum(v is not None for v in got.values()) > 600
    cells = GF.fence_cells(fs)
    assert cells.groupBy("fence_id").count().agg(F.max("count")).first()[0] <= 6 * 90  # 900 km: six rows of cells, all round near a pole
    small = cells.where("radius_km <= 40 and abs(lat) < 80").groupBy("fence_id").count()
    assert small.agg(F.max("count")).first()[0] <= 4


def test_candidates_per_ping_do_not_grow_with_the_area(spark):
    """Ten times the fences over ten times the area: as many candidates a ping."""
    from pyspark.sql import functions as F

    from freightlens.operators import geofence as GF

    def candidates(n):
        at = spark.range(n).select(F.concat(F.lit("F"), F.col("id").cast("string")).alias("fence_id"), (F.col("id") % 40 * 0.05).alias("lat"),
                                   (F.floor(F.col("id") / 40) * 0.05).alias("lon"), F.lit(3.0).alias("radius_km"))
        cells = GF.fence_cells(at)
        pings = GF.with_cells(at.select(F.col("lat").alias("current_lat"), F.col("lon").alias("current_lon")), GF.levels_of(cells))
        return pings.join(cells, GF.CELL).count() / n

    assert candidates(8000) < 1.2 * candidates(800) < 1.2 * 12


@pytest.mark.parametrize("few", [-1, 10**9])
def test_quantiles_by_both_ways(spark, monkeypatch, few):
    """The distributed ranks and the percentile over counted values agree with numpy, also with a hot value and a NULL group."""
    import numpy as np
    from pyspark.sql import functions as F

    from freightlens.operators import quantiles as QU

    monkeypatch.setattr(QU, "FEW_VALUES", few)
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.normal(0, 9, 400)] + [("a", 1.5)] * 300 + [(None, float(x)) for x in rng.integers(0, 7, 50)] + [("b", 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.q0, r.q1, r.q2) for r in QU.exact_quantiles(df, "x", [0.0, 0.5, 0.9], ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([x for h, x in rows if h == g and x is not None], [0.0, 0.5, 0.9]))
    whole = QU.exact_quantiles(df, "x", [0.25, 0.75], names=["lo", "hi"]).collect()
    assert len(whole) == 1 and np.allclose(list(whole[0]), np.quantile([x for _, x in rows if x is not None], [0.25, 0.75]))
    assert QU.exact_quantiles(df.where(F.lit(False)), "x", [0.5]).count() == 0
