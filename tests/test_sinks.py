"""Fact sinks: repeated loads, restated months, pruned reads; splits and permutations."""

import glob
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from freightlens.operators import mlprep as MP
from freightlens.operators import sinks as SK
from freightlens.plans import q_sinks
from freightlens.plans.q_sinks import _folder


def _facts(spark, months):
    rows = [(f"B{m}-{i}", m, float(i)) for m, n in months.items() for i in range(n)]
    return spark.createDataFrame(rows, "booking_id string, booking_month string, x double").withColumn("booking_ts", F.lit("2024-01-01").cast("timestamp"))


def test_restated_months_replace_and_others_stay(spark):
    path = _folder(spark, "t-ship")
    first = SK.shipment_rows(_facts(spark, {"2024-01": 5, "2024-02": 4, None: 2}), 1, F.lit("2025-01-01").cast("timestamp"))
    SK.write_shipments(first, path)
    second = SK.shipment_rows(_facts(spark, {"2024-02": 3, "2024-03": 1}), 2, F.lit("2025-02-01").cast("timestamp"))
    for _ in range(2):
        SK.write_shipments(second, path)
    back = SK.read_back(spark, path, first)
    assert Counter(r.booking_month for r in back.collect()) == {"2024-01": 5, "2024-02": 3, "2024-03": 1, None: 2}
    ids = [r.shipment_id for r in back.collect()]
    assert len(set(ids)) == len(ids)
    assert {i >> SK.ID_BITS for i in ids} == {1, 2}


def test_append_by_load_is_idempotent_and_pruned(spark):
    path = _folder(spark, "t-ping")
    day = lambda d, n: spark.range(n).select(F.format_string("B%d", F.col("id")).alias("booking_id"), F.lit(d).cast("timestamp").alias("ping_ts"),
                                             F.lit(d).cast("date").alias("ping_date"))
    first = SK.ping_rows(day("2024-01-01", 4), 1)
    SK.write_pings(first, path, 1)
    for n in (5, 3):  # the second attempt of load 2 has fewer rows and replaces the first
        SK.write_pings(SK.ping_rows(day("2024-01-01", n).unionByName(day("2024-01-02", n)), 2), path, 2)
    back = SK.read_back(spark, path, first, load=True)
    assert Counter((r.load, str(r.ping_date)) for r in back.collect()) == {(1, "2024-01-01"): 4, (2, "2024-01-01"): 3, (2, "2024-01-02"): 3}
    assert len({r.ping_id for r in back.collect()}) == 10
    pruned = back.where(F.col("ping_date") == F.lit("2024-01-02").cast("date"))
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ping_date" in plan
    assert pruned.select(F.input_file_name()).distinct().count() == 1 < back.select(F.input_file_name()).distinct().count()


def test_one_large_month_is_written_by_several_tasks(spark):
    """Rebalancing splits a partition by its size instead of giving each month one task."""
    path = _folder(spark, "t-large")
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60_000, 1, 8).select(F.concat(F.lit("B"), F.xxhash64("id").cast("string")).alias("booking_id"), F.lit("2024-01").alias("booking_month"))
        SK.restate(rows.unionByName(spark.range(3).select(F.col("id").cast("string"), F.lit("2024-02")).toDF("booking_id", "booking_month")), path, "booking_month", ["booking_id"])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(glob.glob(f"{path}/booking_month=2024-01/*.parquet")) > 1
    assert len(glob.glob(f"{path}/booking_month=2024-02/*.parquet")) == 1


def test_history_scores(spark):
    rows = [("a", "S", 1, 2.0), ("a", "S", 0, 4.0), ("a", "S", None, None), (None, "S", 1, 1.0), ("b", None, None, None)]
    e = spark.createDataFrame(rows, "distance_band string, shipment_type string, is_late int, trip_days double").withColumns(
        {"trip_start": F.lit("2024-01-01").cast("timestamp"), "planned_eta": F.lit("2024-01-02").cast("timestamp"), "booking_id": F.lit("x")})
    got = [(r.distance_band, round(r.late_probability, 4) if r.late_probability else None, r.predicted_delay_h) for r in SK.history_scores(e).collect()]
    assert sorted(got, key=str) == sorted([("a", 0.5, 48.0)] * 3 + [(None, 0.6667, 0.0), ("b", None, None)], key=str)


# --- M3, R8


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_split_is_exact_by_class(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("booking_id"), F.when(F.col("id") % 7 == 3, None).otherwise(F.col("id") % 3).alias("y"))
    got = MP.stratified_split(df, "y").collect()
    assert len(got) == n
    size, test = Counter(r.y for r in got), Counter(r.y for r in got if r.split == "test")
    assert all(test[c] == math.floor(size[c] * 0.2 + 0.5) for c in size)
    again = {r.booking_id: r.split for r in MP.stratified_split(df.repartition(5), "y").collect()}
    assert again == {r.booking_id: r.split for r in got}
    other = {r.booking_id: r.split for r in MP.stratified_split(df, "y", seed=7).collect()}
    assert n < 100 or other != again


def test_split_keeps_equal_keys_together(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 2000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("booking_id"), F.lit(1).alias("y"))
    got = MP.stratified_split(df, "y").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("booking_id") == "same").alias("hot")).collect()
    sizes = {r.split: (r.n, r.hot) for r in got}
    assert sizes["test"][1] in (0, 2000) and sizes["test"][0] <= 800


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 1009, 4099])
def test_permutation_is_a_bijection(spark, n):
    rows = spark.range(n).select("id", MP.permuted(F.col("id"), n, 1).alias("a"), MP.permuted(F.col("id"), n, 2).alias("b")).collect()
    assert sorted(r.a for r in rows) == sorted(r.b for r in rows) == list(range(n))
    assert n < 16 or sum(r.a == r.id for r in rows) < max(8, n // 8) and [r.a for r in rows] != [r.b for r in rows]


def test_speeds_of_pings_close_in_time_fit(spark):
    """Two pings a microsecond and 217 km or half the globe apart: the fact and its sink hold the speeds."""
    from freightlens.operators import gps as G
    from freightlens.operators import warehouse as W

    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("us"))
    rows = [("B1", 0, 10.0, 70.0, 1), ("B1", 1, 12.0, 70.0, 2), ("B2", 0, 0.0, 0.0, 3), ("B2", 1, 0.0, 180.0, 4)]
    pings = spark.createDataFrame(rows, "booking_id string, us long, current_lat double, current_lon double, ping_seq long")
    pings = pings.select("booking_id", at.alias("gps_ping_time"), "current_lat", "current_lon", "ping_seq", F.lit("G0").alias("gps_provider"), at.alias("ingest_ts"))
    path = _folder(spark, "t-speed")
    facts = SK.ping_rows(W.fact_gps_ping(G.preprocess_trajectory(pings)), 1)
    SK.write_pings(facts, path, 1)
    got = {(r.booking_id, r.ping_id & 1): r.speed_kmph for r in SK.read_back(spark, path, facts, load=True).collect()}
    speeds = [float(v) for _, v in sorted(got.items()) if v is not None]
    assert len(got) == 4 and len(speeds) == 2
    assert math.isclose(speeds[0], 222.38985 * 3.6e9, rel_tol=1e-5) and math.isclose(speeds[1], math.pi * 6371 * 3.6e9, rel_tol=1e-6)


def test_shipment_loads_read_the_joined_facts_once(spark, monkeypatch):
    """Both loads rank and write a table of facts; the joins with the dimensions aren't run again for each."""
    seen = []

    def facts(enriched, dims):
        keys = spark.createDataFrame([(f"B{i}", f"199{5 + i % 2}-0{1 + i % 9}") for i in range(20)], "booking_id string, booking_month string")
        return keys.join(keys.select("booking_id", F.lit("1996-01-01").cast("timestamp").alias("booking_ts")).hint("merge"), "booking_id")

    real = SK.shipment_rows
    monkeypatch.setattr(q_sinks.ctx, "enriched", lambda *a: None)
    monkeypatch.setattr(q_sinks.ctx, "dimensions", lambda *a: None)
    monkeypatch.setattr(q_sinks.W, "fact_shipment", facts)
    monkeypatch.setattr(q_sinks.SK, "shipment_rows", lambda rows, *a: seen.append(rows) or real(rows, *a))
    got = q_sinks.fact_shipment_sink(spark, "none").collect()
    assert len(seen) == 2 and not any("Join" in r._jdf.queryExecution().optimizedPlan().toString() for r in seen)
    assert sorted((r.booking_id, r.shipment_id >> 40) for r in got) == sorted((f"B{i}", 1 + i % 2) for i in range(20))
