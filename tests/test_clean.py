from pyspark.sql import functions as F

from shipment_rows import shipments, ts
from freightlens.operators.clean import clean_shipments, dedupe_bookings


def test_dedupe_prefers_actual_then_latest_ping(spark):
    df = shipments(spark, [
        {"booking_id": "B1", "actual_eta": None, "gps_ping_time": ts("2024-01-01 12:00:00"), "material_shipped": "x"},
        {"booking_id": "B1", "gps_ping_time": ts("2024-01-01 09:00:00"), "material_shipped": "y"},
        {"booking_id": "B2", "gps_ping_time": ts("2024-01-01 09:00:00"), "material_shipped": "a"},
        {"booking_id": "B2", "gps_ping_time": ts("2024-01-01 10:00:00"), "material_shipped": "b"},
        {"booking_id": None, "material_shipped": "n1"},
        {"booking_id": None, "material_shipped": "n2"},
    ])
    out = {r.booking_id: r.material_shipped for r in dedupe_bookings(df).collect()}
    assert out["B1"] == "y" and out["B2"] == "b"
    assert len(out) == 3  # two NULL ids collapse to one row


def test_dedupe_idempotent_and_unique(spark):
    df = shipments(spark, [{"booking_id": f"B{i % 3}", "distance_km": float(i)} for i in range(9)])
    once = dedupe_bookings(df)
    twice = dedupe_bookings(once)
    assert once.count() == 3 and once.select("booking_id").distinct().count() == 3
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_flags_and_is_ontime(spark):
    df = shipments(spark, [
        {"booking_id": "a", "ontime_flag": None}, {"booking_id": "b", "ontime_flag": "yes"},
        {"booking_id": "c", "ontime_flag": "\tYES "}, {"booking_id": "d", "ontime_flag": "No"},
    ])
    clean, _ = clean_shipments(df)
    got = {r.booking_id: (r.ontime_flag, r.is_ontime) for r in clean.collect()}
    assert got == {"a": (None, 0), "b": ("Yes", 1), "c": ("Yes", 1), "d": ("No", 0)}


def test_lifecycle_rules(spark):
    start = ts("2024-01-01 00:00:00")
    df = shipments(spark, [
        {"booking_id": "t91", "trip_start": start, "trip_end": ts("2024-04-01 00:00:00")},
        {"booking_id": "t90", "trip_start": start, "trip_end": ts("2024-03-31 00:00:00")},
        {"booking_id": "tneg", "trip_start": start, "trip_end": ts("2023-12-31 23:00:00")},
        {"booking_id": "d721", "planned_eta": start, "actual_eta": ts("2024-01-31 01:00:00")},
        {"booking_id": "d720", "planned_eta": start, "actual_eta": ts("2024-01-31 00:00:00")},
        {"booking_id": "w25", "trip_start": start, "booking_date": ts("2024-01-02 01:00:00")},
        {"booking_id": "w24", "trip_start": start, "booking_date": ts("2024-01-02 00:00:00")},
    ])
    clean, log = clean_shipments(df)
    r = {x.booking_id: x for x in clean.collect()}
    assert r["t91"].trip_end is None and r["t90"].trip_end is not None and r["tneg"].trip_end is None
    assert r["d721"].actual_eta is None and r["d720"].actual_eta is not None
    assert r["w25"].booking_date == start and r["w24"].booking_date == ts("2024-01-02 00:00:00")
    steps = {x.step: x.value for x in log.collect()}
    assert steps["null_invalid_trip_end"] == 2 and steps["null_extreme_delay_eta"] == 1
    assert steps["fix_booking_after_start"] == 1 and steps["dedupe_bookings"] == 0


def test_vehicle_imputation_by_band_mode(spark):
    df = shipments(spark, [
        {"booking_id": "1", "distance_km": 50.0, "vehicle_type": "B"},
        {"booking_id": "2", "distance_km": 60.0, "vehicle_type": "A"},
        {"booking_id": "3", "distance_km": 70.0, "vehicle_type": None},
        {"booking_id": "4", "distance_km": None, "vehicle_type": None},
    ])
    clean, _ = clean_shipments(df)
    r = {x.booking_id: (x.vehicle_type, x.vehicle_type_imputed) for x in clean.collect()}
    assert r["3"] == ("A", True)  # tie -> lowest text
    assert r["4"] == (None, False)  # no band -> not imputed
