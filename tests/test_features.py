from shipment_rows import shipments, ts
from freightlens.operators.clean import clean_shipments
from freightlens.operators.features import engineer_features
from freightlens.operators.kpis import executive_kpis, fleet_utilization, segment_performance


def _enrich(spark, rows):
    return engineer_features(clean_shipments(shipments(spark, rows))[0])


def test_trip_end_null_keeps_nulls(spark):
    r = _enrich(spark, [{"trip_end": None}]).first()
    assert r.moving_hours is None and r.trip_days is None and r.idle_days_proxy is None and r.avg_speed_kmph is None


def test_actual_null_is_not_late(spark):
    r = _enrich(spark, [{"actual_eta": None}]).first()
    assert r.delay_hours is None and r.is_late == 0


def test_identical_endpoints_no_detour(spark):
    r = _enrich(spark, [{"origin_lat": 5.0, "origin_lon": 5.0, "dest_lat": 5.0, "dest_lon": 5.0}]).first()
    assert r.geo_distance_km == 0.0 and r.route_detour_ratio is None


def test_specialization_band_order_ties(spark):
    rows = [
        {"booking_id": "1", "supplier_name": "S", "distance_km": 150.0},
        {"booking_id": "2", "supplier_name": "S", "distance_km": 160.0},
        {"booking_id": "3", "supplier_name": "S", "distance_km": 1500.0},
        {"booking_id": "4", "supplier_name": "S", "distance_km": 1600.0},
        {"booking_id": "5", "supplier_name": "T", "distance_km": 400.0},
        {"booking_id": "6", "supplier_name": "T", "distance_km": 1500.0},
    ]
    got = {r.supplier_name: r.supplier_specialization for r in _enrich(spark, rows).collect()}
    assert got == {"S": "100-300km", "T": "300-600km"}


def test_null_route_month_material_customer(spark):
    r = _enrich(spark, [{"origin_location": None, "booking_date": None, "material_shipped": None,
                         "customer_name": None}]).first()
    assert r.route_id == "nan → B" and r.booking_month == "NaT"
    assert r.material_group == "Other" and r.customer_tier == "long_tail"


def test_zero_min_daily_km_and_zero_moving(spark):
    r = _enrich(spark, [{"min_daily_km": 0.0, "trip_end": ts("2024-01-01 06:00:00")}]).first()
    assert r.expected_days is None and r.avg_speed_kmph is None


def test_kpi_null_groups_and_counts(spark):
    rows = [{"booking_id": f"b{i}", "vehicle_type": None, "distance_km": None} for i in range(3)]
    rows += [{"booking_id": None, "vehicle_type": "V9"}, {"booking_id": "x", "vehicle_type": "V9"}]
    e = _enrich(spark, rows)
    seg = {r.vehicle_type: r.total_bookings for r in segment_performance(e, "vehicle_type", 1).collect()}
    assert seg == {None: 3, "V9": 1}  # NULL group kept, NULL booking id not counted
    assert {r.vehicle_type for r in fleet_utilization(e).collect()} == {"V9"}
    assert executive_kpis(e).first().total_bookings == 4


def test_row_count_unchanged_and_segments_sum(spark):
    rows = [{"booking_id": f"b{i}", "supplier_name": f"S{i % 4}", "distance_km": 40.0 * i} for i in range(40)]
    clean = clean_shipments(shipments(spark, rows))[0]
    e = engineer_features(clean)
    assert e.count() == clean.count() == 40
    total = sum(r.total_bookings for r in segment_performance(e, "supplier_name", 0).collect())
    assert total == 40
