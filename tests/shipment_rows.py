"""Canonical shipment rows for tests."""

from datetime import datetime

from freightlens.config import SHIPMENT_SCHEMA


def ts(text):
    return datetime.fromisoformat(text) if text else None


BASE = {
    "gps_provider": "G0", "booking_id": "B1", "shipment_type": "Regular",
    "booking_date": ts("2024-01-01 00:00:00"), "vehicle_registration": "R1", "origin_location": "A",
    "destination_location": "B", "origin_lat": 10.0, "origin_lon": 70.0, "dest_lat": 11.0, "dest_lon": 71.0,
    "gps_ping_time": ts("2024-01-01 12:00:00"), "planned_eta": ts("2024-01-03 00:00:00"),
    "current_location": "B", "actual_eta": ts("2024-01-03 00:00:00"), "current_lat": 10.5, "current_lon": 70.5,
    "ontime_flag": "Yes", "trip_start": ts("2024-01-01 06:00:00"), "trip_end": ts("2024-01-02 06:00:00"),
    "distance_km": 250.0, "vehicle_type": "V1", "min_daily_km": 200.0, "driver_name": "D1",
    "driver_mobile": "M1", "customer_name": "C1", "supplier_name": "S1", "material_shipped": "M",
}


def shipments(spark, rows):
    """Canonical shipment rows: each dict overrides BASE."""
    data = []
    for r in rows:
        d = dict(BASE)
        d.update(r)
        data.append(tuple(d[f.name] for f in SHIPMENT_SCHEMA.fields))
    return spark.createDataFrame(data, SHIPMENT_SCHEMA)
