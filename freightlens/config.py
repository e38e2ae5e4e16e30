"""Constants and canonical schemas.

Fixed values that must equal the original pipeline's for matching results
(distance bins and labels, thresholds, seed, column map) are kept together
here, as text, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must match the original pipeline exactly)
# ---------------------------------------------------------------------------
DISTANCE_BINS = [0.0, 100.0, 300.0, 600.0, 1200.0, float("inf")]
DISTANCE_LABELS = ["0-100km", "100-300km", "300-600km", "600-1200km", "1200km+"]
URBAN_DISTANCE_KM = 150.0
LONG_HAUL_DISTANCE_KM = 600.0
RANDOM_STATE = 42
ML_TEST_SIZE = 0.2
EARTH_RADIUS_KM = 6371.0
ROUTE_ARROW = " → "

# Source header -> canonical name.  The source header typo
# "Curren Location Longitude" is the real input name and is kept.
COLUMN_MAP = {
    "Gps Provider": "gps_provider",
    "Booking ID": "booking_id",
    "Shipment Type": "shipment_type",
    "Booking Date": "booking_date",
    "Vehicle Registration": "vehicle_registration",
    "Origin Location": "origin_location",
    "Destination Location": "destination_location",
    "Origin Location Latitude": "origin_lat",
    "Origin Location Longitude": "origin_lon",
    "Destination Location Latitude": "dest_lat",
    "Destination Location Longitude": "dest_lon",
    "Data Ping time": "gps_ping_time",
    "Planned ETA": "planned_eta",
    "Current Location": "current_location",
    "Actual ETA": "actual_eta",
    "Current Location Latitude": "current_lat",
    "Curren Location Longitude": "current_lon",
    "Ontime": "ontime_flag",
    "Trip Start Date": "trip_start",
    "Trip End Date": "trip_end",
    "Transportation Distance (KM)": "distance_km",
    "Vehicle Type": "vehicle_type",
    "Minimum Kms To Be Covered In A Day": "min_daily_km",
    "Driver Name": "driver_name",
    "Driver Mobile No": "driver_mobile",
    "Customer Name": "customer_name",
    "Supplier Name": "supplier_name",
    "Material Shipped": "material_shipped",
}

TIMESTAMP_COLUMNS = [
    "booking_date",
    "gps_ping_time",
    "planned_eta",
    "actual_eta",
    "trip_start",
    "trip_end",
]
DOUBLE_COLUMNS = [
    "origin_lat",
    "origin_lon",
    "dest_lat",
    "dest_lon",
    "current_lat",
    "current_lon",
    "distance_km",
    "min_daily_km",
]

# Thresholds used by cleaning, features and rules (fixed values).
MAX_TRIP_DAYS = 90
MAX_ABS_DELAY_HOURS = 24 * 30
MIN_WAIT_HOURS = -24
EXTREME_DELAY_HOURS = 24 * 365
ENTERPRISE_MIN_BOOKINGS = 200
MID_MARKET_MIN_BOOKINGS = 50
TOP_MATERIALS = 15
SLOW_MOVING_KMPH = 50.0
IDLE_SPEED_KMPH = 2.0
IDLE_MIN_HOURS = 2.0
SES_ALPHA = 0.35
IFOREST_CONTAMINATION = 0.08

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
_TYPED = {c: T.TimestampType() for c in TIMESTAMP_COLUMNS}
_TYPED.update({c: T.DoubleType() for c in DOUBLE_COLUMNS})

# Canonical, typed shipment schema (in source column order).
SHIPMENT_SCHEMA = T.StructType(
    [T.StructField(c, _TYPED.get(c, T.StringType()), True) for c in COLUMN_MAP.values()]
)

# Raw schema: every source header as a string (the sheet arrives as text).
RAW_SHIPMENT_SCHEMA = T.StructType(
    [T.StructField(src, T.StringType(), True) for src in COLUMN_MAP]
)

DICTIONARY_SCHEMA = T.StructType(
    [
        T.StructField("field", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
    ]
)

PING_SCHEMA = T.StructType(
    [
        T.StructField("booking_id", T.StringType(), True),
        T.StructField("gps_ping_time", T.TimestampType(), True),
        T.StructField("current_lat", T.DoubleType(), True),
        T.StructField("current_lon", T.DoubleType(), True),
        T.StructField("speed_kmph", T.DoubleType(), True),
        T.StructField("heading_deg", T.DoubleType(), True),
        T.StructField("gps_provider", T.StringType(), True),
        T.StructField("ingest_ts", T.TimestampType(), True),
    ]
)

# The documented body of a single ping (the booking id comes with the request).
PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("ping_ts", T.TimestampType(), True),
        T.StructField("latitude", T.DoubleType(), True),
        T.StructField("longitude", T.DoubleType(), True),
        T.StructField("speed_kmph", T.DoubleType(), True),
        T.StructField("heading_deg", T.DoubleType(), True),
        T.StructField("gps_provider", T.StringType(), True),
    ]
)
