"""Peer benchmark, capability gap, bottleneck decomposition, model frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SLOW_MOVING_KMPH
from ..functions.columns import clip0, r

PEER_KEYS = ["distance_band", "vehicle_type"]


def peer_benchmark(df: DataFrame) -> DataFrame:
    """Mean on-time and delay per band x vehicle (NULL groups kept)."""
    return df.groupBy(*PEER_KEYS).agg(
        F.avg("is_ontime").alias("peer_ontime"), F.avg("delay_hours").alias("peer_delay")
    )


def _gap(rows: DataFrame, peer: DataFrame, keys: list[str]) -> DataFrame:
    # Vehicle type is free text, so the peer table has no bound: its measured size decides how it is joined.
    merged = rows.where(F.col("distance_band").isNotNull() & F.col("vehicle_type").isNotNull()).join(peer, PEER_KEYS, "left")
    return merged.groupBy(*keys).agg(
        F.count("booking_id").alias("bookings"),
        F.avg("is_ontime").alias("ontime_rate"),
        F.max("peer_ontime").alias("peer_ontime"),
        F.avg(F.col("is_ontime") - F.col("peer_ontime")).alias("ontime_gap"),
        F.avg("delay_hours").alias("avg_delay_h"),
        F.max("peer_delay").alias("peer_delay_h"),
    )


def capability_gap(df: DataFrame, supplier) -> DataFrame:
    """R2: one supplier vs its band x vehicle peers (peer mean includes it).

    ``supplier`` is a name or a one-column DataFrame of names."""
    if isinstance(supplier, str):
        rows = df.where(F.col("supplier_name") == supplier)
    else:
        rows = df.join(supplier.select("supplier_name").distinct(), "supplier_name", "left_semi")
    return _gap(rows, peer_benchmark(df), PEER_KEYS)


def capability_gap_all(df: DataFrame) -> DataFrame:
    """R2 for every supplier in one pass."""
    rows = df.where(F.col("supplier_name").isNotNull())
    return _gap(rows, peer_benchmark(df), ["supplier_name", *PEER_KEYS])


def largest_supplier(df: DataFrame) -> DataFrame:
    """Top supplier by volume (ties -> name), as a one-row DataFrame."""
    return (
        df.where(F.col("supplier_name").isNotNull())
        .groupBy("supplier_name")
        .agg(F.count("booking_id").alias("_n"))
        .orderBy(F.col("_n").desc(), "supplier_name")
        .limit(1)
        .select("supplier_name")
    )


BOTTLENECK_COMPONENTS = [
    "waiting_before_dispatch",
    "slow_moving_trip",
    "unloading_after_arrival",
    "idle_beyond_contract_pace",
]


def bottleneck(df: DataFrame) -> DataFrame:
    """Hours per delay component and its share of the positive delay pool."""
    sums = df.agg(
        F.sum(clip0("delay_hours")).alias("pool"),
        F.sum("wait_hours").alias("c0"),
        F.sum(clip0(F.col("moving_hours") - F.col("distance_km") / SLOW_MOVING_KMPH)).alias("c1"),
        F.sum("unloading_hours").alias("c2"),
        F.sum(F.col("idle_days_proxy") * 24.0).alias("c3"),
    )
    stacked = sums.selectExpr(
        "pool",
        "stack(4, "
        + ", ".join(f"'{name}', coalesce(c{i}, 0D)" for i, name in enumerate(BOTTLENECK_COMPONENTS))
        + ") AS (component, hours_sum)",
    )
    pool = F.coalesce(F.col("pool"), F.lit(0.0))
    return stacked.select(
        "component",
        "hours_sum",
        F.when(pool > 0, r(F.col("hours_sum") / pool * 100.0, 2)).otherwise(F.lit(0.0)).alias(
            "share_of_positive_delay_pool"
        ),
    )


MODEL_NUMERIC = ["distance_km", "route_detour_ratio", "wait_hours", "avg_speed_kmph", "km_per_day"]
MODEL_CATEGORICAL = [
    "shipment_type", "vehicle_type", "route_category", "distance_band", "material_group",
    "supplier_name", "customer_tier", "booking_dow",
]


def model_frame(df: DataFrame, keep_id: bool = True) -> DataFrame:
    """Rows with a delay and complete numerics; 13 inputs + 3 targets."""
    cols = (["booking_id"] if keep_id else []) + MODEL_NUMERIC + MODEL_CATEGORICAL + [
        "delay_hours", "is_late", "is_ontime"
    ]
    m = df.where(F.col("delay_hours").isNotNull()).select(*cols)
    return m.dropna(subset=MODEL_NUMERIC)
