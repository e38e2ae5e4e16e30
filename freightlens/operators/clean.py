"""Booking dedupe, flag normalisation, imputation, lifecycle rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_ABS_DELAY_HOURS, MAX_TRIP_DAYS, MIN_WAIT_HOURS
from ..functions.columns import distance_band, hours_between, null_false
from .dedupe import keep_first, snapshot_order

_MASKS = ("_invalid_trip", "_extreme_delay", "_bad_wait")


def dedupe_bookings(df: DataFrame) -> DataFrame:
    """One row per booking_id; prefer a row with actual_eta, then the
    latest ping, then the earliest trip start, then the tie key.  Helper
    ``_tie`` (if present) is the last tie-break; otherwise the whole row."""
    tie = F.col("_tie") if "_tie" in df.columns else F.struct(
        *[F.col(c) for c in df.columns if c != "booking_id"]
    )
    order = snapshot_order({**{c: F.col(c) for c in ("actual_eta", "gps_ping_time", "trip_start")}, "_tie": tie})
    return keep_first(df, ["booking_id"], order, drop=["_tie"])


def normalise_flag(col: str = "ontime_flag"):
    """Strip all surrounding whitespace and title-case; text 'nan' -> NULL."""
    norm = F.initcap(F.btrim(F.col(col), F.lit(" \t\n\r\x0b\x0c")))
    return F.when(norm == "Nan", F.lit(None).cast("string")).otherwise(norm)


def is_ontime(col: str = "ontime_flag"):
    """1 when the normalised flag is 'Yes', else 0 (NULL counts as 0)."""
    return null_false(F.col(col) == "Yes").cast("int")


def vehicle_mode_by_band(df: DataFrame) -> DataFrame:
    """Most frequent vehicle type per distance band (ties -> lowest text).

    ``mode`` is combined map-side; the result has at most 5 rows."""
    return (
        df.where(F.col("vehicle_type").isNotNull() & F.col("distance_band").isNotNull())
        .groupBy("distance_band")
        .agg(F.mode("vehicle_type", deterministic=True).alias("_band_vehicle"))
    )


def _rules(deduped: DataFrame) -> DataFrame:
    """C2-C4 and C7-C9, with the rule masks kept as helper columns.

    None of these read the vehicle type, so they run before the imputation
    and the stage can be materialized once (see ``clean_shipments``)."""
    df = deduped.withColumns(
        {
            "ontime_flag": normalise_flag(),
            "distance_km": F.col("distance_km").cast("double"),
        }
    ).withColumns(
        {
            "is_ontime": is_ontime(),
            "distance_band": distance_band("distance_km"),
        }
    )
    trip_days = hours_between("trip_end", "trip_start") / 24.0
    delay_h = hours_between("actual_eta", "planned_eta")
    wait_h = hours_between("trip_start", "booking_date")
    df = df.withColumns(
        {
            "_invalid_trip": null_false((trip_days < 0) | (trip_days > MAX_TRIP_DAYS)),
            "_extreme_delay": null_false(F.abs(delay_h) > MAX_ABS_DELAY_HOURS),
            "_bad_wait": null_false(wait_h < MIN_WAIT_HOURS),
        }
    )
    return df.withColumns(
        {
            "trip_end": F.when(F.col("_invalid_trip"), F.lit(None).cast("timestamp")).otherwise(F.col("trip_end")),
            "actual_eta": F.when(F.col("_extreme_delay"), F.lit(None).cast("timestamp")).otherwise(
                F.col("actual_eta")
            ),
            "booking_date": F.when(F.col("_bad_wait"), F.col("trip_start")).otherwise(F.col("booking_date")),
        }
    )


def impute_vehicle_types(df: DataFrame) -> DataFrame:
    """Fill a missing vehicle type with its band's most frequent type
    and flag it.  The mode table has at most 5 rows: a bounded broadcast."""
    modes = F.broadcast(vehicle_mode_by_band(df))
    out = df.join(modes, "distance_band", "left")
    missing = F.col("vehicle_type").isNull()
    return out.withColumns(
        {
            "vehicle_type_imputed": missing & F.col("_band_vehicle").isNotNull(),
            "vehicle_type": F.coalesce(F.col("vehicle_type"), F.col("_band_vehicle")),
        }
    ).drop("_band_vehicle")


def _staged(deduped: DataFrame) -> DataFrame:
    """C2-C9 with the rule masks kept as helper columns."""
    return impute_vehicle_types(_rules(deduped))


def quality_log(raw: DataFrame, staged: DataFrame) -> DataFrame:
    """(step, metric, value) rows for the five cleaning steps."""
    before = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    after = staged.agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.count_if("vehicle_type_imputed").alias("imputed"),
        F.count_if("_invalid_trip").alias("invalid_trip"),
        F.count_if("_extreme_delay").alias("extreme_delay"),
        F.count_if("_bad_wait").alias("bad_wait"),
    )
    # Both sides are single-row global aggregates.
    return before.crossJoin(F.broadcast(after)).selectExpr(
        "stack(5, "
        "'dedupe_bookings', 'rows_removed', raw_rows - clean_rows, "
        "'impute_vehicle_type', 'imputed_count', imputed, "
        "'null_invalid_trip_end', 'count', invalid_trip, "
        "'null_extreme_delay_eta', 'count', extreme_delay, "
        "'fix_booking_after_start', 'count', bad_wait"
        ") AS (step, metric, value)"
    ).withColumn("value", F.col("value").cast("bigint"))


def clean_shipments(raw: DataFrame, materialize=None, deduped: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (clean, quality_log).  ``deduped`` is C1 of ``raw``, where the source has a shorter way
    to it; ``raw`` is then only counted, by the columns its joins need.

    ``materialize`` (e.g. a write to the checkpoint folder) is applied after
    dedupe + rules, so the band-mode lookup reads two columns of that table
    instead of re-running the scan, joins and dedupe in a second branch."""
    ruled = _rules(dedupe_bookings(raw) if deduped is None else deduped)
    if materialize is not None:
        ruled = materialize(ruled)
    staged = impute_vehicle_types(ruled)
    return staged.drop(*_MASKS), quality_log(raw, staged)
