"""Null-safe column expressions shared by every operator.

Rules (see the semantic notes in the README):
- missing values stay NULL, never NaN;
- ``clip0`` keeps NULLs (``greatest`` would turn them into 0);
- comparisons on NULL count as false where a flag is produced;
- divisions are guarded so ANSI mode never raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    DISTANCE_LABELS,
    EARTH_RADIUS_KM,
    LONG_HAUL_DISTANCE_KM,
    URBAN_DISTANCE_KM,
)

_MICROS_PER_HOUR = 3_600_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hours_between(end, start) -> Column:
    """Fractional hours ``end - start`` (NULL if either side is NULL)."""
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(float(_MICROS_PER_HOUR))


def add_hours(ts, hours) -> Column:
    """``ts + hours`` for an integral hour count, exact in microseconds."""
    return F.timestamp_micros(F.unix_micros(_c(ts)) + _c(hours).cast("bigint") * F.lit(_MICROS_PER_HOUR))


def clip0(x) -> Column:
    """Lower-clip at 0 keeping NULL."""
    x = _c(x)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def null_false(cond: Column) -> Column:
    """A boolean where NULL counts as false."""
    return F.coalesce(cond, F.lit(False))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance (asin form, R = 6371 km); NULL in -> NULL out."""
    p1, l1, p2, l2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)
    # Rounding can push ``a`` a hair above 1; clamp without touching NULL.
    a = F.when(a > 1.0, F.lit(1.0)).otherwise(a)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def _banded(distance, values) -> Column:
    """Right-closed bins, lowest bin includes 0; negative/NULL -> NULL.  ``values`` are the five bins'."""
    d = _c(distance)
    return (
        F.when(d.isNull() | (d < 0) | F.isnan(d), F.lit(None).cast("string" if isinstance(values[0], str) else "int"))
        .when(d <= 100, values[0])
        .when(d <= 300, values[1])
        .when(d <= 600, values[2])
        .when(d <= 1200, values[3])
        .otherwise(values[4])
    )


def band_ordinal(distance) -> Column:
    return _banded(distance, range(5))


def label_for_ordinal(ordinal) -> Column:
    o = _c(ordinal)
    expr = F.lit(None).cast("string")
    for i, label in reversed(list(enumerate(DISTANCE_LABELS))):
        expr = F.when(o == i, F.lit(label)).otherwise(expr)
    return expr


def distance_band(distance) -> Column:
    """The label of the bin; labels of an ordinal's expression would repeat it for each label."""
    return _banded(distance, DISTANCE_LABELS)


def band_sql(distance) -> Column:
    """Banding of the warehouse view: negative -> first band, NULL -> last."""
    d = _c(distance)
    return (
        F.when(d <= 100, "0-100km")
        .when(d <= 300, "100-300km")
        .when(d <= 600, "300-600km")
        .when(d <= 1200, "600-1200km")
        .otherwise("1200km+")
    )


def route_category(distance) -> Column:
    """<=150 short, <=600 mid, everything else (NULL included) long haul."""
    d = _c(distance)
    return (
        F.when(d <= URBAN_DISTANCE_KM, "short_haul")
        .when(d <= LONG_HAUL_DISTANCE_KM, "mid_haul")
        .otherwise("long_haul")
    )


def r(x, n: int = 4) -> Column:
    """Report rounding used on every floating output: round(x + 1e-9, n)."""
    return F.round(_c(x) + F.lit(1e-9), n)
