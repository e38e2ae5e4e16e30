"""Column-level helpers (all built-in Spark expressions, codegen-friendly)."""

from .columns import (  # noqa: F401
    band_ordinal,
    band_sql,
    clip0,
    distance_band,
    haversine_km,
    hours_between,
    label_for_ordinal,
    null_false,
    r,
    route_category,
    add_hours,
)
