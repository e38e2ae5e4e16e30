"""Keep-first-per-key as an aggregate, not a window.

``groupBy(key).agg(min_by(row, sort_key))`` is combined map-side, so a key
holding a third of all rows collapses to one row per input partition before
the shuffle instead of landing whole in one window task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], sort_keys: Sequence[Column], drop: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``: the row whose ``sort_keys`` tuple is smallest, without the columns ``drop``.

    A row is carried with its key and sort keys, so columns that only these are made of are best dropped here.

    ``sort_keys`` are compared ascending with NULL first; callers encode
    descending / nulls-last orders themselves (see ``asc_nulls_last``,
    ``desc_nulls_last``).  NULL keys form one group (they collapse to one row).
    """
    kept = [c for c in df.columns if c not in drop]
    payload = F.struct(*[F.col(c) for c in kept if c not in keys] or [F.lit(0).alias("_none")])
    order = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys)])
    return (
        df.groupBy(*keys)
        .agg(F.min_by(payload, order).alias("_row"))
        .select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in kept])
    )


def asc_nulls_last(col: Column) -> list[Column]:
    return [col.isNull(), col]


def desc_nulls_last(col: Column, is_timestamp: bool = False) -> list[Column]:
    v = F.unix_micros(col) if is_timestamp else col
    return [col.isNull(), -v]


def snapshot_order(cols: Mapping[str, Column]) -> list[Column]:
    """C1's order of a booking's snapshots: with an actual ETA first, then the latest ping, the earliest trip
    start and the tie key, each an expression of ``cols``."""
    return (
        [cols["actual_eta"].isNull()]
        + desc_nulls_last(cols["gps_ping_time"], is_timestamp=True)
        + asc_nulls_last(F.unix_micros(cols["trip_start"]))
        + [cols["_tie"]]
    )
