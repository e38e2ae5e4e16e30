"""D5/D6 batch twins: geofence entry/exit events and predicted-delay alerts.

Fence matching is a range join done as an equi-join on grid cells of several sizes.  A
fence is put into the few cells it touches at the smallest size that its reach doesn't exceed, so a
small fence meets only pings nearby, and a large one doesn't take many cells.  A ping looks
into its own cell at each size that some fence uses, then the exact haversine test filters.  No
cross product of pings and fences is formed, and longitude goes round the earth.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import haversine_km, hours_between
from .trajectory import lag_by_key

#: Cell sizes are 4 degrees / 2^level; all divide 360.
TOP_CELL_DEG = 4.0
LEVELS = 10
KM_PER_DEG = 111.2


def fences_from_locations(locations: DataFrame, radius_km: float = 50.0) -> DataFrame:
    """Fence table (fence_id, lat, lon, radius_km) from named points; places of one name are told apart by where they are."""
    fence = F.format_string("%s@%.6f,%.6f", "location_name", F.col("latitude").cast("double"), F.col("longitude").cast("double"))
    return locations.select(
        fence.alias("fence_id"), F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"), F.lit(float(radius_km)).alias("radius_km"),
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).dropDuplicates(["fence_id", "lat", "lon"])


CELL = ["cell_level", "cell_lat", "cell_lon"]


def _cell(lat: Column, lon: Column, level: Column) -> tuple[Column, Column]:
    """Row and column of a point in the grid of a level, columns not yet counted round the earth."""
    per_degree = F.pow(F.lit(2.0), level) / TOP_CELL_DEG
    return F.floor(lat * per_degree).cast("bigint"), F.floor(lon * per_degree).cast("bigint")


def _round_the_earth(column: Column, level: Column) -> Column:
    return F.pmod(column, F.lit(round(360.0 / TOP_CELL_DEG)).cast("bigint") * F.pow(F.lit(2.0), level).cast("bigint"))


def fence_cells(fences: DataFrame) -> DataFrame:
    """Each fence with the cells it can reach: mostly one to four, at the size that fits its reach."""
    dlat = F.col("radius_km") / KM_PER_DEG
    # A radius that reaches a pole reaches all longitudes.
    coslat = F.greatest(F.cos(F.radians(F.least(F.abs(F.col("lat")) + dlat, F.lit(90.0)))), F.lit(1e-6))
    dlon = F.least(F.col("radius_km") / (KM_PER_DEG * coslat), F.lit(180.0))
    wide = F.greatest(2.0 * F.greatest(dlat, dlon), F.lit(1e-9))
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(F.log2(F.lit(TOP_CELL_DEG) / wide)).cast("int")))
    f = fences.withColumns({"cell_level": level, "_dlat": dlat, "_dlon": dlon})
    low = _cell(F.col("lat") - F.col("_dlat"), F.col("lon") - F.col("_dlon"), F.col("cell_level"))
    high = _cell(F.col("lat") + F.col("_dlat"), F.col("lon") + F.col("_dlon"), F.col("cell_level"))
    lons = F.transform(F.sequence(low[1], high[1]), lambda c: _round_the_earth(c, F.col("cell_level")))
    f = f.withColumn("_lons", F.array_distinct(lons)).withColumn("cell_lat", F.explode(F.sequence(low[0], high[0])))
    return f.withColumn("cell_lon", F.explode("_lons")).drop("_lons", "_dlat", "_dlon")


def levels_of(cells: DataFrame) -> list[int]:
    """The levels that fences use, LEVELS at most."""
    return sorted(r[0] for r in cells.select("cell_level").distinct().collect())


def with_cells(pings: DataFrame, levels: list[int]) -> DataFrame:
    """Each ping with its cell at each of the levels, once a level."""

    def at(level: int) -> Column:
        lat, lon = _cell(F.col("current_lat"), F.col("current_lon"), F.lit(level))
        return F.struct(F.lit(level).alias("cell_level"), lat.alias("cell_lat"), _round_the_earth(lon, F.lit(level)).alias("cell_lon"))

    if not levels:
        levels = [0]
    return pings.withColumn("_cell", F.explode(F.array(*[at(k) for k in levels]))).select("*", "_cell.*").drop("_cell")


def places(fences: DataFrame) -> DataFrame:
    """One fence of those with the same place and radius, the least id, which is the one that counts for a ping: all are
    equally near.  So the fences a ping meets don't grow with how many share a place."""
    of = fences.groupBy("lat", "lon", "radius_km").agg(F.min(F.struct("fence_id")).alias("f"))
    return of.select("f.fence_id", "lat", "lon", "radius_km")


def nearest_fence(pings: DataFrame, fences: DataFrame, key_cols: list[str]) -> DataFrame:
    """Each ping with its nearest fence within radius (NULL if none)."""
    cells = fence_cells(places(fences))
    levels = levels_of(cells)
    cells = cells.select(*CELL, "fence_id", F.col("lat").alias("_flat"), F.col("lon").alias("_flon"), F.col("radius_km").alias("_rad"))
    cand = with_cells(pings.select(*key_cols, "current_lat", "current_lon"), levels).join(cells, CELL)
    cand = cand.withColumn("_dist", haversine_km("current_lat", "current_lon", "_flat", "_flon")).where(
        F.col("_dist") <= F.col("_rad")
    )
    best = cand.groupBy(*key_cols).agg(
        F.min_by(F.struct("fence_id", F.col("_dist").alias("fence_km")), F.struct("_dist", "fence_id")).alias("_b")
    )
    return pings.join(best, key_cols, "left").select(
        *pings.columns, F.col("_b.fence_id").alias("fence_id"), F.col("_b.fence_km").alias("fence_km")
    )


def geofence_events(pings: DataFrame, fences: DataFrame, booking_col: str = "booking_id",
                    time_col: str = "gps_ping_time", tie_col: str = "ping_seq") -> DataFrame:
    """D5 batch: 'enter' / 'exit' rows whenever a booking's current fence
    changes between consecutive pings (pings without coordinates skipped)."""
    p = pings.where(F.col("current_lat").isNotNull() & F.col("current_lon").isNotNull()
                    & F.col(booking_col).isNotNull())
    p = nearest_fence(p, fences, [booking_col, tie_col])
    p = lag_by_key(p, booking_col, time_col, tie_col, ["fence_id"], "prev_")
    changed = ~F.col("fence_id").eqNullSafe(F.col("prev_fence_id"))
    ev = p.where(changed).select(
        booking_col, time_col, tie_col,
        F.array(
            F.when(F.col("prev_fence_id").isNotNull(),
                   F.struct(F.lit("exit").alias("event_type"), F.col("prev_fence_id").alias("fence_id"))),
            F.when(F.col("fence_id").isNotNull(),
                   F.struct(F.lit("enter").alias("event_type"), F.col("fence_id").alias("fence_id"))),
        ).alias("_e"),
    )
    return ev.select(booking_col, time_col, tie_col, F.explode(F.filter("_e", lambda x: x.isNotNull())).alias("e")).select(
        booking_col, time_col, tie_col, "e.event_type", "e.fence_id"
    )


def delay_alerts(rows: DataFrame) -> DataFrame:
    """D6 batch: predicted arrival = ping time + remaining km at contract pace
    (min_daily_km per 24 h); alert when it is after the planned ETA."""
    pace = F.col("min_daily_km") / 24.0
    remaining_h = F.when(pace > 0, haversine_km("current_lat", "current_lon", "dest_lat", "dest_lon") / pace)
    predicted = F.timestamp_micros(F.unix_micros("gps_ping_time") + (remaining_h * 3.6e9).cast("bigint"))
    out = rows.select(
        "booking_id", "gps_ping_time", "planned_eta", remaining_h.alias("remaining_hours"),
        predicted.alias("predicted_arrival"),
    )
    return out.withColumn(
        "is_delayed", F.coalesce(F.col("predicted_arrival") > F.col("planned_eta"), F.lit(False))
    ).withColumn("slack_hours", hours_between("planned_eta", "predicted_arrival"))




def depot_fences(pings: DataFrame, radius_km: float = 3.0, booking_col: str = "booking_id",
                 time_col: str = "gps_ping_time", tie_col: str = "ping_seq") -> DataFrame:
    """One fence per booking at its first located ping (its depot)."""
    first = pings.where(F.col("current_lat").isNotNull() & F.col("current_lon").isNotNull()
                        & F.col(booking_col).isNotNull() & F.col(time_col).isNotNull())
    p = first.groupBy(booking_col).agg(
        F.min_by(F.struct("current_lat", "current_lon"), F.struct(time_col, tie_col)).alias("_p")
    )
    return p.select(
        F.concat(F.lit("depot-"), F.col(booking_col)).alias("fence_id"), F.col("_p.current_lat").alias("lat"),
        F.col("_p.current_lon").alias("lon"), F.lit(float(radius_km)).alias("radius_km"),
    )
