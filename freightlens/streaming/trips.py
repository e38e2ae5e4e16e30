"""Per-booking trip state in event-time order.

Pings of a booking may come in any order within the watermark's delay.  Each is held in
state until the watermark has passed it; then a timer hands the booking's ripe pings on in
(time, seq) order, each with the ping before it and the fence before it.  A ping that arrives
after the watermark has passed its time is dropped by Spark before it gets here and counted in the
query's progress (``late_rows``).  So the result doesn't depend on how the feed was
cut into batches, but for which pings were too late.

Bookings are dealt into ``BUCKETS`` by hash, and a bucket's state is kept together: the last ping of
each of its bookings, the pings not yet ripe, both as Arrow batches of ``CHUNK`` rows at most, and when it is next due.  So Python
and the state store are called once a bucket and batch, not several times a booking, and a bucket's bookings are put in
order at once.  A booking without a ping for ``expire_hours`` starts a new trip: the next ping has no
predecessor, and its last ping is removed when its bucket is next due after that time.  A task holds
the unripe pings of one bucket at a time; the source's ``max_files`` bounds what one trigger adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from ..config import IDLE_MIN_HOURS, IDLE_SPEED_KMPH
from ..functions.columns import haversine_km, hours_between, null_false

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRE_HOURS = 7 * 24.0

BUCKETS, CHUNK = 1024, 1 << 16

_PING = pa.schema([("booking_id", pa.string()), ("us", pa.int64()), ("seq", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("fence", pa.string()), ("km", pa.float64())])
_OUT = (
    "booking_id string, us long, ping_seq long, current_lat double, current_lon double, fence_id string, "
    "prev_us long, prev_lat double, prev_lon double, prev_fence_id string"
)


def _packed(pings: pd.DataFrame) -> list[tuple[bytes]]:
    """The pings as state rows, an Arrow batch in each."""
    batches = pa.RecordBatch.from_pandas(pings[_PING.names], _PING, preserve_index=False)
    return [(batches.slice(i, CHUNK).serialize().to_pybytes(),) for i in range(0, batches.num_rows, CHUNK)]


def _unpacked(state: ListState) -> pd.DataFrame:
    rows = state.get() if state.exists() else ()
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(r[0])), _PING) for r in rows], _PING).to_pandas()


def _ms(us: int) -> int:
    return -(-int(us) // 1000)


class InOrder(StatefulProcessor):
    """Pairs each ping of a bucket's bookings with its booking's ping before it, both in event-time order."""

    def __init__(self, expire_us: int):
        self.expire_us = expire_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "pings binary")
        self.last = handle.getListState("last", "pings binary")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = []
        for part in rows:
            for chunk in _packed(part):
                self.waiting.appendValue(chunk)
            times.append(_ms(part["us"].min()))
        first = min(times)
        # The earliest is enough: whoever fires sets the next.
        if not self.due.exists() or first < self.due.get()[0]:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if not self.due.exists() or self.due.get()[0] > now:
            return  # another timer of this bucket was here before
        mark = now * 1000
        held = _unpacked(self.waiting)
        ripe, rest = held[held["us"] <= mark], held[held["us"] > mark]
        pings, new, before = self._in_order(_unpacked(self.last), ripe)
        b, us = pings["booking_id"].to_numpy(), pings["us"].to_numpy()
        final = np.append(b[1:] != b[:-1], True)[: len(b)]
        keep = pings[final & (us + self.expire_us > mark)]
        if len(ripe):
            self._put(self.waiting, rest)
        self._put(self.last, keep)
        due = [*([rest["us"].min()] if len(rest) else []), *([keep["us"].max() + self.expire_us] if len(keep) else [])]
        if due:
            self._wake(_ms(min(due)))
        else:
            self.due.clear()
        if new.any():
            yield self._out(pings, new, before)

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    @staticmethod
    def _put(state: ListState, pings: pd.DataFrame) -> None:
        if len(pings):
            state.put(_packed(pings))
        else:
            state.clear()

    def _in_order(self, last: pd.DataFrame, ripe: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """The last pings and the ripe ones, one row a ping with its nearest fence, by booking and (time, seq);
        which are ripe, and the place of the ping before each in its trip (-1: none)."""
        ripe = ripe.assign(fence_key=ripe["fence"].fillna("")).sort_values(["us", "seq", "km", "fence_key"]).drop(columns="fence_key")
        ripe = ripe.drop_duplicates(["booking_id", "us", "seq"])
        pings = pd.concat([last, ripe], ignore_index=True) if len(last) else ripe.reset_index(drop=True)
        order = np.argsort(pd.factorize(pings["booking_id"])[0], kind="stable")
        pings, new = pings.take(order).reset_index(drop=True), order >= len(last)
        b, us = pings["booking_id"].to_numpy(), pings["us"].to_numpy()
        follows = np.zeros(len(pings), bool)
        follows[1:] = (b[1:] == b[:-1]) & (us[1:] - us[:-1] <= self.expire_us)
        return pings, new, np.where(follows, np.arange(len(pings)) - 1, -1)

    @staticmethod
    def _out(pings: pd.DataFrame, new: np.ndarray, before: np.ndarray) -> pd.DataFrame:
        at, prev = np.flatnonzero(new), before[new]
        none = prev < 0
        now, old = pings.take(at), pings.take(np.maximum(prev, 0))
        return pd.DataFrame({
            "booking_id": now["booking_id"].to_numpy(), "us": now["us"].to_numpy(), "ping_seq": now["seq"].to_numpy(),
            "current_lat": now["lat"].to_numpy(), "current_lon": now["lon"].to_numpy(), "fence_id": now["fence"].to_numpy(),
            "prev_us": pd.arrays.IntegerArray(old["us"].to_numpy().copy(), none), "prev_lat": np.where(none, np.nan, old["lat"]),
            "prev_lon": np.where(none, np.nan, old["lon"]), "prev_fence_id": np.where(none, None, old["fence"].to_numpy(object)),
        })

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """List state and timers need the RocksDB state store; other state works in it as well."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def live_trips(pings: DataFrame, expire_hours: float = EXPIRE_HOURS) -> DataFrame:
    """Each ping with the ping before it and the fence before it.

    ``pings`` must carry a watermark on ``gps_ping_time``; ``fence_id`` and ``fence_km`` are read if
    present (a ping may come with several, the nearest counts).
    """
    use_rocksdb(pings.sparkSession)
    has = "fence_id" in pings.columns
    fence = [F.col("fence_id") if has else F.lit(None).cast("string"), F.col("fence_km") if has else F.lit(None).cast("double")]
    rows = pings.where(F.col("booking_id").isNotNull() & F.col("gps_ping_time").isNotNull()).select(
        F.pmod(F.xxhash64("booking_id"), F.lit(BUCKETS)).alias("bucket"), "booking_id", "gps_ping_time", F.unix_micros("gps_ping_time").alias("us"), F.col("ping_seq").cast("long").alias("seq"),
        F.col("current_lat").alias("lat"), F.col("current_lon").alias("lon"), fence[0].alias("fence"), fence[1].alias("km"),
    )
    out = rows.groupBy("bucket").transformWithStateInPandas(InOrder(int(expire_hours * 3.6e9)), _OUT, "Append", "EventTime")
    return out.select(
        "booking_id", F.timestamp_micros("us").alias("gps_ping_time"), "ping_seq", "current_lat", "current_lon", "fence_id",
        F.timestamp_micros("prev_us").alias("prev_time"), "prev_lat", "prev_lon", "prev_fence_id",
    )


def with_motion(trips: DataFrame, idle_speed: float = IDLE_SPEED_KMPH, idle_hours: float = IDLE_MIN_HOURS) -> DataFrame:
    """Hours, kilometres and speed since the ping before, and whether the vehicle idled; equal to the batch trajectory."""
    km = haversine_km("prev_lat", "prev_lon", "current_lat", "current_lon")
    m = trips.withColumns({"delta_hours": hours_between("gps_ping_time", "prev_time"), "segment_km": km})
    m = m.withColumn("segment_speed_kmph", F.when(F.col("delta_hours") > 0, F.col("segment_km") / F.col("delta_hours")))
    idle = (F.col("segment_speed_kmph") < idle_speed) & (F.col("delta_hours") >= idle_hours)
    return m.withColumn("is_idle_segment", null_false(idle))


def fence_events(trips: DataFrame) -> DataFrame:
    """``exit`` of the fence before and ``enter`` of the new one where they differ."""
    changed = ~F.col("fence_id").eqNullSafe(F.col("prev_fence_id"))
    events = F.array(
        F.when(F.col("prev_fence_id").isNotNull(), F.struct(F.lit("exit").alias("event_type"), F.col("prev_fence_id").alias("fence_id"))),
        F.when(F.col("fence_id").isNotNull(), F.struct(F.lit("enter").alias("event_type"), F.col("fence_id").alias("fence_id"))),
    )
    return trips.where(changed).select("booking_id", "gps_ping_time", "ping_seq", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(
        "booking_id", "gps_ping_time", "ping_seq", "e.event_type", "e.fence_id"
    )
