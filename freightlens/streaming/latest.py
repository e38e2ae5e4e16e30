"""A table of the newest row per key, kept up by micro-batches.

Every batch is written as a small delta folder named by its batch id, then a manifest that lists it is
committed.  After ``merge_every`` deltas they are merged with the snapshot into a new one,
in folders by a hash bucket of the key, so a look-up of one key reads one bucket.  Merged deltas and
snapshots older than the one before are removed, so the size follows the number of keys.

A batch id that the manifest holds already is skipped, so a replayed batch changes nothing, also
where values add up; one that failed before its commit overwrites its own folder.  Readers see
the last committed manifest.  One query writes a table at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LatestTable:
    """``combine`` turns rows of several batches into one row per key; its output must have its input's columns."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], combine: Callable[[DataFrame], DataFrame],
                 schema: str, buckets: int = 8, merge_every: int = 4):
        self.spark, self.root, self.keys, self.combine = spark, root.rstrip("/"), list(keys), combine
        self.schema, self.buckets, self.merge_every = schema, buckets, merge_every

    # --- the shared folder
    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *map(str, parts))))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[int]:
        path = self._path(folder)
        if not self._fs().exists(path):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs().listStatus(path) if s.getPath().getName().isdigit())

    def manifest(self) -> dict:
        """Number, snapshot (None at first), deltas since, and the last batch of the committed state."""
        numbers = self._names("manifest")
        if not numbers:
            return {"number": 0, "snapshot": None, "before": None, "deltas": [], "last": -1}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{numbers[-1]}").first()[0])

    def _commit(self, state: dict) -> None:
        new, final = self._path("manifest", f"_{state['number']}"), self._path("manifest", state["number"])
        out = self._fs().create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs().rename(new, final):
            raise OSError(f"manifest {state['number']} of {self.root} exists: another writer is at work")
        for n in self._names("manifest")[:-2]:
            self._fs().delete(self._path("manifest", n), False)

    # --- writing and reading
    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        state = self.manifest()
        if batch_id <= state["last"]:
            return
        self.combine(batch).write.mode("overwrite").parquet(f"{self.root}/delta/{batch_id}")
        state |= {"number": state["number"] + 1, "deltas": [*state["deltas"], batch_id], "last": batch_id}
        self._commit(state)
        if len(state["deltas"]) >= self.merge_every:
            self._merge(state)

    def _merge(self, state: dict) -> None:
        new = state["last"]
        rows = self._with_bucket(self._rows(state))
        rows.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/snapshot/{new}")
        self._commit(state | {"number": state["number"] + 1, "snapshot": new, "before": state["snapshot"], "deltas": []})
        for d in self._names("delta"):
            if d <= new:
                self._fs().delete(self._path("delta", d), True)
        for s in self._names("snapshot"):
            if s not in (new, state["snapshot"]):
                self._fs().delete(self._path("snapshot", s), True)

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _rows(self, state: dict) -> DataFrame:
        read = self.spark.read.schema(self.schema)
        parts = [read.parquet(f"{self.root}/delta/{d}") for d in state["deltas"]]
        if state["snapshot"] is not None:
            parts.append(self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.root}/snapshot/{state['snapshot']}").drop("bucket"))
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return self.combine(rows)

    def read(self) -> DataFrame:
        """One row per key, as of the last commit."""
        return self._rows(self.manifest())


POSITION_SCHEMA = "booking_id string, last_ping_time timestamp, ping_seq long, lat double, lon double, pings long"


def positions(pings: DataFrame) -> DataFrame:
    """Pings as rows of the latest-position table."""
    return pings.select("booking_id", F.col("gps_ping_time").alias("last_ping_time"), "ping_seq", F.col("current_lat").alias("lat"),
                        F.col("current_lon").alias("lon"), F.lit(1).cast("long").alias("pings"))


def newest_position(rows: DataFrame) -> DataFrame:
    """The newest position of each booking and the number of its pings; combined map-side."""
    newest = F.max_by(F.struct("last_ping_time", "ping_seq", "lat", "lon"), F.struct("last_ping_time", "ping_seq")).alias("p")
    return rows.groupBy("booking_id").agg(newest, F.sum("pings").alias("pings")).select("booking_id", "p.*", "pings")


def latest_position_table(spark: SparkSession, root: str, buckets: int = 8, merge_every: int = 4) -> LatestTable:
    return LatestTable(spark, root, ["booking_id"], newest_position, POSITION_SCHEMA, buckets, merge_every)
