"""What stays on disk: shuffles of written tables, columns nobody reads, sheets as text."""

import glob

from pyspark.sql import functions as F

from freightlens.operators.clean import dedupe_bookings
from freightlens.operators.dedupe import keep_first
from freightlens.operators.sinks import append_load, restate
from freightlens.plans import q_core
from freightlens.session import input_bytes, lean_shuffles, materialize
from shipment_rows import shipments


def shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = env.blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    got = materialize(df, "lean")
    assert not shuffle_files(spark) - before
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_sinks_leave_no_shuffle_files(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("booking_id"), (F.col("id") % 3).cast("string").alias("month"))
    path, before = f"{spark.conf.get('spark.checkpoint.dir')}/lean-sink", shuffle_files(spark)
    restate(df, path, "month", ["booking_id"])
    append_load(df, f"{path}-loads", 1, "month", ["booking_id"])
    assert not shuffle_files(spark) - before
    assert spark.read.parquet(path).count() == spark.read.parquet(f"{path}-loads").count() == 500


def test_partitions_follow_the_input_and_settings_come_back(spark, monkeypatch):
    df = spark.range(100_000)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/lean-input"
    df.write.mode("overwrite").parquet(path)
    read = spark.read.parquet(path)
    assert input_bytes(read.join(read.withColumnRenamed("id", "x"), F.col("id") == F.col("x"))) == 2 * input_bytes(read) > 0
    key, least = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", int(spark.conf.get("spark.sql.shuffle.partitions"))
    was = spark.conf.get(key, None)
    for size, wanted in ((1 << 40, least), (input_bytes(read) // 100, 100)):
        monkeypatch.setattr("freightlens.session.INPUT_PER_PARTITION", size)
        with lean_shuffles(read):
            assert int(spark.conf.get(key)) >= wanted
    assert spark.conf.get(key, None) == was


def test_keep_first_leaves_out_what_is_dropped(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 4, None)], "k string, o int, v string")
    out = keep_first(df, ["k"], [F.col("o")], drop=["o"])
    assert out.columns == ["k", "v"]
    assert {tuple(r) for r in out.collect()} == {("a", "y"), (None, None)}
    assert "o#" not in out._jdf.queryExecution().optimizedPlan().toString().split("_row")[-1].split("]")[0]


def test_dedupe_carries_only_the_columns_asked_for(spark, monkeypatch):
    frame = shipments(spark, [{"booking_id": "b1"}, {"booking_id": "b1"}, {"booking_id": "b2"}]).withColumn("_tie", F.monotonically_increasing_id())
    seen = []
    monkeypatch.setattr(q_core.ctx, "landed", lambda *a: frame)
    monkeypatch.setattr(q_core.C, "dedupe_bookings", lambda df: seen.append(df.columns) or dedupe_bookings(df))
    q_core._deduped(spark, "none", "distance_km", "vehicle_type").collect()
    assert set(seen[0]) == {"distance_km", "vehicle_type", "booking_id", "actual_eta", "gps_ping_time", "trip_start", "_tie"}


def test_sheets_are_compressed_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(q_core, "RECORDS_PER_FILE", 10)
    df = spark.range(25).coalesce(1).select(F.concat(F.lit(" a,\"b "), F.col("id").cast("string")).alias("t"), F.lit(None).cast("string").alias("n"))
    path = q_core._written(df, "test")
    assert len(glob.glob(f"{path}/*.csv.gz")) == 3 and not glob.glob(f"{path}/*.csv")
    assert spark.read.option("header", "true").csv(path).count() == 25
