"""Bookings deduped on source columns equal those deduped on the canonical rows; what the step shuffles."""

import os
import re
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from freightlens.operators.clean import dedupe_bookings
from freightlens.plans import context as ctx
from freightlens.plans import q_profile
from freightlens.sources import fixtures


def _tables(spark):
    """Snapshots of few bookings; orders, parts and suppliers that are missing, line numbers and dates that are null."""
    at = tempfile.mkdtemp(prefix="freightlens-t-")

    def write(name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(at, f"{name}.parquet"))

    day = lambda i: None if i % 7 == 3 else datetime(1996, 1, 1 + i % 9)
    lines = [(i % 11, i % 13, i % 4, None if i % 10 == 6 else i % 3, float(i % 17), 100.0 + i, 0.1, 0.0, "ARN"[i % 3], day(i)) for i in range(400)]
    write("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
          "l_tax double, l_returnflag string, l_shipdate timestamp", lines)
    write("orders", "o_orderkey long, o_custkey long", [(i, i % 5) for i in range(10)])
    write("customer", "c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(i, f"C{i}", i, "AUTO") for i in range(4)])
    write("supplier", "s_suppkey long, s_name string, s_nationkey int", [(i, f"S{i}", i) for i in range(3)])
    write("part", "p_partkey long, p_name string, p_size int", [(i, f"P{i}", i) for i in range(12)])
    write("nation", "n_nationkey int, n_name string", [(i, f"N{i}") for i in range(5)])
    return at


def test_equal_to_the_dedupe_of_canonical_rows(spark):
    at = _tables(spark)
    want = dedupe_bookings(fixtures.shipments(spark, at))
    got = fixtures.latest_shipments(spark, at)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(map(tuple, want.collect()), key=str)
    assert sum(r[got.columns.index("booking_id")] is None for r in rows) == 1 < len(rows)


def test_cleaning_shuffles_source_columns_only(spark):
    """Joined by shuffle, a lineitem row is dealt out by part, supplier and order, and not again by booking with its 28 columns."""
    at = _tables(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = fixtures.latest_shipments(spark, at)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    dealt = re.findall(r"hashpartitioning\((\w+)#\d+L?(?:, (\w+)#)?", plan)
    assert {("l_partkey", ""), ("l_suppkey", ""), ("l_orderkey", "")} <= set(dealt)
    assert not any("booking_id" in keys or keys == ("l_orderkey", "l_linenumber") for keys in dealt)


def test_the_log_counts_the_same_rows(spark):
    at = _tables(spark)
    log = {r.step: r.value for r in ctx.quality(spark, at).collect()}
    raw, kept = fixtures.shipments(spark, at).count(), fixtures.latest_shipments(spark, at).count()
    assert log["dedupe_bookings"] == raw - kept > 0


def test_profiles_of_few_columns_write_no_table_of_all(spark):
    at = _tables(spark)
    for name in ("profile_pings", "profile_flag_dist", "profile_shipment_types"):
        assert q_profile.Q[name](spark, at).collect()
    assert ctx._key(spark, at, "landed") not in ctx._FRAMES
    dist = q_profile.Q["profile_shipment_types"](spark, at)
    assert {r.shipment_type: r.rows for r in dist.collect()} == {r.shipment_type: r.rows for r in fixtures.shipments(spark, at).groupBy("shipment_type").agg(F.count("*").alias("rows")).collect()}
    plan = dist._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in plan and "l_extendedprice" not in plan
