import math

from pyspark.sql import functions as F

from freightlens.functions.columns import band_sql, clip0, distance_band, haversine_km, route_category


def test_clip0_keeps_null(spark):
    df = spark.createDataFrame([(-3.0,), (None,), (2.5,)], "x double")
    assert [r[0] for r in df.select(clip0("x")).collect()] == [0.0, None, 2.5]


def test_haversine_zero_symmetric_antipodal(spark):
    df = spark.createDataFrame([(10.0, 70.0, 10.0, 70.0), (0.0, 0.0, 0.0, 180.0), (1.0, 2.0, 3.0, 4.0)],
                               "a double, b double, c double, d double")
    rows = df.select(haversine_km("a", "b", "c", "d").alias("h"), haversine_km("c", "d", "a", "b").alias("r")).collect()
    assert rows[0].h == 0.0
    assert not math.isnan(rows[1].h) and abs(rows[1].h - math.pi * 6371.0) < 1e-6
    assert abs(rows[2].h - rows[2].r) < 1e-9
    nulls = spark.createDataFrame([(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert nulls.select(haversine_km("a", "b", "c", "d")).first()[0] is None


def test_distance_band_edges(spark):
    vals = [0.0, 100.0, 100.01, 1200.0, 1200.01, -5.0, None, float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [r[0] for r in df.select(distance_band("d")).collect()]
    assert got == ["0-100km", "0-100km", "100-300km", "600-1200km", "1200km+", None, None, "1200km+"]


def test_view_banding_and_route_category(spark):
    df = spark.createDataFrame([(-5.0,), (None,), (150.0,), (600.0,)], "d double")
    rows = df.select(band_sql("d").alias("b"), route_category("d").alias("c")).collect()
    assert [r.b for r in rows] == ["0-100km", "1200km+", "100-300km", "300-600km"]
    assert [r.c for r in rows] == ["short_haul", "long_haul", "short_haul", "mid_haul"]


def test_bands_by_label_and_ordinal_agree(spark):
    """The label is one CASE over the distance: its expression is not repeated for each label."""
    from freightlens.functions.columns import band_ordinal, distance_band, label_for_ordinal

    rows = [(v,) for v in (None, -1.0, -0.0, 0.0, 100.0, 100.01, 300.0, 301.0, 600.0, 600.5, 1200.0, 1200.5, float("nan"), float("inf"), float("-inf"))]
    df = spark.createDataFrame(rows, "d double").select("d", band_ordinal("d").alias("o"), distance_band("d").alias("b"))
    got = df.select("b", label_for_ordinal("o").alias("l")).collect()
    assert [r.b for r in got] == [r.l for r in got] and len({r.b for r in got}) == 6
    assert str(df._jdf.queryExecution().analyzed()).count("isnan") <= 2
