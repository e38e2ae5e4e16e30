"""Rules from shared tables equal those from their own queries; model rules; scans of the enriched frame."""

from pyspark.sql import functions as F

from freightlens.operators import rules as N
from freightlens.plans import context as ctx
from freightlens.plans.common import rounded

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, rounded(df).collect()), key=str)


def test_shared_tables_give_the_same_rules(spark):
    e = ctx.enriched(spark, SF)
    each = [N.rec_network(e), N.rec_lanes(e), N.rec_suppliers(e), N.rec_customer(e, "a"), N.rec_material(e, "Other"), N.rec_detour(e), N.rec_haul(e),
            N.rec_shipment_type(e), N.rec_idle(e), N.rec_imputed(e), N.rec_peak(e)]
    apart = each[0]
    for d in each[1:]:
        apart = apart.unionByName(d)
    together = N.recommendations(e, "a", "Other")
    assert together.columns == N.REC_COLUMNS and _rows(together) == _rows(apart)
    assert len(_rows(together)) >= 8


def test_the_frame_is_read_three_times(spark):
    """Whatever the number of rules: the plan of all of them reads the frame for one material only; the rest are small tables."""
    e = ctx.enriched(spark, SF)
    source = e.inputFiles()[0].rsplit("/", 1)[0]
    plan = N.recommendations(e, "a", "Other")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(source.rsplit("/", 1)[1]) <= 2


def test_rules_on_an_empty_frame(spark):
    e = ctx.enriched(spark, SF).where(F.lit(False))
    got = {r.rule_id: r for r in N.recommendations(e, "a", "Other").collect()}
    assert set(got) <= {"N1", "N9"} and got["N1"].n == 0 and got["N1"].baseline_value is None
    assert N.metric_extract(e, "a", "Other").where("section = 'kpis' AND metric = 'total_bookings'").first().value == 0.0


def test_model_rules(spark):
    scored = spark.createDataFrame([(70.0, 1), (65.0, 0), (80.0, 1), (10.0, 0), (64.9, 1), (None, 1), (90.0, None)], "risk_score double, is_late int")
    r = N.rec_risk(scored).first()
    assert (r.rule_id, r.n, round(r.baseline_value, 6), r.comparison_value, round(r.target_value, 6)) == ("N12", 4, 66.666667, 50.0, 56.666667)
    importance = spark.createDataFrame([("a", 0.1, 0.01), ("b", 0.7, 0.0), ("c", 0.1, 0.0), ("d", 0.3, 0.2)], "feature string, importance_mean double, importance_std double")
    assert [(x.rule_id, x.subject, x.n) for x in N.rec_drivers(importance).orderBy("n").collect()] == [("N13", "b", 1), ("N13", "d", 2), ("N13", "a", 3)]


def test_lane_plans_name_the_whole_lane(spark):
    from freightlens.plans import q_rules

    far = "→".join("x" * 40 for _ in range(2))
    e = ctx.enriched(spark, SF).withColumn("route_id", F.when(F.col("is_ontime") == 0, far).otherwise("a→b"))
    got = {r.subject: r.initiative for r in N.lane_plans(e).collect()}
    assert got == {far: f"Lane recovery plan: {'x' * 40} to {'x' * 40}", "a→b": "Lane recovery plan: a to b"}
    assert q_rules.Q["rec_lanes"](spark, SF).columns == [*N.REC_COLUMNS, "initiative"]
    assert "Lane recovery plan" in q_rules.SQL["rec_lanes"] and "Lane recovery plan" not in q_rules.SQL["recommendations"]
