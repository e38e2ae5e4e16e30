"""Model invariants on sf0.001 (small iteration counts keep the test quick;
the registered queries use the original hyper-parameters)."""

from pyspark.sql import functions as F

from freightlens.operators import iforest as IF
from freightlens.operators import ml as ML
from freightlens.operators import mlprep as MP
from freightlens.plans import context as ctx

SF = "/root/testdata/sf0.001"


def test_risk_score_bounds_and_row_set(spark):
    e = ctx.enriched(spark, SF)
    bundle = ML.train_delay_classifier(e, max_iter=5, max_depth=3)
    assert 0.0 <= bundle.metrics["test_auc"] <= 1.0
    scored = ML.shipment_risk_score(e, bundle)
    assert scored.count() == e.count()
    complete = F.lit(True)
    for c in bundle.num:
        complete = complete & F.col(c).isNotNull()
    bad = scored.where(
        (complete & (F.col("risk_score").isNull() | (F.col("risk_score") < 0) | (F.col("risk_score") > 100)))
        | (~complete & F.col("risk_score").isNotNull())
    ).count()
    assert bad == 0
    report = {r["class"]: r for r in ML.report(bundle).collect()}
    assert report["accuracy"]["support"] == report["0"]["support"] + report["1"]["support"]


def test_eta_mae_and_permutation_importance(spark):
    e = ctx.enriched(spark, SF)
    eta = ML.train_eta_model(e, max_iter=5, max_depth=3)
    mean = eta.test.agg(F.avg("trip_days")).first()[0]
    base_mae = eta.test.agg(F.avg(F.abs(F.col("trip_days") - F.lit(mean)))).first()[0]
    assert eta.metrics["test_mae_days"] is not None and eta.metrics["test_mae_days"] <= base_mae * 1.5
    drv = ML.delay_driver_model(e, max_iter=5, max_depth=3)
    imp = ML.permutation_importance(drv, repeats=2).collect()
    assert {r.feature for r in imp} == set(drv.num + drv.cat)
    assert all(r.importance_std is not None and r.importance_std >= 0 for r in imp)


def test_isolation_forest_flags_about_contamination(spark):
    vec = MP.route_vectors(ctx.enriched(spark, SF))
    out = IF.route_anomalies(vec, "route_id", MP.ROUTE_FEATURES, n_trees=20).collect()
    n, flagged = len(out), sum(r.is_anomaly for r in out)
    assert n == vec.count()
    assert 0 < flagged <= max(1, round(0.08 * n) + 2)
    assert all(0.0 < r.anomaly_score <= 1.0 for r in out)
    assert all((r.anomaly_label == -1) == r.is_anomaly for r in out)


def test_planted_feature_ranks_first(spark):
    """The only column the target depends on has by far the largest importance; a constant one has none."""
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor

    df = spark.range(600).select(
        F.concat(F.lit("B"), F.col("id").cast("string")).alias("booking_id"), (F.col("id") * 37 % 101).cast("double").alias("x"),
        (F.col("id") * 53 % 89).cast("double").alias("z"), F.lit(1.0).alias("one"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"),
    ).withColumn("delay_hours", F.col("x") * 2.0)
    m = ML.split(df)
    caps = {"c": ["a", "b"]}
    gbt = GBTRegressor(featuresCol="features", labelCol="delay_hours", maxIter=5, maxDepth=3, seed=1)
    model = Pipeline(stages=ML.preprocessor(["x", "z", "one"], caps) + [gbt]).fit(m.where("split = 'train'"))
    bundle = ML.ModelBundle("planted", "delay_hours", ["x", "z", "one"], ["c"], model, {}, m.where("split = 'test'"))
    imp = {r.feature: r.importance_mean for r in ML.permutation_importance(bundle, repeats=3).collect()}
    assert imp["x"] > 1.0 and imp["x"] > 10 * abs(imp["z"]) and imp["one"] == 0.0


def test_batch_score_fills_eta_and_delay(spark):
    """One row in, one row out, also for bookings without id; the delay is the ETA against plan."""
    e = ctx.enriched(spark, SF)
    bundle, eta = ML.train_delay_classifier(e, max_iter=2, max_depth=2), ML.train_eta_model(e, max_iter=2, max_depth=2)
    scored = ML.batch_score(e, bundle, eta)
    assert scored.count() == e.count()
    odd = scored.where(F.col("predicted_eta_ts").isNotNull() & F.col("planned_eta").isNotNull() & (F.abs(
        F.col("predicted_delay_h") - (F.unix_micros("predicted_eta_ts") - F.unix_micros("planned_eta")) / 3.6e9) > 1e-6))
    assert odd.count() == 0 and scored.where("predicted_delay_h is not null").count() > 0


def test_forest_depth(spark):
    e = ctx.enriched(spark, SF)
    rf = ML.train_delay_classifier(e, max_iter=3, algorithm="rf")
    assert rf.model.stages[-1].getOrDefault("maxDepth") == 8


def _plain_score(point, nodes, psi):
    """Walk one point down every tree, node by node."""
    total = 0.0
    for tree in nodes.values():
        at = tree[0]
        while at.feature >= 0:
            at = tree[at.left if point[at.feature] < at.threshold else at.right]
        total += at.depth + IF.c_factor(at.size)
    return 2.0 ** (-total / len(nodes) / IF.c_factor(psi))


def test_forest_scores_equal_a_plain_walk(spark):
    """Exactly 256 distinct rows a tree; flat arrays give the scores of a walk; the planted outlier scores highest."""
    v = spark.range(3000).select(F.concat(F.lit("R"), F.col("id").cast("string")).alias("k"), F.when(F.col("id") == 7, 90.0).otherwise((F.col("id") * 37 % 101) / 10.0).alias("x"),
                                 F.when(F.col("id") == 7, -50.0).otherwise((F.col("id") * 53 % 89) / 10.0).alias("y"))
    nodes, psi = IF.fit_forest(v, "k", ["x", "y"], n_trees=12)
    drawn = IF.samples(v, "k", ["x", "y"], 3000, 12, psi, 42).groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("_key").alias("d")).collect()
    assert psi == 256 and len(drawn) == 12 and all(256 <= r.n == r.d < 700 for r in drawn)
    rows = nodes.collect()
    trees = {t: {r.node: r for r in rows if r.tree == t} for t in {r.tree for r in rows}}
    assert all(tree[0].size == 256 for tree in trees.values())
    got = {r.k: (r.anomaly_score, (r.x, r.y)) for r in IF.score_forest(v, nodes, ["x", "y"], psi).collect()}
    assert all(abs(s - _plain_score(p, trees, psi)) < 1e-12 for s, p in got.values())
    assert max(got, key=lambda k: got[k][0]) == "R7"
    assert IF.route_anomalies(v.limit(0), "k", ["x", "y"], n_trees=3).count() == 0
    assert IF.route_anomalies(v.limit(1), "k", ["x", "y"], n_trees=3).count() == 1


def test_models_learn_a_planted_target(spark):
    """Lateness and trip time that depend on the distance alone are learnt on the training part and hold on the test part."""
    e = ctx.enriched(spark, SF).where(F.col("distance_km").isNotNull())
    middle = e.agg(F.percentile("distance_km", F.lit(0.6))).first()[0]
    e = e.withColumns({"is_late": (F.col("distance_km") > middle).cast("int"), "trip_days": F.col("distance_km") / 300.0})
    for options in ({"max_iter": 5, "max_depth": 3}, {"max_iter": 12, "algorithm": "rf"}):
        bundle = ML.train_delay_classifier(e, **options)
        assert bundle.metrics["test_auc"] > 0.95
    report = {r["class"]: r for r in ML.report(ML.train_delay_classifier(e, max_iter=5, max_depth=3)).collect()}
    assert report["1"]["precision"] > 0.9 and report["1"]["recall"] > 0.9
    eta = ML.train_eta_model(e, max_iter=20, max_depth=4)
    mean = eta.test.agg(F.avg("trip_days")).first()[0]
    assert eta.metrics["test_mae_days"] < 0.25 * eta.test.agg(F.avg(F.abs(F.col("trip_days") - F.lit(mean)))).first()[0]
