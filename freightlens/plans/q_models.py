"""Registered rows-only queries: models (M4, M5, M7-M9, M11, M14, M16,
R6-R8, N12, N13, S9).  Fitted models are memoised per session and data
directory, so the scoring queries reuse one fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import iforest as IF
from ..operators import ml as ML
from ..operators import mlprep as MP
from ..operators import rules as N
from ..operators import warehouse as W
from . import context as ctx
from .common import rounded
from .q_rules import CUSTOMER_PATTERN, MATERIAL

Q: dict = {}
SQL: dict = {}

_MODELS: dict = {}


def _model(spark, sf_dir, name, build):
    k = (id(spark), sf_dir.rstrip("/"), name)
    if k not in _MODELS:
        _MODELS[k] = build(ctx.enriched(spark, sf_dir))
    return _MODELS[k]


def eta(spark, sf_dir):
    return _model(spark, sf_dir, "eta", ML.train_eta_model)


def delay(spark, sf_dir):
    return _model(spark, sf_dir, "delay", ML.train_delay_classifier)


def driver(spark, sf_dir):
    return _model(spark, sf_dir, "driver", ML.delay_driver_model)


def late(spark, sf_dir):
    return _model(spark, sf_dir, "late", ML.late_risk_model)


def _metrics(bundle_fn):
    return lambda spark, sf_dir: rounded(ML.metrics_frame(spark, bundle_fn(spark, sf_dir)))


Q["eta_model"] = _metrics(eta)
Q["delay_classifier"] = lambda spark, sf_dir: rounded(
    ML.metrics_frame(spark, delay(spark, sf_dir)).select(
        "model", "metric", "value", F.lit(None).cast("string").alias("class"),
        F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
        F.lit(None).cast("double").alias("f1_score"), F.lit(None).cast("long").alias("support"))
    .unionByName(ML.report(delay(spark, sf_dir)).select(
        F.lit("delay_gbt").alias("model"), F.lit("classification_report").alias("metric"),
        F.lit(None).cast("double").alias("value"), "class", "precision", "recall", "f1_score", "support"))
)
Q["delay_driver_model"] = _metrics(driver)
Q["late_risk_model"] = _metrics(late)


def permutation_importance(spark, sf_dir):
    imp_reg = ML.permutation_importance(driver(spark, sf_dir)).withColumn("model", F.lit("delay_driver_gbt"))
    imp_clf = ML.permutation_importance(late(spark, sf_dir)).withColumn("model", F.lit("late_risk_rf"))
    return rounded(imp_reg.unionByName(imp_clf))


Q["permutation_importance"] = permutation_importance


def _scored(spark, sf_dir):
    return ML.shipment_risk_score(ctx.enriched(spark, sf_dir), delay(spark, sf_dir))


Q["risk_score"] = lambda spark, sf_dir: _scored(spark, sf_dir).select(
    "booking_id", "late_probability", "risk_score"
)
Q["risk_queue"] = lambda spark, sf_dir: ML.risk_queue(_scored(spark, sf_dir))
Q["rec_risk_queue"] = lambda spark, sf_dir: rounded(ML.high_risk_queue(_scored(spark, sf_dir)))
Q["rec_top_drivers"] = lambda spark, sf_dir: ML.top_drivers_text(ML.permutation_importance(driver(spark, sf_dir)))


def recommendations_with_models(spark, sf_dir):
    """All rules, N12 and N13 from the fitted models included."""
    extra = [N.rec_risk(_scored(spark, sf_dir)), N.rec_drivers(ML.permutation_importance(driver(spark, sf_dir)))]
    return rounded(N.recommendations(ctx.enriched(spark, sf_dir), CUSTOMER_PATTERN, MATERIAL, extra))


Q["recommendations_with_models"] = recommendations_with_models


def batch_score(spark, sf_dir):
    scored = ML.batch_score(ctx.enriched(spark, sf_dir), delay(spark, sf_dir), eta(spark, sf_dir))
    return W.fact_prediction(scored, "delay_gbt", "1")


Q["batch_score"] = batch_score
Q["eta_error_by_band"] = lambda spark, sf_dir: rounded(ML.eta_error_by_band(eta(spark, sf_dir)))


def route_iforest(spark, sf_dir):
    vec = MP.route_vectors(ctx.enriched(spark, sf_dir))
    return rounded(IF.route_anomalies(vec, "route_id", MP.ROUTE_FEATURES))


Q["route_iforest"] = route_iforest
