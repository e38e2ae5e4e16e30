"""Spark ML pipelines for ETA, delay and risk.

- Categorical inputs are capped to the most frequent k-1 values per column
  (bounded top-k aggregate), the rest -> '__infrequent__', NULL ->
  '__null__', then StringIndexer + OneHotEncoder inside one PipelineModel.
- Splits are hash buckets of the booking id (reproducible, no sort).
- Balanced class weights come from a <= 2-row class table.
- Permutation importance scores every (feature, repeat) copy of the test
  set in one job; each copy permutes one column with an exact affine
  bijection over dense row ids (no global sort, no driver loop over rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RANDOM_STATE
from ..functions.columns import hours_between, r
from ..session import materialize
from . import boosting, forest, mlprep
from .diagnostics import MODEL_CATEGORICAL, MODEL_NUMERIC
from .keys import sequential_ids

# M1: feature lists of the ETA / delay / risk models (fixed values).
NUMERIC = ["distance_km", "geo_distance_km", "route_detour_ratio", "wait_hours", "avg_speed_kmph", "km_per_day"]
CATEGORICAL = [
    "shipment_type", "vehicle_type", "route_category", "distance_band", "material_group", "supplier_name",
    "customer_tier", "origin_location", "destination_location",
]
# Inputs that do not depend on the trip end (avoid the outcome leak).
NUMERIC_LEAK_FREE = ["distance_km", "geo_distance_km", "route_detour_ratio", "wait_hours"]


def category_caps(df: DataFrame, cats: list[str], max_categories: int) -> dict[str, list[str]]:
    """Top (max_categories - 1) values per column by count (ties -> text).
    Each list is bounded by ``max_categories``; nothing else is collected.  All columns are counted in one pass."""
    kinds = dict(df.dtypes)
    values = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("string").alias("_v")) for i, c in enumerate(cats)])
    counts = df.select(F.explode(values).alias("x")).select("x.*").where(F.col("_v").isNotNull()).groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts, "category-counts")
    caps = {}
    for i, c in enumerate(cats):
        rows = (
            counts.where(F.col("_c") == i).select(F.col("_v").cast(kinds[c]).alias("_v"), "_n")
            .orderBy(F.col("_n").desc(), "_v").limit(max_categories - 1).collect()
        )
        caps[c] = [row[0] for row in rows]
    return caps


def _sql_str(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def preprocessor(num: list[str], caps: dict[str, list[str]]) -> list:
    """M2: cap -> index -> one-hot -> assemble (all JVM-side stages)."""
    exprs = []
    for c, top in caps.items():
        inlist = ", ".join(_sql_str(v) for v in top) or "NULL"
        exprs.append(
            f"CASE WHEN `{c}` IS NULL THEN '__null__' WHEN CAST(`{c}` AS STRING) IN ({inlist}) "
            f"THEN CAST(`{c}` AS STRING) ELSE '__infrequent__' END AS `{c}__cap`"
        )
    cap = SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")
    cats = list(caps)
    idx = StringIndexer(inputCols=[f"{c}__cap" for c in cats], outputCols=[f"{c}__idx" for c in cats],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cats], outputCols=[f"{c}__ohe" for c in cats],
                        handleInvalid="keep", dropLast=False)
    asm = VectorAssembler(inputCols=num + [f"{c}__ohe" for c in cats], outputCol="features", handleInvalid="keep")
    return [cap, idx, ohe, asm]


@dataclass
class ModelBundle:
    name: str
    target: str
    num: list[str]
    cat: list[str]
    model: PipelineModel | boosting.Boosted | forest.Forest
    metrics: dict = field(default_factory=dict)
    test: DataFrame | None = None


def split(df: DataFrame, label: str | None = None, test_share: float = 0.2) -> DataFrame:
    """M3: reproducible split on the booking id, exact within each class of ``label``."""
    return mlprep.stratified_split(df, label, "booking_id", test_share)


def _frame(df: DataFrame, target: str, num: list[str]) -> DataFrame:
    cond = F.col(target).isNotNull()
    for c in num:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def train_eta_model(df: DataFrame, max_iter: int = 150, max_depth: int = 5, num: list[str] | None = None) -> ModelBundle:
    """M4: trip days regression (GBT), MAE on the held-out split."""
    num = num or NUMERIC
    m = split(_frame(df, "trip_days", num))
    train, test = m.where(F.col("split") == "train"), m.where(F.col("split") == "test")
    caps = category_caps(train, CATEGORICAL, 30)
    model = boosting.fit(train, "trip_days", num, caps, "squared", max_iter, max_depth)
    pred = model.transform(test)
    mae = pred.agg(F.avg(F.abs(F.col("prediction") - F.col("trip_days")))).first()[0]
    return ModelBundle("eta_gbt", "trip_days", num, CATEGORICAL, model,
                       {"test_mae_days": round(float(mae), 3) if mae is not None else None}, pred)


def train_delay_classifier(df: DataFrame, max_iter: int = 200, max_depth: int | None = None, algorithm: str = "gbt",
                           num: list[str] | None = None) -> ModelBundle:
    """M5/M6: late classifier with balanced class weights; AUC on the test split.  Trees have
    depth 6, those of the random forest 8, unless ``max_depth`` says otherwise."""
    num = num or NUMERIC
    max_depth = max_depth or (8 if algorithm == "rf" else 6)
    m = split(_frame(df, "is_late", num), "is_late")
    train = mlprep.with_class_weight(m.where(F.col("split") == "train"), "is_late", "class_weight")
    test = m.where(F.col("split") == "test")
    caps = category_caps(train, CATEGORICAL, 30)
    if algorithm == "rf":
        est = RandomForestClassifier(featuresCol="features", labelCol="is_late", weightCol="class_weight",
                                     numTrees=max_iter, maxDepth=max_depth, seed=RANDOM_STATE)
        model = Pipeline(stages=preprocessor(num, caps) + [est]).fit(train)
    else:
        model = boosting.fit(train, "is_late", num, caps, "logistic", max_iter, max_depth, weight="class_weight")
    pred = with_probability(model.transform(test))
    auc = BinaryClassificationEvaluator(labelCol="is_late", rawPredictionCol="late_probability").evaluate(
        pred.withColumn("is_late", F.col("is_late").cast("double"))
    )
    return ModelBundle(f"delay_{algorithm}", "is_late", num, CATEGORICAL, model, {"test_auc": round(auc, 3)}, pred)


def with_probability(scored: DataFrame) -> DataFrame:
    if "late_probability" in scored.columns:
        return scored
    return scored.withColumn("late_probability", vector_to_array(F.col("probability"))[1])


def report(bundle: ModelBundle) -> DataFrame:
    """M7 on the classifier's test rows at threshold 0.5."""
    t = bundle.test.withColumn("pred", (F.col("late_probability") >= 0.5).cast("int"))
    return mlprep.classification_report(t, "is_late", "pred")


def metrics_frame(spark, bundle: ModelBundle) -> DataFrame:
    rows = [(bundle.name, bundle.target, k, float(v) if v is not None else None) for k, v in bundle.metrics.items()]
    return spark.createDataFrame(rows, "model string, target string, metric string, value double")


def shipment_risk_score(df: DataFrame, bundle: ModelBundle) -> DataFrame:
    """M8: risk_score = round(100 x P(late), 1); NULL when a numeric input is
    NULL; every input row is kept."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in bundle.num])
    scored = with_probability(bundle.model.transform(df))
    keep = [c for c in df.columns]
    return scored.select(
        *keep,
        F.when(complete, F.col("late_probability")).alias("late_probability"),
        F.when(complete, F.round(F.col("late_probability") * 100.0, 1)).alias("risk_score"),
    )


def risk_queue(scored: DataFrame, n: int = 15) -> DataFrame:
    """M9: top-n bookings by risk (a top-k report: TakeOrderedAndProject)."""
    return scored.select("booking_id", "supplier_name", "route_id", "risk_score", "is_late").orderBy(
        F.col("risk_score").desc_nulls_last(), F.col("booking_id")
    ).limit(n)


def high_risk_queue(scored: DataFrame, dispatch: float = 65.0, review: float = 70.0,
                    horizon_h: float = 48.0) -> DataFrame:
    """Bookings over the dispatch threshold; flag those over the review
    threshold whose planned ETA is within ``horizon_h`` of the last ping."""
    hours_to_eta = (F.unix_micros("planned_eta") - F.unix_micros("gps_ping_time")) / 3.6e9
    return scored.where(F.col("risk_score") >= dispatch).select(
        "booking_id", "risk_score", hours_to_eta.alias("hours_to_planned_eta"),
        ((F.col("risk_score") >= review) & (hours_to_eta <= horizon_h)).alias("review_before_eta"),
    )


def eta_error_by_band(bundle: ModelBundle) -> DataFrame:
    """Mean absolute ETA error per distance band on the test rows."""
    return bundle.test.groupBy("distance_band").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(F.col("prediction") - F.col("trip_days"))).alias("mae_days"),
    )


# --- R6-R8: root-cause models --------------------------------------------------
def delay_driver_model(df: DataFrame, max_iter: int = 120, max_depth: int = 4) -> ModelBundle:
    """Delay-hours GBT on the R5 frame (categories capped at 25)."""
    from .diagnostics import model_frame

    m = split(model_frame(df))
    train, test = m.where(F.col("split") == "train"), m.where(F.col("split") == "test")
    caps = category_caps(train, MODEL_CATEGORICAL, 25)
    model = boosting.fit(train, "delay_hours", MODEL_NUMERIC, caps, "squared", max_iter, max_depth)
    pred = model.transform(test)
    mae = pred.agg(F.avg(F.abs(F.col("prediction") - F.col("delay_hours")))).first()[0]
    return ModelBundle("delay_driver_gbt", "delay_hours", MODEL_NUMERIC, MODEL_CATEGORICAL, model,
                       {"test_mae_hours": round(float(mae), 2) if mae is not None else None}, test)


def late_risk_model(df: DataFrame, num_trees: int = 200, max_depth: int = 8) -> ModelBundle:
    """Balanced random forest on the R5 frame; AUC on the test split."""
    from .diagnostics import model_frame

    m = materialize(split(model_frame(df), "is_late"), "late-frame")
    train = mlprep.with_class_weight(m.where(F.col("split") == "train"), "is_late", "class_weight")
    test = m.where(F.col("split") == "test")
    caps = category_caps(train, MODEL_CATEGORICAL, 25)
    model = forest.fit(train, "is_late", "booking_id", MODEL_NUMERIC, caps, num_trees, max_depth, "class_weight")
    pred = model.transform(test)
    auc = BinaryClassificationEvaluator(labelCol="is_late", rawPredictionCol="late_probability").evaluate(
        pred.withColumn("is_late", F.col("is_late").cast("double"))
    )
    return ModelBundle("late_risk_rf", "is_late", MODEL_NUMERIC, MODEL_CATEGORICAL, model,
                       {"test_auc": round(auc, 3)}, test)


def permutation_importance(bundle: ModelBundle, repeats: int = 5, seed: int = RANDOM_STATE) -> DataFrame:
    """Drop in R^2 (regressor) or accuracy (classifier) when one raw input
    column is permuted; mean and population std over ``repeats``.

    Each repeat is a keyed permutation of the rows' numbers.  One join brings each row the row it is
    permuted to, for all repeats; the columns are then swapped one at a time in place."""
    test = bundle.test
    feats = bundle.num + bundle.cat
    base = sequential_ids(test, ["booking_id"], "_rid").select((F.col("_rid") - 1).alias("_rid"), bundle.target, *feats)
    binned = not isinstance(bundle.model, PipelineModel)
    base = materialize(_binned(base, bundle) if binned else base, "importance-rows")
    n = base.count()
    swaps = F.array(*[F.struct(F.lit(k).alias("rep"), mlprep.permuted(F.col("_rid"), max(n, 1), seed * 1000 + k).alias("src")) for k in range(repeats)])
    donor = base.select(F.col("_rid").alias("_src"), F.col("_x").alias("_d") if binned else F.struct(*feats).alias("_d"))
    joined = base.withColumn("_s", F.explode(swaps)).select("*", F.col("_s.rep").alias("rep"), F.col("_s.src").alias("_src")).join(donor, "_src")
    base_score, perm = _binned_scores(base, joined, bundle) if binned else _column_scores(base, joined, bundle)
    drops = perm.crossJoin(F.broadcast(base_score)).withColumn("drop", F.col("base_score") - F.col("score"))
    out = drops.groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")
    )
    return out.orderBy(F.col("importance_mean").desc(), "feature")


def _is_regressor(bundle: ModelBundle) -> bool:
    return bundle.target == "delay_hours" or bundle.target == "trip_days"


def _binned(rows: DataFrame, bundle: ModelBundle) -> DataFrame:
    """_rid, the label, the row's bins as bytes and the sum over the model's trees."""
    enc, trees = bundle.model.enc, bundle.model.weighted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = enc.bins(b.columns[2:])
            total = np.zeros(b.num_rows)
            for tree, rate in trees:
                total += rate * tree.predict(x)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(x))
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends.buffers()[1], pa.py_buffer(x.T.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed, pa.array(total)], names=["_rid", "_y", "_x", "_f"])

    return rows.select("_rid", F.col(bundle.target).cast("double"), *enc.columns()).mapInArrow(run, "_rid long, _y double, _x binary, _f double")


def _binned_scores(base: DataFrame, joined: DataFrame, bundle: ModelBundle) -> tuple[DataFrame, DataFrame]:
    """The score without swaps, and those by feature and repeat: each task sums its rows' errors by feature and repeat."""
    model, regressor = bundle.model, _is_regressor(bundle)
    trees, names = model.weighted(), [*model.enc.thresholds, *model.enc.categories]

    def errors(y: np.ndarray, total: np.ndarray) -> np.ndarray:
        p = model.predicted(total)
        return (y - p) ** 2 if regressor else p == y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def add(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            rep, y, total = (t.column(c).to_numpy() for c in ("rep", "_y", "_f"))
            x, d = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, len(names)).T.copy() for c in ("_x", "_d"))
            scored = boosting.swapped(trees, x, d, total)
            for k in np.unique(rep):
                of = rep == k
                part = np.stack([np.array([of.sum(), y[of].sum(), (y[of] ** 2).sum(), errors(y[of], f[of]).sum()], float) for f in scored])
                sums[k] = sums.get(k, 0) + part

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= boosting.BLOCK:
                add(held)
                held = []
        if sum(h.num_rows for h in held):
            add(held)
        found = [(f, int(k), *part[i]) for k, part in sums.items() for i, f in enumerate(names)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], schema=pa.schema(
                [("feature", pa.string()), ("rep", pa.int32()), *[(c, pa.float64()) for c in ("n", "sy", "syy", "e")]]))

    def score(n, sy, syy, e):
        return 1 - e / (syy - sy**2 / n) if regressor else e / n

    parts = joined.select("rep", "_y", "_f", "_x", "_d").mapInArrow(run, "feature string, rep int, n double, sy double, syy double, e double")
    perm = parts.groupBy("feature", "rep").agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy", "e")])
    perm = perm.select("feature", "rep", score(*map(F.col, ("n", "sy", "syy", "e"))).alias("score"))
    y = F.col("_y")
    p = F.arrow_udf(lambda f: pa.array(model.predicted(f.to_numpy())), "double")("_f")
    whole = base.select("_y", p.alias("_p")).agg(
        F.count("_y").cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
        F.sum((y - F.col("_p")) ** 2 if regressor else (y == F.col("_p")).cast("double")).alias("e"))
    return whole.select(score(*map(F.col, ("n", "sy", "syy", "e"))).alias("base_score")), perm


def _column_scores(base: DataFrame, joined: DataFrame, bundle: ModelBundle) -> tuple[DataFrame, DataFrame]:
    """``_binned_scores`` of a model that reads columns: a copy of each row for each feature."""
    feats = bundle.num + bundle.cat
    swapped = joined.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in feats]))).select(
        "feature", "rep", bundle.target,
        *[F.when(F.col("feature") == f, F.col("_d")[f]).otherwise(F.col(f)).alias(f) for f in feats],
    )
    is_reg = _is_regressor(bundle)

    def score(frame: DataFrame, keys: list[str]) -> DataFrame:
        p = bundle.model.transform(frame)
        y = F.col(bundle.target).cast("double")
        if is_reg:
            g = p.groupBy(*keys).agg(
                F.sum((y - F.col("prediction")) ** 2).alias("sse"), F.sum(y).alias("sy"),
                F.sum(y * y).alias("syy"), F.count(F.lit(1)).alias("n"),
            )
            return g.select(*keys, (1 - F.col("sse") / (F.col("syy") - F.col("sy") ** 2 / F.col("n"))).alias("score"))
        return p.groupBy(*keys).agg(F.avg((F.col("prediction") == y).cast("double")).alias("score"))

    baseline = score(base.withColumn("_one", F.lit(1)), ["_one"]).select(F.col("score").alias("base_score"))
    perm = score(swapped, ["feature", "rep"])
    return baseline, perm


def top_drivers_text(importance: DataFrame, k: int = 3) -> DataFrame:
    """The k most important inputs as one comma-separated string."""
    top = importance.orderBy(F.col("importance_mean").desc(), F.col("feature")).limit(k)
    return top.agg(
        F.concat_ws(", ", F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("importance_mean")).alias("k"), F.col("feature")))),
            lambda s: s["feature"],
        )).alias("top_delay_drivers")
    )


def batch_score(df: DataFrame, bundle: ModelBundle, eta: ModelBundle | None = None) -> DataFrame:
    """Score rows for the prediction fact (risk = 100 x P(late)), in one pass over them.

    With an ETA model also the predicted arrival and the delay against plan, NULL where
    an input of that model is."""
    scored = shipment_risk_score(df, bundle)
    if eta is None:
        return scored
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in eta.num])
    arrival = F.timestamp_micros(F.unix_micros("trip_start") + (F.col("prediction") * 86400e6).cast("bigint"))
    out = eta.model.transform(scored).select(*scored.columns, F.when(complete, arrival).alias("predicted_eta_ts"))
    return out.withColumn("predicted_delay_h", hours_between("predicted_eta_ts", "planned_eta"))


def rounded_metrics(df: DataFrame) -> DataFrame:
    return df.withColumn("value", r(F.col("value"), 4))
