"""Model data preparation and exact metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RANDOM_STATE
from ..session import materialize
from .quantiles import exact_quantiles


def stratified_split(df: DataFrame, label: str | None, key: str = "booking_id", test_share: float = 0.2,
                     seed: int = RANDOM_STATE) -> DataFrame:
    """M3: 'test' for the rows of each class with the lowest key hashes, round(n * test_share) of them; else 'train'.

    The wanted rank's hash is found by counting: hashes by their first three hex digits, then by the next three
    within the digits that hold the rank, then the few left one by one.  No class is sorted or collected.
    Rows of equal key stay together (the test part may then be short of them).  NULL labels are a class;
    ``label=None`` takes all rows as one.  There is one threshold for each class: a label has few.
    """
    kind = F.lit(0) if label is None else F.col(label)
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.select(kind.alias("_class"), hashed.alias("_h"))  # hashed anew in each of three passes, which takes no disk
    upto = Window.partitionBy("_class").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def counted(part: DataFrame, digits: Column) -> DataFrame:
        return part.groupBy("_class", digits.alias("_d")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))

    def holding(part: DataFrame, need: Column) -> DataFrame:
        return part.where((F.col("_upto") - F.col("_n") < need) & (need <= F.col("_upto")))

    def within(prefixes: DataFrame, digits: Column) -> DataFrame:
        p = prefixes.withColumnRenamed("_class", "_c")
        return rows.join(F.broadcast(p), F.col("_class").eqNullSafe(F.col("_c")) & (digits == F.col("_p"))).drop("_c")

    first = counted(rows, F.substring("_h", 1, 3))
    first = first.withColumn("_want", F.floor(F.sum("_n").over(Window.partitionBy("_class")) * F.lit(test_share) + 0.5))
    at = materialize(holding(first, F.col("_want")).select("_class", F.col("_d").alias("_p"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_need")), "split-prefix")
    second = counted(within(at, F.substring("_h", 1, 3)), F.substring("_h", 1, 6)).join(
        F.broadcast(at.select(F.col("_class").alias("_c"), "_need")), F.col("_class").eqNullSafe(F.col("_c"))).drop("_c")
    at = materialize(holding(second, F.col("_need")).select("_class", F.col("_d").alias("_p"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need")), "split-prefix")
    third = counted(within(at, F.substring("_h", 1, 6)), F.col("_h")).join(
        F.broadcast(at.select(F.col("_class").alias("_c"), "_p", "_need")), F.col("_class").eqNullSafe(F.col("_c"))).drop("_c")
    # All hashes below the prefix are in the test part already; the prefix sorts before all that have it.
    last = third.groupBy("_class").agg(F.coalesce(F.max(F.when(F.col("_upto") <= F.col("_need"), F.col("_d"))), F.max("_p")).alias("_last"))
    last = F.broadcast(materialize(last, "split-thresholds").withColumnRenamed("_class", "_c"))
    test = hashed <= F.col("_last")
    return df.join(last, kind.eqNullSafe(F.col("_c")), "left").select(*df.columns, F.when(test, "test").otherwise("train").alias("split"))


# --- keyed permutations of [0, n)
_ROUNDS = 6


def _sides(n: int) -> tuple[int, int]:
    """a * b >= n with a near the square root of n and as little excess as a short search finds."""
    low = max(1, math.isqrt(max(n - 1, 0)) + 1)
    a = min(range(low, low + 2000), key=lambda a: (a * -(-n // a) - n, a))
    return a, max(1, -(-n // a))


def permuted(index: Column, n: int, key: int) -> Column:
    """A bijection of [0, n) chosen by ``key``: a Feistel network on pairs (x div b, x mod b), walked again while
    the result is n or more.  At most a * b - n results are, so that many walks settle all."""
    a, b = _sides(n)

    def network(x: Column) -> Column:
        start = F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
        if n > 1 << 52:
            raise ValueError("too many rows for exact division")

        def turn(p: Column, k: Column) -> Column:
            left = F.pmod(p["l"] + F.pmod(F.xxhash64(p["r"], k), F.lit(a)), F.lit(a)).cast("bigint")
            right = F.pmod(p["r"] + F.pmod(F.xxhash64(left, k, F.lit("r")), F.lit(b)), F.lit(b)).cast("bigint")
            return F.struct(left.alias("l"), right.alias("r"))

        keys = F.array(*[F.lit(key * _ROUNDS + i).cast("bigint") for i in range(_ROUNDS)])
        return F.aggregate(keys, start, turn, lambda p: p["l"] * F.lit(b) + p["r"])

    out = network(index.cast("bigint"))
    if a * b > n:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), out, lambda x, _: F.when(x >= n, network(x)).otherwise(x))
    return out


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """M6: balanced weights n / (k * n_c) per class (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(tot)).select(
        label, "n_c", (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight")
    )


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach M6 weights (the class table has one row per class: broadcast)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label, "left")


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """M7: precision / recall / f1 / support for classes 0 and 1, accuracy,
    macro and weighted averages, from one conditional aggregate."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    c = df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def f1(pr, rc):
        return F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(F.lit(0.0))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    m = c.select(
        div(tn, tn + fn).alias("p0"), div(tn, tn + fp).alias("r0"), (tn + fp).alias("s0"),
        div(tp, tp + fp).alias("p1"), div(tp, tp + fn).alias("r1"), (tp + fn).alias("s1"),
        (tp + tn + fp + fn).alias("n"), div(tp + tn, tp + tn + fp + fn).alias("acc"),
    ).select("*", f1(F.col("p0"), F.col("r0")).alias("f0"), f1(F.col("p1"), F.col("r1")).alias("f1"))
    return m.selectExpr(
        "stack(5, "
        "'0', p0, r0, f0, s0, "
        "'1', p1, r1, f1, s1, "
        "'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n, "
        "'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n, "
        "'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n"
        ") AS (class, precision, recall, f1_score, support)"
    )


ROUTE_FEATURES = ["ontime_rate", "avg_delay", "avg_trip_days", "avg_detour", "bookings"]


def route_vectors(df: DataFrame, min_bookings: int = 5) -> DataFrame:
    """Route KPI vectors (>= min_bookings), missing means -> 0."""
    g = (
        df.where(F.col("route_id").isNotNull())
        .groupBy("route_id")
        .agg(
            F.count("booking_id").alias("bookings"),
            F.avg("is_ontime").alias("ontime_rate"),
            F.avg("delay_hours").alias("avg_delay"),
            F.avg("trip_days").alias("avg_trip_days"),
            F.avg("route_detour_ratio").alias("avg_detour"),
        )
        .where(F.col("bookings") >= min_bookings)
    )
    return g.fillna(0.0, subset=["ontime_rate", "avg_delay", "avg_trip_days", "avg_detour"])


def _feature_medians(frame: DataFrame, exprs: dict, prefix: str) -> DataFrame:
    """One-row frame of exact medians, one per expression (distributed sort
    over the unpivoted values)."""
    long = frame.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("f"), e.cast("double").alias("v")) for k, e in exprs.items()
    ])).alias("m")).select("m.f", "m.v")
    med = exact_quantiles(long, "v", [0.5], ["f"], ["med"])
    return med.groupBy().pivot("f", list(exprs)).agg(F.first("med")).select(
        *[F.col(k).alias(f"{prefix}{k}") for k in exprs]
    )


def robust_outliers(vectors: DataFrame, key: str, features: Sequence[str], z_cut: float = 3.5) -> DataFrame:
    """Modified z = 0.6745 (x - median) / MAD per feature; outlier when
    any |z| exceeds ``z_cut``.  Medians and MADs are one-row tables."""
    med = _feature_medians(vectors, {f: F.col(f) for f in features}, "_med_")
    v = vectors.crossJoin(F.broadcast(med))
    mad = _feature_medians(v, {f: F.abs(F.col(f) - F.col(f"_med_{f}")) for f in features}, "_mad_")
    v = v.crossJoin(F.broadcast(mad))
    zs = [
        F.when(F.col(f"_mad_{f}") > 0, F.abs(0.6745 * (F.col(f) - F.col(f"_med_{f}")) / F.col(f"_mad_{f}")))
        .otherwise(F.lit(0.0))
        for f in features
    ]
    out = v.withColumn("max_abs_z", F.greatest(*zs))
    return out.select(key, *features, "max_abs_z", (F.col("max_abs_z") > z_cut).alias("is_outlier"))


def psi_drift(df: DataFrame, col: str, cutoff: str, date_col: str = "booking_date", bins: int = 10,
              floor: float = 1e-4) -> DataFrame:
    """Weekly population stability index of ``col`` against the period
    before ``cutoff``.  Bin edges are the baseline deciles; a value falls in
    bin = number of edges below it.  PSI = sum (p - q) ln(p / q), NULL for
    all weeks if the baseline is empty."""
    x = df.where(F.col(col).isNotNull() & F.col(date_col).isNotNull()).select(
        F.col(col).cast("double").alias("x"), F.col(date_col).alias("d")
    )
    base = x.where(F.col("d") < F.to_timestamp(F.lit(cutoff)))
    qs = [k / bins for k in range(1, bins)]
    names = [f"e{k}" for k in range(1, bins)]
    dec = exact_quantiles(base, "x", qs, names=names)  # distributed exact deciles
    edges = dec.agg(F.first(F.array(*[F.col(n) for n in names])).alias("edges"))  # one row; NULL without a baseline
    binned = x.join(F.broadcast(edges), F.lit(True), "left").withColumn(
        "bin", F.aggregate("edges", F.lit(0), lambda acc, e: acc + F.when(F.col("x") > e, 1).otherwise(0))
    )
    is_base = F.col("d") < F.to_timestamp(F.lit(cutoff))
    week = F.when(~is_base, F.to_date(F.date_trunc("week", F.col("d"))))
    # Weeks x bins rows: all that follows reads this table.
    counts = materialize(binned.groupBy(week.alias("week_start"), "bin").agg(F.count(F.lit(1)).alias("n")), "psi-counts")
    q = counts.where(F.col("week_start").isNull()).select("bin", F.col("n").alias("qn"))
    q = q.join(F.broadcast(q.agg(F.sum("qn").alias("qt"))), F.lit(True), "left").select("bin", (F.col("qn") / F.col("qt")).alias("q"))
    p = counts.where(F.col("week_start").isNotNull()).select("week_start", "bin", F.col("n").alias("pn"))
    pt = p.groupBy("week_start").agg(F.sum("pn").alias("pt"), F.count("bin").alias("_known"))
    # every (week, bin) pair, so empty bins contribute through the floor;
    # the bin table has exactly ``bins`` rows (bounded broadcast).
    all_bins = base.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    qb = all_bins.join(q, "bin", "left")
    grid = pt.crossJoin(F.broadcast(qb))
    j = grid.join(p, ["week_start", "bin"], "left").select(
        "week_start", "bin",
        F.greatest(F.coalesce(F.col("pn"), F.lit(0)) / F.col("pt"), F.lit(floor)).alias("p"),
        F.greatest(F.coalesce(F.col("q"), F.lit(0.0)), F.lit(floor)).alias("q"),
        "pt", "_known",
    )
    index = F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q")))
    return j.groupBy("week_start").agg(
        F.max("pt").alias("rows"), F.when(F.max("_known") > 0, index).alias("psi"),
    ).select(F.lit(col).alias("feature"), F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "rows", "psi")
