"""Rule baselines, thresholds and targets as DataFrames.

Every rule returns rows of one shape: (rule_id, priority, metric, subject, n, baseline_value,
comparison_value, target_value).  ``metric`` is a code of this library; the report's sentences
are presentation and not built.

A rule reads its numbers from a source: an enriched frame, or ``RuleTables``, which all rules
share.  ``RuleTables`` scans the enriched frame three times whatever the number of rules: one
GROUPING SETS pass over the segment keys, one aggregate for the network and the cohorts, and one
pass over one material group for its quantiles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_false, r
from ..session import materialize
from . import kpis as K

REC_COLUMNS = ["rule_id", "priority", "metric", "subject", "n", "baseline_value", "comparison_value", "target_value"]
SEGMENT_KEYS = ["route_id", "supplier_name", "customer_name", "material_group", "booking_month"]


class FrameTables:
    """The numbers of the rules, each from a query of its own over the enriched frame."""

    def __init__(self, df: DataFrame):
        self.df = df

    def segment(self, key: str, min_n: int) -> DataFrame:
        return K.segment_performance(self.df, key, min_n)

    def network(self) -> DataFrame:
        return K.executive_kpis(self.df)

    def cohorts(self) -> DataFrame:
        return cohort_rates(self.df)

    def material(self, name: str) -> DataFrame:
        return K.material_lead_time(self.df.where(F.col("material_group") == name))

    def monthly(self) -> DataFrame:
        return K.delay_patterns(self.df)


class RuleTables(FrameTables):
    """The same numbers from two small tables that are written once."""

    def __init__(self, df: DataFrame):
        super().__init__(df)
        self._segments: DataFrame | None = None
        self._totals: DataFrame | None = None

    def _sets(self) -> DataFrame:
        if self._segments is None:
            sets = self.df.groupingSets([[k] for k in SEGMENT_KEYS], *SEGMENT_KEYS)
            rows = sets.agg(F.grouping_id().alias("_set"), *K.segment_aggs(), F.avg("is_late").alias("late_rate"))
            # Bit i of the id, from the left, is 0 for the key that is grouped.
            full = (1 << len(SEGMENT_KEYS)) - 1
            which = [F.when(F.col("_set") == full - (1 << (len(SEGMENT_KEYS) - 1 - i)), F.lit(k)) for i, k in enumerate(SEGMENT_KEYS)]
            self._segments = materialize(rows.select(
                F.coalesce(*which).alias("_key"), F.coalesce(*SEGMENT_KEYS).alias("_value"),
                *[c for c in rows.columns if c != "_set" and c not in SEGMENT_KEYS],
            ), "rule-segments")
        return self._segments

    def _one_key(self, key: str) -> DataFrame:
        rows = self._sets().where(F.col("_key") == key)
        return rows.withColumnRenamed("_value", key).withColumn("ontime_rate_pct", K.pct(F.col("ontime_rate"))).drop("_key")

    def segment(self, key: str, min_n: int) -> DataFrame:
        return self._one_key(key).where(F.col("total_bookings") >= min_n)

    def monthly(self) -> DataFrame:
        m = self._one_key("booking_month").where(F.col("booking_month").isNotNull())
        return m.withColumn("late_rate_pct", K.pct(F.col("late_rate"))).withColumnsRenamed({"total_bookings": "bookings", "avg_delay_hours": "avg_delay_h"})

    def _one_row(self) -> DataFrame:
        if self._totals is None:
            self._totals = materialize(self.df.agg(*K.executive_aggs(), *_cohort_aggs()), "rule-totals")
        return self._totals

    def network(self) -> DataFrame:
        return self._one_row().select(*K.EXECUTIVE_COLUMNS)

    def cohorts(self) -> DataFrame:
        return self._one_row().drop(*K.EXECUTIVE_COLUMNS)


def _tables(source: DataFrame | FrameTables) -> FrameTables:
    return FrameTables(source) if isinstance(source, DataFrame) else source


def _rec(df: DataFrame, rule_id: str, priority: str, metric: str, subject: Column | str, n: Column, baseline: Column,
         comparison: Column | None, target: Column | None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(rule_id).alias("rule_id"), F.lit(priority).alias("priority"), F.lit(metric).alias("metric"),
        (subject if isinstance(subject, Column) else F.lit(subject)).cast("string").alias("subject"),
        n.cast("bigint").alias("n"), baseline.cast("double").alias("baseline_value"),
        (none if comparison is None else comparison).cast("double").alias("comparison_value"),
        (none if target is None else target).cast("double").alias("target_value"),
    )


def network_target(baseline: Column) -> Column:
    """min(round(baseline + 12, 1), 55)."""
    return F.least(r(baseline + 12.0, 1), F.lit(55.0))


def rec_network(source: DataFrame | FrameTables) -> DataFrame:
    """Network on-time baseline and the capped 90-day target."""
    rate = F.col("ontime_rate_pct")
    return _rec(_tables(source).network(), "N1", "P0", "network_ontime_pct", "network", F.col("total_bookings"), rate,
                network_target(rate) - rate, network_target(rate))


def _worst(segments: DataFrame, key: str, k: int) -> DataFrame:
    return segments.orderBy(F.col("ontime_rate_pct").asc(), F.col("total_bookings").desc(), F.col(key)).limit(k)


def rec_lanes(source: DataFrame | FrameTables, route_min: int = 20, lane_min: int = 25, k: int = 3) -> DataFrame:
    """The k worst lanes (lowest on-time %) among busy routes."""
    worst = _worst(_tables(source).segment("route_id", max(route_min, lane_min)), "route_id", k)
    return _rec(worst, "N2", "P0", "lane_ontime_pct", F.col("route_id"), F.col("total_bookings"), F.col("ontime_rate_pct"),
                F.col("avg_delay_hours"), F.lit(50.0))


def lane_plans(source: DataFrame | FrameTables) -> DataFrame:
    """N2 with the plan's title, which names the whole lane."""
    lane = F.replace(F.col("subject"), F.lit("→"), F.lit(" to "))
    return rec_lanes(source).withColumn("initiative", F.concat(F.lit("Lane recovery plan: "), lane))


def rec_suppliers(source: DataFrame | FrameTables, min_n: int = 40, k: int = 3) -> DataFrame:
    """The k worst suppliers of the scorecard."""
    worst = _worst(_tables(source).segment("supplier_name", min_n), "supplier_name", k)
    return _rec(worst, "N3", "P1", "supplier_ontime_pct", F.col("supplier_name"), F.col("total_bookings"), F.col("ontime_rate_pct"),
                F.col("avg_delay_hours"), None)


def _customer(source: DataFrame | FrameTables, pattern: str, min_n: int) -> DataFrame:
    hit = _tables(source).segment("customer_name", min_n).where(F.lower(F.col("customer_name")).contains(pattern.lower()))
    return hit.orderBy(F.col("total_bookings").desc(), F.col("customer_name")).limit(1)


def rec_customer(source: DataFrame | FrameTables, pattern: str = "Larsen", min_n: int = 30) -> DataFrame:
    """The largest customer whose name contains ``pattern`` (any case)."""
    return _rec(_customer(source, pattern, min_n), "N4", "P1", "customer_ontime_pct", F.col("customer_name"), F.col("total_bookings"),
                F.col("ontime_rate_pct"), None, F.lit(35.0))


def rec_material(source: DataFrame | FrameTables, material: str = "Auto Parts") -> DataFrame:
    """One material group; target median trip = max(0.85 x median, 3)."""
    median = F.col("median_trip_days")
    return _rec(_tables(source).material(material), "N5", "P1", "material_ontime_pct", F.col("material_group"), F.col("bookings"),
                F.col("ontime_rate") * 100.0, median, F.greatest(median * 0.85, F.lit(3.0)))


def _cohort_aggs() -> list[Column]:
    """All cohort rates used by N6-N10 and S10."""
    cohorts = {
        "detour_high": F.col("route_detour_ratio") > 1.5,
        "detour_low": F.col("route_detour_ratio") <= 1.2,
        "long_haul": F.col("route_category") == "long_haul",
        "short_haul": F.col("route_category") == "short_haul",
        "market": F.col("shipment_type") == "Market",
        "regular": F.col("shipment_type") == "Regular",
    }
    aggs = []
    for name, cond in cohorts.items():
        c = null_false(cond)
        aggs += [
            F.count_if(c).alias(f"{name}_n"),
            (F.avg(F.when(c, F.col("is_ontime"))) * 100.0).alias(f"{name}_ot"),
        ]
    aggs += [
        (F.avg(null_false(F.col("idle_days_proxy") > 1).cast("double")) * 100.0).alias("idle_pct"),
        (F.avg(F.col("vehicle_type_imputed").cast("double")) * 100.0).alias("imputed_pct"),
        F.count(F.lit(1)).alias("rows"),
    ]
    return aggs


def cohort_rates(df: DataFrame) -> DataFrame:
    return df.agg(*_cohort_aggs())


def rec_detour(source: DataFrame | FrameTables, min_n: int = 50) -> DataFrame:
    """High-detour vs low-detour on-time, if both cohorts exceed min_n."""
    c = _tables(source).cohorts().where((F.col("detour_high_n") > min_n) & (F.col("detour_low_n") > min_n))
    return _rec(c, "N6", "P1", "high_detour_ontime_pct", "detour_ratio>1.5", F.col("detour_high_n"), F.col("detour_high_ot"),
                F.col("detour_low_ot"), F.col("detour_high_ot") + (F.col("detour_low_ot") - F.col("detour_high_ot")) / 2.0)


def rec_haul(source: DataFrame | FrameTables, min_n: int = 100) -> DataFrame:
    """Long-haul and short-haul cohort on-time (each needs min_n rows)."""
    c = _tables(source).cohorts()
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_n").alias("rows_of"), F.col(f"{k}_ot").alias("ot")) for k in ("long_haul", "short_haul")])
    c = c.select(F.explode(kinds).alias("h")).select("h.*").where(F.col("rows_of") >= min_n)
    return _rec(c, "N7", "P2", "haul_ontime_pct", F.col("kind"), F.col("rows_of"), F.col("ot"), None, F.col("ot") + 7.0)


def rec_shipment_type(source: DataFrame | FrameTables, min_n: int = 20) -> DataFrame:
    """Market vs Regular on-time, if Market has min_n rows."""
    c = _tables(source).cohorts().where(F.col("market_n") >= min_n)
    return _rec(c, "N8", "P2", "market_ontime_pct", "Market", F.col("market_n"), F.col("market_ot"), F.col("regular_ot"), F.col("regular_ot") - 5.0)


def rec_idle(source: DataFrame | FrameTables) -> DataFrame:
    """% of trips with an idle proxy above one day (NULL counts as no)."""
    return _rec(_tables(source).cohorts(), "N9", "P1", "idle_over_one_day_pct", "idle_days_proxy>1", F.col("rows"), F.col("idle_pct"), None,
                F.col("idle_pct") * 0.75)


def rec_imputed(source: DataFrame | FrameTables, min_pct: float = 5.0) -> DataFrame:
    """Vehicle master data completeness, only when imputation > min_pct."""
    c = _tables(source).cohorts().where(F.col("imputed_pct") > min_pct)
    return _rec(c, "N10", "P2", "vehicle_type_complete_pct", "vehicle_type", F.col("rows"), 100.0 - F.col("imputed_pct"), F.col("imputed_pct"), F.lit(99.0))


def rec_peak(source: DataFrame | FrameTables, min_months: int = 3) -> DataFrame:
    """Month with the highest late rate (first month on ties)."""
    peak = _tables(source).monthly().agg(F.min_by(F.struct("booking_month", "bookings", "late_rate_pct"), F.struct(-F.col("late_rate_pct"), "booking_month")).alias("p"),
                     F.count(F.lit(1)).alias("_months"))
    peak = peak.where(F.col("_months") >= min_months).select("p.*")
    return _rec(peak, "N11", "P1", "peak_month_late_pct", F.col("booking_month"), F.col("bookings"), F.col("late_rate_pct"), None,
                F.col("late_rate_pct") - 10.0)


def rec_risk(scored: DataFrame, dispatch: float = 65.0) -> DataFrame:
    """The late rate of the bookings at or over the dispatch score, against that of the rest; target 15 % lower."""
    high, low = null_false(F.col("risk_score") >= dispatch), null_false(F.col("risk_score") < dispatch)
    c = scored.agg(F.count_if(high).alias("n"), (F.avg(F.when(high, F.col("is_late"))) * 100.0).alias("high"), (F.avg(F.when(low, F.col("is_late"))) * 100.0).alias("low"))
    return _rec(c, "N12", "P2", "high_risk_late_pct", F.lit(f"risk_score>={dispatch:g}"), F.col("n"), F.col("high"), F.col("low"), F.col("high") * 0.85)


def rec_drivers(importance: DataFrame, k: int = 3) -> DataFrame:
    """The k inputs that delays depend on most, evidence for N1; one row each, n its place."""
    top = importance.orderBy(F.col("importance_mean").desc(), F.col("feature")).limit(k)
    place = F.row_number().over(Window.orderBy(F.col("importance_mean").desc(), F.col("feature")))  # k rows
    return _rec(top.withColumn("_place", place), "N13", "P0", "delay_driver", F.col("feature"), F.col("_place"), F.col("importance_mean"), F.col("importance_std"), None)


def recommendations(df: DataFrame, customer_pattern: str = "Larsen", material: str = "Auto Parts",
                    extra: list[DataFrame] | None = None) -> DataFrame:
    """N1-N11 (+ model-based rules passed in ``extra``) as one table, from shared tables."""
    t = RuleTables(df)
    parts = [
        rec_network(t), rec_lanes(t), rec_suppliers(t), rec_customer(t, customer_pattern),
        rec_material(t, material), rec_detour(t), rec_haul(t), rec_shipment_type(t), rec_idle(t),
        rec_imputed(t), rec_peak(t), *(extra or []),
    ]
    return reduce(DataFrame.unionByName, parts)


def metric_extract(df: DataFrame, customer_pattern: str = "Larsen", material: str = "Auto Parts",
                   k: int = 5) -> DataFrame:
    """Headline metrics as long rows (section, key, metric, value), from the rules' shared tables."""

    def long(frame: DataFrame, section: str, key: Column, metrics: list[str]) -> DataFrame:
        stack = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
        return frame.select(F.lit(section).alias("section"), key.cast("string").alias("key"),
                            F.expr(f"stack({len(metrics)}, {stack}) AS (metric, value)"))

    t = RuleTables(df)
    seg = ["total_bookings", "ontime_rate_pct", "avg_delay_hours"]
    peak = t.monthly().orderBy(F.col("late_rate_pct").desc(), F.col("booking_month")).limit(1)
    parts = [
        long(t.network(), "kpis", F.lit(None), K.EXECUTIVE_COLUMNS),
        long(_worst(t.segment("route_id", 20), "route_id", k), "bad_routes", F.col("route_id"), seg),
        long(_worst(t.segment("supplier_name", 40), "supplier_name", k), "worst_suppliers", F.col("supplier_name"), seg),
        long(_customer(t, customer_pattern, 30), "customer", F.col("customer_name"), seg + ["ontime_bookings"]),
        long(t.material(material), "material", F.col("material_group"),
             ["bookings", "median_trip_days", "p90_trip_days", "ontime_rate", "avg_delay_h"]),
        long(peak, "peak_month", F.col("booking_month"), ["bookings", "late_rate_pct", "avg_delay_h"]),
        long(t.cohorts(), "cohorts", F.lit(None),
             ["detour_high_ot", "detour_low_ot", "long_haul_ot", "short_haul_ot", "market_ot", "regular_ot"]),
    ]
    return reduce(DataFrame.unionByName, parts)
