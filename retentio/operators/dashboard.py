"""The report pages' visuals as DataFrame queries over the measure catalogue.

Each visual is one aggregation pass over ``subscriptions`` joined (broadcast,
3-row literal) to the plan dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.functions.expr import (
    BAND_LABELS, REPORT_BAND_COLORS, REPORT_BAND_THRESHOLDS, lifecycle_stage, mean_of, mean_sql,
    risk_band, round_half_away_sql, sql_str,
)
from retentio.operators.measures import CARD_MEASURES, IMPLICIT_SUMS, MEASURES, measure_query
from retentio.schemas import PLAN_DIMENSION
from retentio.operators.common import order_aggregated
from retentio.sources.literals import plan_dimension, with_plan_labels

# Gauge scale, target and alert rule of the churn gauge.
GAUGE_MIN, GAUGE_MAX, GAUGE_TARGET = 0.0, 0.5, 0.2


# Fixed value: the report's currency type is a fixed decimal with 4 places.
CURRENCY = "decimal(19,4)"


def report_facts(subs: DataFrame) -> DataFrame:
    """Fact rows as the report sees them: money retyped to the report's currency
    type at import, plan labels joined, and the calculated ``lifecycle_stage``
    column (half-open rule)."""
    return (with_plan_labels(subs)
            .withColumns({"monthly_mrr": F.col("monthly_mrr").cast(CURRENCY),
                          "lifetime_value": F.col("lifetime_value").cast(CURRENCY),
                          "lifecycle_stage": lifecycle_stage("subscription_months", "half_open")}))


def _sliced_facts(subs: DataFrame, plan_labels: Sequence[str] | None) -> tuple[DataFrame, dict | None]:
    """Report facts and slicer of the plan-label slicer (none selected: all rows).
    The dimension is a fixed table, so the label filter maps to plan types without
    reading data; filtering the fact on them lets the scan skip data."""
    if not plan_labels:
        return report_facts(subs), None
    types = [t for t, _, label in PLAN_DIMENSION if label in set(plan_labels)]
    return report_facts(subs.where(F.col("plan_type").isin(types))), {"plan_label": list(plan_labels)}


def kpi_cards(subs: DataFrame, plan_labels: Sequence[str] | None = None) -> DataFrame:
    """The six KPI cards plus the hidden all-customer MRR, one row; optionally
    under the plan-label slicer (filter on the dimension, propagated to the fact)."""
    facts, slicer = _sliced_facts(subs, plan_labels)
    return measure_query(facts, list(CARD_MEASURES) + ["total_mrr_all"], (), slicer)


def measure_override_by_status(subs: DataFrame) -> DataFrame:
    """All card measures per (plan label, churned status). Measures that fix
    ``churned`` (Total MRR, Avg Tenure, At-Risk MRR) replace the status group's
    filter, so both status rows of a plan show the active-customer value."""
    return measure_query(report_facts(subs), CARD_MEASURES, ("plan_label", "churned"))


def implicit_sums_by_label(subs: DataFrame) -> DataFrame:
    """The model's default summarization (SUM) of its numeric columns per plan label."""
    return (measure_query(report_facts(subs), IMPLICIT_SUMS, ("plan_label",))
            .transform(order_aggregated, "plan_label"))


def _band_color(band: str) -> F.Column:
    cases = " ".join(f"WHEN {sql_str(b)} THEN {sql_str(c)}" for b, c in zip(BAND_LABELS, REPORT_BAND_COLORS))
    return F.expr(f"CASE {band} {cases} END")


def bars_mrr_by_label(subs: DataFrame, plan_labels: Sequence[str] | None = None) -> DataFrame:
    """Total MRR per plan label (descending) with the tooltip's non-null count of
    the dimension's ``plan_order`` and the measure's tooltip text; optionally under
    the plan-label slicer. Facts of an unknown or null plan are the blank label's bar."""
    facts, slicer = _sliced_facts(subs, plan_labels)
    m = measure_query(facts, ["total_mrr"], ("plan_label",), slicer).withColumnRenamed("plan_label", "_label")
    dim = plan_dimension(subs.sparkSession)
    if plan_labels:
        dim = dim.where(F.col("plan_label").isin(list(plan_labels)))
    dim = dim.groupBy("plan_label").agg(F.count("plan_order").alias("plan_order_count"))
    return (dim.join(m, F.col("plan_label").eqNullSafe(F.col("_label")), "full")
            .select(F.coalesce("plan_label", "_label").alias("plan_label"), "plan_order_count", "total_mrr",
                    F.lit(MEASURES["total_mrr"].tooltip).alias("tooltip"))
            .transform(order_aggregated, F.desc_nulls_last("total_mrr")))


def bars_churn_by(subs: DataFrame, category: str) -> DataFrame:
    """Churn Rate % per category (descending) with the report's colour band
    (>= 0.30 high, >= 0.15 medium, >= 0 low); without churned rows no value and no band."""
    m = measure_query(report_facts(subs), ["churn_rate"], (category,))
    band = risk_band("churn_rate", REPORT_BAND_THRESHOLDS, inclusive=True)
    return (m.withColumn("band", band)
            .withColumn("color", _band_color("band"))
            .transform(order_aggregated, F.desc("churn_rate")))


def stage_plan_matrix(subs: DataFrame) -> DataFrame:
    """Matrix: lifecycle stage rows x plan label columns of Churn Rate %, totals
    off. One pass: each cell is a conditional count pair (what a pivot with a
    fixed value list does); a cell without rows, or without churned ones, is null.
    Rows of an unknown or null plan are in the column of the blank label."""
    f = report_facts(subs)
    cells = []
    for label in [*(label for _, _, label in PLAN_DIMENSION), None]:
        in_plan = f"plan_label = {sql_str(label)}" if label else "plan_label IS NULL"
        cells.append(F.expr(mean_sql(f"nullif(count_if({in_plan} AND churned = 'Yes'), 0)", f"count_if({in_plan})"))
                     .alias(label or "(Blank)"))
    return f.groupBy("lifecycle_stage").agg(*cells)


def tenure_mrr_scatter(subs: DataFrame) -> DataFrame:
    """Scatter points: per (tenure, churned) the average MRR and the non-null
    customer count."""
    return (subs.groupBy("subscription_months", "churned")
            .agg(F.sum("monthly_mrr").alias("_s"), F.count("monthly_mrr").alias("_n"),
                 F.count("customer_id").alias("customers"))
            .select("subscription_months", "churned",
                    mean_of("_s", "_n").alias("avg_mrr"), "customers"))


def format_measure_sql(value: str, format_string: str) -> str:
    """Display text (SQL) of a measure value for the report's format strings (the
    value is rounded half away from zero first, so the text never depends on a tie
    rule)."""
    if format_string == '"$" #,##0':
        return f"concat('$', format_number({round_half_away_sql(value, 0)}, 0))"
    if format_string == "0.00%":
        return f"concat(format_number({round_half_away_sql(value + ' * 100.0D', 2)}, 2), '%')"
    if format_string == '0.0 "mths"':
        return f"concat(format_number({round_half_away_sql(value, 1)}, 1), ' mths')"
    if format_string == "0.0":
        return f"format_number({round_half_away_sql(value, 1)}, 1)"
    raise ValueError(format_string)


def kpi_cards_display(subs: DataFrame) -> DataFrame:
    """The six KPI cards as rows: label, value, formatted text and tooltip text
    (one aggregation pass, then an unpivot of the single row)."""
    cards = kpi_cards(subs)
    rows = ", ".join([
        f"struct({i + 1} AS card_order, {sql_str(MEASURES[m].label)} AS measure, {m} AS value, "
        f"{format_measure_sql(m, MEASURES[m].format_string)} AS display, "
        f"{sql_str(MEASURES[m].tooltip)} AS tooltip)"
        for i, m in enumerate(CARD_MEASURES)])
    return cards.selectExpr(f"inline(array({rows}))")


def churn_gauge(subs: DataFrame, plan_labels: Sequence[str] | None = None) -> DataFrame:
    """Churn Rate % on a 0-0.5 gauge with target 0.20; alert when >= target;
    optionally under the plan-label slicer."""
    facts, slicer = _sliced_facts(subs, plan_labels)
    m = measure_query(facts, ["churn_rate"], (), slicer)
    return m.select(
        "churn_rate",
        F.lit(GAUGE_MIN).alias("gauge_min"), F.lit(GAUGE_MAX).alias("gauge_max"),
        F.lit(GAUGE_TARGET).alias("target"),
        F.when(F.col("churn_rate") >= GAUGE_TARGET, "alert").otherwise("ok").alias("status"),
        F.lit(MEASURES["churn_rate"].tooltip).alias("tooltip"))
