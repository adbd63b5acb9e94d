"""Tables of the KPI workbook (raw data, KPI block, three chart tables)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.expr import (
    LTV_EDGES_REFERENCE, cut_ordinal, lifecycle_stage, ltv_bin_labels, mean_sql, money_double,
    round_half_away_sql, sql_str,
)
from retentio.operators.common import order_aggregated
from retentio.sources.literals import literal_table, plan_dimension, with_plan_labels

# KPI block labels and their number formats, in sheet order.
KPI_ROWS = (
    ("Total MRR (Active)", "$#,##0"),
    ("Churn Rate %", "0.00%"),
    ("Avg LTV", "$#,##0"),
    ("Avg Tenure Months", "0.0"),
    ("At-Risk MRR", "$#,##0"),
    ("LTV MRR Ratio", "0.0"),
)


def raw_data(subs: DataFrame) -> DataFrame:
    """RawData sheet: the workbook's source query (projection, half-open stage,
    ordered by customer id)."""
    return (subs.select("customer_id", "plan_type", "subscription_months",
                        money_double("monthly_mrr").alias("monthly_mrr"),
                        money_double("lifetime_value").alias("lifetime_value"),
                        "churned", "payment_method",
                        lifecycle_stage("subscription_months", "half_open").alias("lifecycle_stage"))
            .orderBy("customer_id"))


def format_value_sql(value: str, number_format: str) -> str:
    """Display text (SQL) for the three number formats of the KPI block (the value
    is rounded half away from zero first, so the text never depends on a tie rule)."""
    if number_format == "$#,##0":
        return f"concat('$', format_number({round_half_away_sql(value, 0)}, 0))"
    if number_format == "0.00%":
        return f"concat(format_number({round_half_away_sql(f'({value}) * 100.0D', 2)}, 2), '%')"
    if number_format == "0.0":
        return f"format_number({round_half_away_sql(value, 1)}, 1)"
    raise ValueError(number_format)


def kpi_block(subs: DataFrame) -> DataFrame:
    """The six KPIs from one aggregation pass, unpivoted to (metric, value) rows."""
    a = subs.agg(*[F.expr(e).alias(n) for n, e in (
        ("active_mrr", "sum(CASE WHEN churned = 'No' THEN monthly_mrr END)"),
        ("n_yes", "count_if(churned = 'Yes')"),
        ("n", "count(1)"),
        ("ltv_s", "sum(lifetime_value)"), ("ltv_n", "count(lifetime_value)"),
        ("ten_s", "sum(CASE WHEN churned = 'No' THEN subscription_months END)"),
        ("ten_n", "count(CASE WHEN churned = 'No' THEN subscription_months END)"),
        ("risk_mrr", "sum(CASE WHEN churned = 'No' AND subscription_months < 6 THEN monthly_mrr END)"),
        ("mrr_s", "sum(monthly_mrr)"), ("mrr_n", "count(monthly_mrr)"),
    )])
    values = [
        "CAST(active_mrr AS DOUBLE)",
        mean_sql("n_yes", "n"),
        mean_sql("ltv_s", "ltv_n"),
        mean_sql("ten_s", "ten_n"),
        "CAST(risk_mrr AS DOUBLE)",
        f"try_divide({mean_sql('ltv_s', 'ltv_n')}, {mean_sql('mrr_s', 'mrr_n')})",
    ]
    rows = ", ".join(
        f"struct({i + 1} AS row_order, {sql_str(label)} AS metric, {v} AS value, "
        f"{sql_str(fmt)} AS number_format, {format_value_sql(v, fmt)} AS display)"
        for i, ((label, fmt), v) in enumerate(zip(KPI_ROWS, values)))
    return a.selectExpr(f"inline(array({rows}))")


def active_mrr_by_plan_label(subs: DataFrame) -> DataFrame:
    """Chart table: active MRR per plan, labelled, in plan order (aggregate first,
    then join the 3-row dimension to the 3 aggregated rows)."""
    agg = (subs.where(F.col("churned") == "No").groupBy("plan_type")
           .agg(F.sum("monthly_mrr").alias("_s")))
    return (with_plan_labels(agg)
            .select("plan_order", "plan_label", money_double("_s").alias("total_mrr"))
            .transform(order_aggregated, "plan_order"))


def churn_by_plan_label(subs: DataFrame) -> DataFrame:
    """Chart table: churn rate per plan, labelled, in plan order."""
    agg = (subs.groupBy("plan_type")
           .agg(F.expr(mean_sql("count_if(churned = 'Yes')", "count(1)")).alias("churn_rate")))
    return with_plan_labels(agg).select("plan_order", "plan_label", "churn_rate").transform(order_aggregated, "plan_order")


def ltv_distribution(subs: DataFrame, edges: Sequence[float] = LTV_EDGES_REFERENCE) -> DataFrame:
    """Chart table: customers per LTV bin over the dense list of bin labels
    (right-closed bins, lowest edge included; an empty bin shows 0, a value above
    the last edge and a null LTV are not counted)."""
    labels = ltv_bin_labels(edges)
    spark = subs.sparkSession
    bins = literal_table(spark, [(i + 1, lab) for i, lab in enumerate(labels)],
                         T.StructType([T.StructField("bin_order", T.IntegerType()),
                                       T.StructField("ltv_range", T.StringType())]))
    counts = (subs.where(F.col("lifetime_value").isNotNull())
              .select(cut_ordinal("lifetime_value", edges, include_lowest=True).alias("bin_order"))
              .where(F.col("bin_order").isNotNull())
              .groupBy("bin_order").agg(F.count(F.lit(1)).alias("customers")))
    # counts has at most one row per bin (keys are bin numbers): broadcast-safe.
    return (bins.join(F.broadcast(counts), "bin_order", "left")
            .select("bin_order", "ltv_range", F.coalesce("customers", F.lit(0)).alias("customers"))
            .transform(order_aggregated, "bin_order"))


def plan_dimension_usage(subs: DataFrame) -> DataFrame:
    """Plan dimension with the number of fact rows per plan (dense: a plan with no customers shows 0), and
    the plans of the facts that the dimension lacks, null included, without order and label, at the end."""
    counts = subs.groupBy("plan_type").agg(F.count(F.lit(1)).alias("customers")).withColumnRenamed("plan_type", "_plan")
    return (plan_dimension(subs.sparkSession).join(counts, F.col("plan_type") == F.col("_plan"), "full")
            .select(F.coalesce("plan_type", "_plan").alias("plan_type"), "plan_order", "plan_label",
                    F.coalesce("customers", F.lit(0)).alias("customers"))
            .transform(order_aggregated, F.asc_nulls_last("plan_order"), F.asc_nulls_last("plan_type")))
