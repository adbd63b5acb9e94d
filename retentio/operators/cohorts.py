"""The KPI notebook's churn views, tenure cohorts and LTV distributions.

Rounding follows the notebook (numpy: half to even) via ``round_half_even``.
Groups with a null key are left out, as the notebook's groupings leave them
out. Pivots have a column for every plan that occurs; the per-plan histogram
and the LTV statistics start from one (plan, value, count) aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.expr import (
    PAYMENT_BAND_THRESHOLDS, PLAN_BAND_THRESHOLDS, TENURE_LABELS, lifecycle_stage, mean_of, mean_sql,
    money_double, rate, risk_band, round_half_even, sql_str, tenure_bucket, tenure_bucket_order,
)
from retentio.operators.common import order_aggregated, pivot_present
from retentio.operators.stats import exact_percentiles, null_safe_join, profile_counts, value_counts
from retentio.schemas import PLAN_DIMENSION

PLAN_TYPES = tuple(p for p, _, _ in PLAN_DIMENSION)
HISTOGRAM_BINS = 40


def _churn_counts(df: DataFrame, key: str | Column) -> DataFrame:
    """churned (sum of flags), total (count) and churn_rate (mean) per non-null key."""
    return (df.where(F.col(key).isNotNull() if isinstance(key, str) else key.isNotNull()).groupBy(key)
            .agg(F.expr("CAST(sum(CAST(churned = 'Yes' AS INT)) AS BIGINT)").alias("churned"),
                 F.count(F.lit(1)).alias("total"))
            .withColumn("churn_rate", rate("churned", "total")))


def churn_by_plan_banded(subs: DataFrame) -> DataFrame:
    """Churn by plan, highest first, with the notebook's risk band (> 0.30, > 0.15)."""
    return (_churn_counts(subs, "plan_type")
            .withColumn("risk_band", risk_band("churn_rate", PLAN_BAND_THRESHOLDS))
            .transform(order_aggregated, F.desc("churn_rate")))


def churn_by_payment_banded(subs: DataFrame) -> DataFrame:
    """Churn by payment method, lowest first, band thresholds > 0.30, > 0.20."""
    return (_churn_counts(subs, "payment_method")
            .withColumn("risk_band", risk_band("churn_rate", PAYMENT_BAND_THRESHOLDS))
            .transform(order_aggregated, F.asc("churn_rate")))


def churn_by_lifecycle_nb(subs: DataFrame) -> DataFrame:
    """Churn by the notebook's lifecycle bins (-1,6], (6,24], (24,999]; tenure
    outside the bins has no stage and is left out."""
    staged = subs.withColumn("lifecycle_stage", lifecycle_stage("subscription_months", "notebook"))
    return (_churn_counts(staged.where(F.col("lifecycle_stage").isNotNull()), "lifecycle_stage")
            .transform(order_aggregated, "lifecycle_stage"))


def mrr_by_plan_nb(subs: DataFrame) -> DataFrame:
    """Notebook form of MRR by plan: non-null id count, unrounded total and mean."""
    return (subs.where("plan_type IS NOT NULL").groupBy("plan_type")
            .agg(F.count("customer_id").alias("customers"),
                 F.sum("monthly_mrr").alias("_s"), F.count("monthly_mrr").alias("_n"))
            .select("plan_type", "customers", money_double("_s").alias("total_mrr"),
                    mean_of("_s", "_n").alias("avg_mrr"))
            .transform(order_aggregated, F.desc("total_mrr")))


def _bucketed(subs: DataFrame) -> DataFrame:
    return (subs.select("plan_type", "churned",
                        tenure_bucket().alias("tenure_bucket"),
                        tenure_bucket_order().alias("bucket_order"))
            .where(F.col("tenure_bucket").isNotNull() & F.col("plan_type").isNotNull()))


def _churn_pct(yes: str, total: str) -> Column:
    """round(100 * mean(flag), 1) with numpy rounding; null for an empty cell
    (``yes`` / ``total`` are aggregate expressions)."""
    return round_half_even(f"{mean_sql(yes, total)} * 100.0D", 1)


def cohort_retention_long(subs: DataFrame) -> DataFrame:
    """Tenure bucket x plan (observed cells only): churn % and retention
    (100 minus the already rounded churn %)."""
    return (_bucketed(subs).groupBy("tenure_bucket", "bucket_order", "plan_type")
            .agg(_churn_pct("count_if(churned = 'Yes')", "count(1)").alias("churn_pct"))
            .withColumn("retention_pct", F.expr("100.0D - churn_pct"))
            .transform(order_aggregated, "bucket_order", "plan_type"))


def cohort_churn_matrix(subs: DataFrame) -> DataFrame:
    """Churn % matrix: one row per tenure bucket, one column per plan type that occurs (those of the
    plan dimension always)."""
    return pivot_present(_bucketed(subs), ["tenure_bucket", "bucket_order"], "plan_type", PLAN_TYPES,
                         lambda cell: _churn_pct(f"count_if({cell} AND churned = 'Yes')", f"count_if({cell})")
                         ).transform(order_aggregated, "bucket_order")


def cohort_retention_matrix(subs: DataFrame) -> DataFrame:
    """Retention % heat map (transposed): one row per plan, one column per bucket."""
    cells = []
    for label in TENURE_LABELS:
        b = f"tenure_bucket = {sql_str(label)}"
        churn = _churn_pct(f"count_if({b} AND churned = 'Yes')", f"count_if({b})")
        cells.append((F.lit(100.0) - churn).alias(label))
    return _bucketed(subs).groupBy("plan_type").agg(*cells).transform(order_aggregated, "plan_type")


def ltv_stats_by_plan(subs: DataFrame, method: str = "exact", null_plan: bool = False) -> DataFrame:
    """Median, mean, sample std and count of non-null LTV per plan (2 dp). ``null_plan=True`` adds the row of
    customers without a plan; ``method="approx"`` takes the median from ``percentile_approx``."""
    rows = subs.select("plan_type", "lifetime_value") if null_plan else subs.where("plan_type IS NOT NULL").select("plan_type", "lifetime_value")
    stats = profile_counts(value_counts(rows, "lifetime_value", ["plan_type"]), ["plan_type"], [0.5])
    if method != "exact":
        stats = null_safe_join(stats.drop("p50"), exact_percentiles(rows, "lifetime_value", ["plan_type"], [0.5], method=method), ["plan_type"])
    return (stats.select("plan_type", round_half_even("p50", 2).alias("median"), round_half_even("mean", 2).alias("mean"),
                         round_half_even("std", 2).alias("std"), F.col("n").alias("count"))
            .transform(order_aggregated, "plan_type"))


def ltv_histogram_by_plan(subs: DataFrame, bins: int = HISTOGRAM_BINS, dense: bool = False) -> DataFrame:
    """Equal-width histogram of LTV per plan over that plan's own min-max range,
    last bin closed (a plan whose values are all equal uses min-0.5 .. max+0.5).
    Non-empty bins only; with ``dense=True`` every bin of every plan, empty ones with 0 customers.

    Ranges and bins both come from one (plan, value, count) aggregate of the source; the bins of a
    plan are generated from its range, and the counts are joined to them."""
    freq = value_counts(subs.where("plan_type IS NOT NULL"), "lifetime_value", ["plan_type"])
    rng = (freq.groupBy("plan_type").agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
           .selectExpr("plan_type",
                       "CASE WHEN _mx = _mn THEN _mn - 0.5D ELSE _mn END AS lo",
                       "CASE WHEN _mx = _mn THEN _mx + 0.5D ELSE _mx END AS hi"))
    nb = f"{float(bins)!r}D"
    # one row per plan joined to the distinct values of the plan
    counts = freq.join(rng, "plan_type").selectExpr(
        "plan_type", "lo", "hi", "_c", f"CAST(least(CAST({bins} AS BIGINT), FLOOR((_v - lo) * {nb} / (hi - lo)) + 1) AS INT) AS bin")
    counts = counts.groupBy("plan_type", "bin", "lo", "hi").agg(F.sum("_c").alias("customers"))
    if dense:
        domain = rng.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
        counts = (domain.join(counts.drop("lo", "hi"), ["plan_type", "bin"], "left")
                  .withColumn("customers", F.coalesce("customers", F.lit(0))))
    return (counts.selectExpr("plan_type", "bin",
                              f"lo + (hi - lo) * (bin - 1) / {nb} AS bin_start",
                              f"lo + (hi - lo) * bin / {nb} AS bin_end",
                              "customers")
            .transform(order_aggregated, "plan_type", "bin"))


def class_balance(subs: DataFrame) -> DataFrame:
    """Active vs churned counts and their share of all customers; customers without a status are in
    the total only."""
    counts = subs.groupBy("churned").agg(F.count(F.lit(1)).alias("customers"))
    # Share over the 2 aggregated rows (a window over groups, not over customers).
    return counts.withColumn("share", rate("customers", "sum(customers) OVER ()")).where("churned IS NOT NULL")
