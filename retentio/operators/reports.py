"""The query file's nine reports, as DataFrame operators over ``subscriptions``
and ``exposures``.

Plan notes (checked with ``explain``):
* every GROUP BY is a partial + final hash aggregate on a low-cardinality key,
  so the shuffle carries a handful of rows per map task;
* ORDER BY ... LIMIT becomes ``TakeOrderedAndProject`` (top-k per task, no full sort);
* ranks follow from counts per (plan, price); a partial ``WindowGroupLimit`` keeps the
  top prices of each plan, and no customer row is sorted to be ranked;
* the overall average LTV is a total over the stages' rows; the overall average MRR
  is an uncorrelated scalar subquery, computed once and broadcast as a literal (no cross join);
* means and percentages are rounded like SQL ``ROUND(numeric)``: exact integer
  ratios (money in cents) rounded half away from zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.functions.expr import cents, lifecycle_stage, money_double, round_ratio_sql
from retentio.operators.common import order_aggregated
from retentio.operators.stats import null_safe_join

YES = "Yes"


def customers_by_plan(subs: DataFrame) -> DataFrame:
    """Q1: customers per plan, largest first."""
    return (subs.groupBy("plan_type")
            .agg(F.count(F.lit(1)).alias("customer_count"))
            .transform(order_aggregated, F.desc("customer_count")))


def mrr_by_plan_all(subs: DataFrame) -> DataFrame:
    """Q2: count, total MRR (0 dp) and average MRR (2 dp) per plan, all customers."""
    return (subs.groupBy("plan_type")
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.sum("monthly_mrr").alias("_sum"),
                 F.count("monthly_mrr").alias("_n"))
            .select("plan_type", "customers",
                    money_double("round(_sum, 0)").alias("total_mrr"),
                    F.expr(round_ratio_sql(cents("_sum"), "_n * 100", 2)).alias("avg_mrr_per_customer"))
            .transform(order_aggregated, F.desc("total_mrr")))


def newest_customers(subs: DataFrame, max_months: int = 6, limit: int = 20) -> DataFrame:
    """Q3: customers in their first months, shortest tenure then highest MRR.

    ``customer_id`` is added as the last sort key so ties at the limit are cut
    deterministically.
    """
    return (subs.where(F.col("subscription_months") <= max_months)
            .select("customer_id", "plan_type", "subscription_months",
                    money_double("monthly_mrr").alias("monthly_mrr"), "churned")
            .orderBy(F.asc("subscription_months"), F.desc_nulls_first("monthly_mrr"), F.asc("customer_id"))
            .limit(limit))


def lifecycle_stage_rows(subs: DataFrame) -> DataFrame:
    """Q4: every customer with its lifecycle stage, ordered by tenure.

    The sort adds ``customer_id`` after the tenure: tenure has few distinct values,
    and a range-partitioned sort on it alone would put a hot tenure value into a
    single task.
    """
    return (subs.select("customer_id", "subscription_months",
                        money_double("monthly_mrr").alias("monthly_mrr"), "churned",
                        lifecycle_stage("subscription_months", "closed").alias("lifecycle_stage"))
            .orderBy("subscription_months", "customer_id"))


def churn_by_lifecycle(subs: DataFrame) -> DataFrame:
    """Q5 (flagship): customers, churned count and churn % (1 dp) per lifecycle stage."""
    return (subs.groupBy(lifecycle_stage("subscription_months", "closed").alias("lifecycle_stage"))
            .agg(F.count(F.lit(1)).alias("customers"),
                 F.expr("count_if(churned = 'Yes')").alias("churned_count"))
            .withColumn("churn_rate_pct", F.expr(round_ratio_sql("churned_count * 100", "customers", 1)))
            .transform(order_aggregated, F.desc("churn_rate_pct")))


def ltv_by_lifecycle_vs_overall(subs: DataFrame) -> DataFrame:
    """Q6: average LTV per stage against the overall average; the delta is
    rounded after the subtraction. Everything is rounded exactly from integer
    cents: the delta S/n - T/m is the ratio (S*m - T*n) / (n*m). The overall sum T and
    count m are totals of the stages' rows (a window over at most three rows), so the source is read once."""
    staged = subs.where(F.col("lifetime_value").isNotNull())
    return (staged.groupBy(lifecycle_stage("subscription_months", "closed").alias("stage"))
            .agg(F.count(F.lit(1)).alias("customers"), F.expr(cents("sum(lifetime_value)")).alias("_s"))
            .selectExpr("stage", "customers", "_s", "sum(_s) OVER () AS _t", "sum(customers) OVER () AS _m")
            .select("stage", "customers",
                    F.expr(round_ratio_sql("_s", "customers * 100", 2)).alias("avg_ltv"),
                    F.expr(round_ratio_sql("_t", "_m * 100", 2)).alias("overall_avg_ltv"),
                    F.expr(round_ratio_sql("_s * _m - _t * customers", "customers * _m * 100", 2))
                    .alias("delta_vs_overall"))
            .transform(order_aggregated, F.desc("avg_ltv")))


def high_value_churned(subs: DataFrame, limit: int = 25) -> DataFrame:
    """Q7: churned customers paying above the overall average MRR. The average is
    compared exactly: mrr > S/n  <=>  mrr * n > S, with the sum S and count n of
    the overall MRR as scalar subqueries (decimal arithmetic, no rounded mean)."""
    total = subs.select(F.sum("monthly_mrr")).scalar()
    n = subs.select(F.count("monthly_mrr")).scalar()
    return (subs.where((F.col("churned") == YES) & (F.col("monthly_mrr") * n > total))
            .select("customer_id", "plan_type", "subscription_months",
                    money_double("monthly_mrr").alias("monthly_mrr"),
                    money_double("lifetime_value").alias("lifetime_value"))
            .orderBy(F.desc("monthly_mrr"), F.asc("customer_id"))
            .limit(limit))


def top_ranked(rows: DataFrame, by: str, value: str, top: int, out: str) -> DataFrame:
    """``rows`` whose RANK() by descending ``value`` within ``by`` is at most ``top``, with the rank as ``out``.

    No rows are sorted: a rank is one more than the number of rows with a higher value, so it follows
    from the counts per (group, value). Of these at most ``top`` values of a group can matter
    (each counts for one row or more), and their running counts are joined back to the rows. A value that
    millions of rows share is one count, and its rows stay in the tasks that read them."""
    first = Window.partitionBy(by).orderBy(F.desc_nulls_first(value))
    ranks = (rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
             .withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= top)
             .withColumn(out, (F.sum("_c").over(first.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c") + 1).cast("int"))
             .where(F.col(out) <= top).select(by, value, out))
    return null_safe_join(rows, ranks, [by, value])


def top_churned_by_plan(subs: DataFrame, top: int = 5) -> DataFrame:
    """Q8: rank of churned customers by MRR within each plan, rank <= top
    (ties can return more than ``top`` rows per plan; the id spreads them over the sort's tasks)."""
    churned = subs.where(F.col("churned") == YES).select("customer_id", "plan_type", "subscription_months", "monthly_mrr")
    return (top_ranked(churned, "plan_type", "monthly_mrr", top, "mrr_rank_within_plan")
            .select("customer_id", "plan_type", "subscription_months", money_double("monthly_mrr").alias("monthly_mrr"), "mrr_rank_within_plan")
            .orderBy(F.asc_nulls_last("plan_type"), "mrr_rank_within_plan", "customer_id"))


def ab_summary(expo: DataFrame) -> DataFrame:
    """Bonus: users (rows), conversions and conversion % (2 dp) per arm and page."""
    return (expo.groupBy(F.col("grp").alias("test_group"), "landing_page")
            .agg(F.count(F.lit(1)).alias("users"),
                 F.sum("converted").cast("long").alias("conversions"))
            .withColumn("conversion_rate_pct", F.expr(round_ratio_sql("conversions * 100", "users", 2)))
            .transform(order_aggregated, "test_group", "landing_page"))
