from conftest import make_subs

from retentio.operators import reports, workbook


def _rows(spark):
    # customer, plan, payment, months, mrr, ltv, churned
    return make_subs(spark, [
        ("a", "Month-to-month", "Credit card", 0, 100, None, "Yes"),
        ("b", "Month-to-month", "Credit card", 6, 90, 500, "Yes"),
        ("c", "Month-to-month", "Credit card", 7, 90, 500.01, "Yes"),
        ("d", "Month-to-month", "Credit card", 24, 90, 10000, "Yes"),
        ("e", "Month-to-month", "Credit card", 25, 90, 10000.01, "Yes"),
        ("f", "Month-to-month", "Credit card", 2, 80, 0, "Yes"),
        ("g", "Month-to-month", "Credit card", 3, 70, 20, "No"),
        ("h", "One year", "Bank transfer", 30, 10, 300, "No"),
        ("i", "Unknown plan", "Mailed check", 40, 5, 100, "Yes"),
    ])


def test_rank_keeps_ties_beyond_five(spark):
    out = reports.top_churned_by_plan(_rows(spark)).collect()
    mtm = [(r.customer_id, r.mrr_rank_within_plan) for r in out if r.plan_type == "Month-to-month"]
    # 100 -> rank 1, four ties at 90 -> rank 2, 80 -> rank 6 (dropped)
    assert mtm == [("a", 1), ("b", 2), ("c", 2), ("d", 2), ("e", 2)] or sorted(mtm) == [
        ("a", 1), ("b", 2), ("c", 2), ("d", 2), ("e", 2)]


def test_limit_ties_cut_by_customer_id(spark):
    out = reports.newest_customers(_rows(spark), limit=3).collect()
    assert [r.customer_id for r in out] == ["a", "f", "g"]
    out = reports.high_value_churned(_rows(spark), limit=2).collect()
    # above-average MRR (avg = 625/9 = 69.44), churned; ties at 90 cut by id
    assert [r.customer_id for r in out] == ["a", "b"]


def test_churn_by_lifecycle_closed_bounds(spark):
    got = {r.lifecycle_stage: (r.customers, r.churned_count, r.churn_rate_pct)
           for r in reports.churn_by_lifecycle(_rows(spark)).collect()}
    assert got == {"new": (4, 3, 75.0), "growing": (2, 2, 100.0), "mature": (3, 2, 66.7)}


def test_ltv_vs_overall_skips_null_ltv(spark):
    got = {r.stage: r for r in reports.ltv_by_lifecycle_vs_overall(_rows(spark)).collect()}
    overall = (500 + 500.01 + 10000 + 10000.01 + 0 + 20 + 300 + 100) / 8
    assert got["new"].customers == 3 and abs(got["new"].overall_avg_ltv - round(overall, 2)) < 1e-9
    assert abs(got["growing"].avg_ltv - 5250.01) < 1e-9


def test_unknown_plan_keeps_null_label(spark):
    out = {r.plan_order: r for r in workbook.churn_by_plan_label(_rows(spark)).collect()}
    assert None in out and out[None].plan_label is None and out[None].churn_rate == 1.0


def test_ltv_distribution_dense_and_out_of_range(spark):
    out = [(r.ltv_range, r.customers) for r in workbook.ltv_distribution(_rows(spark)).collect()]
    # 0, 20, 100, 300, 500 -> $0-500; 500.01 -> $500-1K; 10000 -> $5K+; 10000.01 dropped; null dropped
    assert out == [("$0-500", 5), ("$500-1K", 1), ("$1K-2K", 0), ("$2K-3K", 0), ("$3K-5K", 0), ("$5K+", 1)]


def test_histogram_zero_width_plan_uses_numpy_range(spark):
    import numpy as np

    from retentio.operators import cohorts
    rows = [(f"c{i}", "One year", "x", 3, 10, 250, "No") for i in range(5)] + \
           [(f"d{i}", "Two year", "x", 3, 10, v, "No") for i, v in enumerate([0, 10, 25, 40, 40, 100])]
    hist = {(r.plan_type, r.bin): r.customers for r in cohorts.ltv_histogram_by_plan(make_subs(spark, rows)).collect()}
    # all values equal: numpy uses (v - 0.5, v + 0.5), the value falls into the middle bin (21 of 40)
    counts, _ = np.histogram([250.0] * 5, bins=40)
    assert hist[("One year", int(np.argmax(counts)) + 1)] == 5 and int(np.argmax(counts)) + 1 == 21
    counts, _ = np.histogram([0, 10, 25, 40, 40, 100], bins=40)
    assert {b: c for (p, b), c in hist.items() if p == "Two year"} == {
        i + 1: int(c) for i, c in enumerate(counts) if c}


def test_reports_come_back_in_their_order(spark):
    from conftest import SF01
    from retentio.plans.registry import queries
    q = queries()

    def rows(name):
        return q[name](spark, SF01).collect()

    counts = [r.customer_count for r in rows("customers_by_plan")]
    assert counts == sorted(counts, reverse=True)
    rates = [r.churn_rate_pct for r in rows("churn_by_lifecycle")]
    assert rates == sorted(rates, reverse=True)
    keys = [(r.test_group, r.landing_page) for r in rows("ab_summary")]
    assert keys == sorted(keys)
    ranked = [(r.plan_type, r.mrr_rank_within_plan) for r in rows("top_churned_by_plan")]
    assert ranked == sorted(ranked)
    months = [r.subscription_months for r in rows("lifecycle_stage_rows")]
    assert months == sorted(months)
    order = [r.plan_order for r in rows("active_mrr_by_plan_label")]
    assert order == sorted(order)
    buckets = [r.bucket_order for r in rows("cohort_churn_matrix")]
    assert buckets == sorted(buckets)
    newest = [(r.subscription_months, -r.monthly_mrr, r.customer_id) for r in rows("newest_customers")]
    assert newest == sorted(newest)


def test_rank_of_a_plan_where_all_pay_the_same(spark):
    """The rows of a hot price are not gathered: they meet the few ranks by a broadcast, and the sort goes on to the id."""
    from pyspark.sql import functions as F
    subs = spark.range(30_000).select(
        F.col("id").cast("string").alias("customer_id"), F.when(F.col("id") % 3 > 0, "One year").when(F.col("id") % 2 == 0, "Two year").alias("plan_type"),
        F.lit(3).alias("subscription_months"), F.when(F.col("id") % 3 > 0, 9).otherwise(F.col("id") % 7).cast("decimal(8,2)").alias("monthly_mrr"),
        F.lit("Yes").alias("churned"))
    out = reports.top_churned_by_plan(subs)
    got = {(r.plan_type, r.monthly_mrr, r.mrr_rank_within_plan): r.n for r in out.groupBy("plan_type", "monthly_mrr", "mrr_rank_within_plan").agg(F.count("*").alias("n")).collect()}
    top = [sum(1 for i in range(0, 30_000, 3) if i % 7 == 6 and (i % 2 == 0) is even) for even in (True, False)]
    assert got == {("One year", 9.0, 1): 20_000, ("Two year", 6.0, 1): top[0], (None, 6.0, 1): top[1]}
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final
    assert "customer_id#" in final[final.index("rangepartitioning("):].split(")")[0]
