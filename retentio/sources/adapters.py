"""Adapters that derive the two analytical fact tables from the test tables.

``subscriptions`` has one row per customer with the customer-table columns the
operators use; ``exposures`` has one row per experiment exposure. The derivation
rules are fixture definitions (see FIXTURES.md), not analytics.

Scale notes
-----------
* ``orders`` is scanned once with 4 columns; the per-customer facts (first/last
  finished order, finished-order value, last order of any status) come from ONE
  hash aggregate with conditional aggregates, so there is one partially
  aggregated shuffle of orders (a customer holding a third of all orders is
  combined map-side to one row per task).
* The customer join is on a unique key on both sides, so it cannot skew. Spark
  plans a shuffle join; AQE turns it into a broadcast only if the aggregated side
  proves small at run time.
* ``exposures`` is a narrow projection of ``events`` (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the fixture mapping
# ---------------------------------------------------------------------------
MONTH_TO_MONTH_SEGMENTS = ("BUILDING", "FURNITURE")
ONE_YEAR_SEGMENTS = ("HOUSEHOLD", "MACHINERY")
PAYMENT_METHODS = ("Bank transfer", "Credit card", "Electronic check", "Mailed check")
# Every so manieth id of the tables with gaps lacks a value or has one that no dimension lists.
GAP_EVERY = {"null_plan": 11, "other_plan": 13, "null_payment": 17, "null_status": 19, "long_tenure": 23,
             "null_arm": 29, "other_page": 31, "null_page": 37}
OTHER_PLAN, OTHER_PAGE, LONG_TENURE = "Weekly", "third_page", 1200
CHURN_CUTOFF = "2000-08-01 00:00:00"  # no order since -> churned
FINISHED = "F"


def subscriptions(customer: DataFrame, orders: DataFrame) -> DataFrame:
    c = customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    o = orders.select("o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")

    finished = F.col("o_orderstatus") == F.lit(FINISHED)
    per_customer = (
        o.groupBy("o_custkey")
        .agg(F.min(F.when(finished, F.col("o_orderdate"))).alias("first_f"),
             F.max(F.when(finished, F.col("o_orderdate"))).alias("last_f"),
             F.sum(F.when(finished, F.col("o_totalprice").cast("decimal(12,2)")))
             .cast("decimal(38,2)").alias("ltv"),
             F.max("o_orderdate").alias("last_any"))
    )

    months = lambda ts: F.year(ts) * 12 + F.month(ts)
    seg = F.col("c_mktsegment")
    pay_idx = F.col("c_nationkey") % 4
    pay = F.when(pay_idx == 0, PAYMENT_METHODS[0]).when(pay_idx == 1, PAYMENT_METHODS[1]) \
        .when(pay_idx == 2, PAYMENT_METHODS[2]).otherwise(PAYMENT_METHODS[3])
    cutoff = F.to_timestamp_ntz(F.lit(CHURN_CUTOFF))

    return (
        c.join(per_customer, c.c_custkey == per_customer.o_custkey, "left")
        .select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.when(seg.isin(*MONTH_TO_MONTH_SEGMENTS), "Month-to-month")
            .when(seg.isin(*ONE_YEAR_SEGMENTS), "One year")
            .otherwise("Two year").alias("plan_type"),
            pay.alias("payment_method"),
            F.coalesce(months(F.col("last_f")) - months(F.col("first_f")), F.lit(0))
            .cast("int").alias("subscription_months"),
            F.abs(F.col("c_acctbal")).cast("decimal(8,2)").alias("monthly_mrr"),
            F.col("ltv").alias("lifetime_value"),
            F.when(F.col("last_any").isNull() | (F.col("last_any") < cutoff), "Yes")
            .otherwise("No").alias("churned"),
        )
    )


def exposures(events: DataFrame) -> DataFrame:
    e = events.select("event_id", "ts", "user_id", "event_type")
    visitor = F.col("user_id") * 100 + (F.col("event_id") * 31) % 100
    to_control = (visitor % 2 == 0) != (F.col("event_id") % 83 == 0)
    old_page = to_control != (F.col("event_id") % 67 == 0)
    return e.select(
        visitor.alias("user_id"),
        F.col("ts"),
        F.col("event_id"),
        F.when(to_control, "control").otherwise("treatment").alias("grp"),
        F.when(old_page, "old_page").otherwise("new_page").alias("landing_page"),
        (F.col("event_type") == "purchase").cast("int").alias("converted"),
    )


def with_subscription_gaps(subs: DataFrame) -> DataFrame:
    """``subscriptions`` with null plans, payment methods and statuses, a plan that the dimension does not
    list and tenures above the last edge, by customer id."""
    every = lambda k: F.col("customer_id").cast("long") % GAP_EVERY[k] == 0
    return subs.withColumns({
        "plan_type": F.when(every("null_plan"), F.lit(None)).when(every("other_plan"), OTHER_PLAN).otherwise(F.col("plan_type")),
        "payment_method": F.when(~every("null_payment"), F.col("payment_method")),
        "churned": F.when(~every("null_status"), F.col("churned")),
        "subscription_months": F.when(every("long_tenure"), LONG_TENURE).otherwise(F.col("subscription_months")),
    })


def with_exposure_gaps(expo: DataFrame) -> DataFrame:
    """``exposures`` with null arms and pages and a third page, by event id."""
    every = lambda k: F.col("event_id") % GAP_EVERY[k] == 0
    return expo.withColumns({
        "grp": F.when(~every("null_arm"), F.col("grp")),
        "landing_page": F.when(every("null_page"), F.lit(None)).when(every("other_page"), OTHER_PAGE).otherwise(F.col("landing_page")),
    })


def with_services(subs: DataFrame) -> DataFrame:
    """``subscriptions`` with the service columns of the source file, by customer id and tenure; a few are null."""
    i = F.col("customer_id").cast("long")
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    return subs.withColumns({
        "internet_service": F.when(i % 5 == 0, "No").when(i % 3 == 0, "DSL").otherwise("Fiber optic"),
        "online_security": F.when(i % 53 != 0, yes(i % 4 == 1)),
        "tech_support": yes((i + F.col("subscription_months")) % 3 == 0),
        "paperless_billing": yes(i % 2 == 0),
        "senior_citizen": (i % 6 == 0).cast("int"),
        "partner": yes(F.col("subscription_months") % 7 > 3),
        "dependents": yes(i % 10 < 3),
    })
