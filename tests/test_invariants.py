"""Invariants and observed fixture facts on the test data."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from retentio.operators import cohorts, dashboard, drivers, experiment, reports, workbook
from retentio.plans.catalog import Catalog
from retentio.plans.registry import FIXTURE_LTV_EDGES


@pytest.fixture(scope="module")
def subs01(spark):
    df = Catalog(spark, SF01).subscriptions().cache()
    yield df
    df.unpersist()


def test_fixture_facts_sf001(spark):
    s = Catalog(spark, SF001).subscriptions()
    assert s.count() == 150 and s.where("lifetime_value is not null").count() == 145
    got = {r.lifecycle_stage: (r.customers, r.churned_count) for r in reports.churn_by_lifecycle(s).collect()}
    assert got == {"new": (32, 12), "growing": (19, 5), "mature": (99, 15)}
    e = Catalog(spark, SF001).exposures()
    assert e.count() == 1000 and e.select("user_id").distinct().count() == 750
    assert experiment.misaligned_summary(e).collect()[0].misaligned_rows == 15
    assert experiment.contamination_check(e).collect()[0].contaminated_users == 5
    arms = {r.grp: (r.n, r.conversions) for r in experiment.clean_summary(e).collect()}
    assert arms == {"control": (370, 82), "treatment": (373, 65)}


def test_fixture_facts_sf01(spark, subs01):
    got = {r.lifecycle_stage: (r.customers, r.churned_count) for r in reports.churn_by_lifecycle(subs01).collect()}
    assert got == {"new": (304, 101), "growing": (183, 50), "mature": (1013, 171)}
    plans = {r.plan_type: r.customer_count for r in reports.customers_by_plan(subs01).collect()}
    assert plans == {"Month-to-month": 605, "One year": 597, "Two year": 298}
    assert subs01.where(F.col("subscription_months").isin(6, 24)).count() == 17
    bins = [r.customers for r in workbook.ltv_distribution(subs01, FIXTURE_LTV_EDGES).collect()]
    assert bins == [76, 187, 253, 420, 453, 39]


def test_group_sums_equal_global(subs01):
    total = subs01.count()
    assert sum(r.customers for r in reports.mrr_by_plan_all(subs01).collect()) == total
    by_stage = reports.churn_by_lifecycle(subs01).collect()
    assert sum(r.customers for r in by_stage) == total
    card = dashboard.kpi_cards(subs01).collect()[0]
    bars = dashboard.bars_mrr_by_label(subs01).collect()
    assert sum(r.total_mrr for r in bars) == pytest.approx(card.total_mrr)


def test_active_plus_churned_and_retention(subs01):
    bal = {r.churned: r.customers for r in cohorts.class_balance(subs01).collect()}
    assert bal["Yes"] + bal["No"] == subs01.count()
    for r in cohorts.cohort_retention_long(subs01).collect():
        assert r.churn_pct + r.retention_pct == pytest.approx(100.0)


def test_bins_plus_out_of_range_plus_nulls_equal_rows(subs01):
    counted = sum(r.customers for r in workbook.ltv_distribution(subs01, FIXTURE_LTV_EDGES).collect())
    nulls = subs01.where("lifetime_value is null").count()
    above = subs01.where(F.col("lifetime_value") > FIXTURE_LTV_EDGES[-1]).count()
    assert counted + nulls + above == subs01.count() and above == 1 and nulls == 71


def test_histogram_counts_all_non_null(subs01):
    hist = cohorts.ltv_histogram_by_plan(subs01).collect()
    assert sum(r.customers for r in hist) == subs01.where("lifetime_value is not null").count()
    assert all(1 <= r.bin <= 40 for r in hist)


def test_churn_drivers_importances(spark, subs01):
    rows = drivers.churn_drivers(subs01).collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4]
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    assert rows[0].importance >= rows[-1].importance


def test_more_fixture_facts(spark, subs01):
    s001 = Catalog(spark, SF001).subscriptions()
    assert [r.customers for r in workbook.ltv_distribution(s001, FIXTURE_LTV_EDGES).collect()] == [15, 20, 22, 38, 45, 5]
    assert s001.where("lifetime_value IS NULL").count() == 5
    for df, n in ((s001, 20), (subs01, 198)):
        assert df.where("churned = 'No' AND subscription_months < 6").count() == n
        assert df.agg(F.max("subscription_months")).collect()[0][0] == 78
    plans = {r.plan_type: (r.total, r.churned) for r in cohorts.churn_by_plan_banded(s001).collect()}
    assert plans == {"Month-to-month": (74, 14), "One year": (53, 12), "Two year": (23, 6)}
    plans = {r.plan_type: (r.total, r.churned) for r in cohorts.churn_by_plan_banded(subs01).collect()}
    assert plans == {"Month-to-month": (605, 134), "One year": (597, 124), "Two year": (298, 64)}
    e01 = Catalog(spark, SF01).exposures()
    assert e01.count() == 10000 and e01.select("user_id").distinct().count() == 7344
    assert experiment.misaligned_summary(e01).collect()[0].misaligned_rows == 150
    assert experiment.contamination_check(e01).collect()[0].contaminated_users == 61
