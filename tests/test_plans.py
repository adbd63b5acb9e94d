"""Plan properties every registered query must keep (checked on the static
physical plan): no cartesian products, no Python evaluation, no RDD scans,
partial aggregation before every aggregate shuffle, and column pruning at the
scan."""

import re

import pytest

from conftest import SF01
from retentio.plans.catalog import Catalog
from retentio.plans.registry import REGISTRY

# the tree's splits and a preview come from the driver; everything else is a plan over the tables
NAMES = sorted(n for n in REGISTRY if n not in ("churn_drivers", "churn_tree", "top_churn_drivers", "result_preview"))


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    return Catalog(spark, SF01).load(str(tmp_path_factory.mktemp("loaded")))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan_hygiene(cat, name):
    text = _plan(REGISTRY[name](cat))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", text), "cross join"
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|InPandas", text), "python in plan"
    assert "ExistingRDD" not in text
    # every aggregation is hash-based (fixed-width buffers), with a map-side partial step; the first
    # row per user carries the row itself, for which Spark sorts locally
    if not name.removeprefix("gaps_").startswith(("ab_clean_summary", "ab_test_stats", "ab_report_rows")):
        assert "SortAggregate" not in text
    assert "ObjectHashAggregate" not in text


def test_adapter_scans_only_needed_columns(spark):
    text = _plan(REGISTRY["churn_by_lifecycle"](Catalog(spark, SF01)))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", text)
    assert "struct<c_custkey:bigint>" in schemas
    assert all("c_name" not in s and "o_orderpriority" not in s and "o_totalprice" not in s for s in schemas)


def test_partial_aggregation_before_shuffle(cat):
    text = _plan(REGISTRY["customers_by_plan"](cat))
    assert "partial_count" in text


def test_rank_uses_group_limit_before_shuffle(cat):
    text = _plan(REGISTRY["top_churned_by_plan"](cat))
    assert text.count("WindowGroupLimit") == 2


def test_scalar_subquery_not_join(cat):
    text = _plan(REGISTRY["high_value_churned"](cat))
    assert "Subquery" in text and "Join" not in text


def test_overall_average_reads_the_source_once(spark):
    text = _plan(REGISTRY["ltv_by_lifecycle_vs_overall"](Catalog(spark, SF01)))
    assert "Subquery" not in text and text.count("FileScan") == 2        # customer and orders, once each


@pytest.mark.parametrize("name", ["ltv_stats_by_plan", "numeric_describe", "ltv_histogram_by_plan", "ltv_histogram_dense"])
def test_profiles_read_the_source_once(spark, name):
    df = REGISTRY[name](Catalog(spark, SF01))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet", final)) == 2, final


def test_ranking_sorts_no_customer_rows(cat):
    text = _plan(REGISTRY["top_churned_by_plan"](cat))
    window = text[text.index("Window ["):]
    assert "partial_count" in window and "customer_id" not in window.split("Scan")[0]


def test_filter_pushed_to_scan(cat):
    text = _plan(REGISTRY["newest_customers"](cat))
    assert "PushedFilters: [IsNotNull(subscription_months), LessThanOrEqual(subscription_months,6)]" in text \
        or "LessThanOrEqual(subscription_months,6)" in text


def test_slicer_reaches_the_fact_scan(cat):
    text = _plan(REGISTRY["kpi_cards_sliced"](cat))
    assert "In(plan_type, [Month-to-month,Two year])" in text


def test_full_sort_splits_hot_sort_values(cat):
    # the tie key lets range partitioning split a tenure value held by many rows
    text = _plan(REGISTRY["lifecycle_stage_rows"](cat))
    assert re.search(r"rangepartitioning\(subscription_months#\d+ ASC NULLS FIRST, customer_id#\d+ ASC", text), text
