import pandas as pd
import pytest

from conftest import SF001
from retentio.operators import dashboard
from retentio.operators.measures import measure_query
from retentio.plans.catalog import Catalog
from retentio.sources.literals import with_plan_labels


@pytest.fixture(scope="module")
def facts(spark):
    return dashboard.report_facts(Catalog(spark, SF001).subscriptions())


@pytest.fixture(scope="module")
def pdf(facts):
    p = facts.toPandas()
    p["monthly_mrr"] = p["monthly_mrr"].astype(float)
    p["lifetime_value"] = p["lifetime_value"].astype(float)
    return p


def _brute(p, plan_label=None, churned=None):
    """Measures by definition on a pandas frame; the churned filter of the group is
    replaced by each measure's own churned condition (filter override)."""
    ctx = p if plan_label is None else p[p.plan_label == plan_label]
    grp = ctx if churned is None else ctx[ctx.churned == churned]
    active = ctx[ctx.churned == "No"]
    return {
        "total_mrr": active.monthly_mrr.sum(),
        "churn_rate": (grp.churned == "Yes").mean() or None,  # blank without churned rows
        "avg_ltv": grp.lifetime_value.mean(),
        "avg_tenure_months": active.subscription_months.mean(),
        "at_risk_mrr": active[active.subscription_months < 6].monthly_mrr.sum(),
        "ltv_mrr_ratio": grp.lifetime_value.mean() / grp.monthly_mrr.mean(),
    }


def test_override_by_status_matches_brute_force(spark, facts, pdf):
    got = measure_query(facts, list(_brute(pdf)), ("plan_label", "churned")).collect()
    assert len(got) == pdf.groupby(["plan_label", "churned"]).ngroups
    for r in got:
        exp = _brute(pdf, r.plan_label, r.churned)
        for k, v in exp.items():
            assert getattr(r, k) == (v if v is None else pytest.approx(v, rel=1e-9)), (r.plan_label, r.churned, k)


def test_cards_and_slicer(spark, facts, pdf):
    row = measure_query(facts, ["total_mrr", "churn_rate", "at_risk_mrr"]).collect()[0]
    exp = _brute(pdf)
    assert row.total_mrr == pytest.approx(exp["total_mrr"]) and row.churn_rate == pytest.approx(exp["churn_rate"])
    sliced = dashboard.kpi_cards(Catalog(spark, SF001).subscriptions(), ["Starter"]).collect()[0]
    exp = _brute(pdf, "Starter")
    assert sliced.total_mrr == pytest.approx(exp["total_mrr"])
    assert sliced.at_risk_mrr == pytest.approx(exp["at_risk_mrr"])


def test_slicer_on_overridden_column_is_ignored_by_override(spark, facts, pdf):
    # A slicer on churned = Yes: Total MRR (CALCULATE churned = "No") replaces it.
    row = measure_query(facts, ["total_mrr", "churn_rate"], (), {"churned": ["Yes"]}).collect()[0]
    assert row.total_mrr == pytest.approx(pdf[pdf.churned == "No"].monthly_mrr.sum())
    assert row.churn_rate == 1.0


def test_groups_without_rows_are_hidden(spark):
    df = with_plan_labels(spark.createDataFrame(
        [("1", "One year", "x", 3, 10.0, None, "No")],
        "customer_id string, plan_type string, payment_method string, subscription_months int, "
        "monthly_mrr double, lifetime_value double, churned string"))
    out = measure_query(df, ["churn_rate", "avg_ltv"], ("plan_label",)).collect()
    assert [(r.plan_label, r.churn_rate, r.avg_ltv) for r in out] == [("Growth", None, None)]


def test_blank_label_and_blank_churn_in_visuals(spark):
    cols = ("customer_id string, plan_type string, payment_method string, subscription_months int, "
            "monthly_mrr double, lifetime_value double, churned string")
    subs = spark.createDataFrame([("1", "One year", "x", 3, 10.0, 1.0, "No"), ("2", "Other", "x", 3, 7.0, 1.0, "No"),
                                  ("3", None, "x", 3, 5.0, 1.0, "Yes"), ("4", None, "x", 3, 4.0, 1.0, "No")], cols)
    bars = {r.plan_label: (r.plan_order_count, r.total_mrr) for r in dashboard.bars_mrr_by_label(subs).collect()}
    assert bars == {"Starter": (1, None), "Growth": (1, 10.0), "Enterprise": (1, None), None: (None, 11.0)}
    sliced = {r.plan_label: r.total_mrr for r in dashboard.bars_mrr_by_label(subs, ["Growth"]).collect()}
    assert sliced == {"Growth": 10.0}
    churn = {r.plan_label: (r.churn_rate, r.band) for r in dashboard.bars_churn_by(subs, "plan_label").collect()}
    assert churn == {"Growth": (None, None), None: (1 / 3, "high")}
    cell = dashboard.stage_plan_matrix(subs).collect()[0]
    assert (cell["Starter"], cell["Growth"], cell["Enterprise"], cell["(Blank)"]) == (None, None, None, 1 / 3)
    gauge = dashboard.churn_gauge(subs, ["Growth"]).collect()[0]
    assert (gauge.churn_rate, gauge.status) == (None, "ok")


def test_measure_query_plan_has_one_fact_scan(spark, facts):
    plan = measure_query(facts, ["total_mrr", "churn_rate"], ("plan_label", "churned")) \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2  # customer + orders, each once
    assert "ExistingRDD" not in plan and "BroadcastHashJoin" in plan
    assert pd is not None


def test_card_with_empty_slicer_is_one_blank_row(spark, facts):
    rows = measure_query(facts, ["total_mrr", "churn_rate", "avg_ltv"], (), {"plan_label": ["NoSuchPlan"]}).collect()
    assert len(rows) == 1 and rows[0].total_mrr is None and rows[0].churn_rate is None
    grouped = measure_query(facts, ["churn_rate"], ("plan_label",), {"plan_label": ["NoSuchPlan"]}).collect()
    assert grouped == []
