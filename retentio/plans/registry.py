"""Query registry: name -> operator over a :class:`Catalog`.

``queries()`` adapts every entry to the ``(spark, sf_dir) -> DataFrame`` contract.
Entries are ordered like the reference's own report sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retentio.operators import cohorts, dashboard, drivers, experiment, quality, reports, workbook
from retentio.plans import loading
from retentio.plans.catalog import Catalog

CatalogQuery = Callable[[Catalog], DataFrame]

# Parameters of the registered queries on the test data.
# The test data's money scale differs from the original, so the LTV bin edges
# are a parameter (FIXTURES.md); the slicer selection is an example selection.
FIXTURE_LTV_EDGES = (0, 200_000, 400_000, 600_000, 1_000_000, 2_000_000, 3_000_000)
SLICER_EXAMPLE = ("Starter", "Enterprise")

REGISTRY: dict[str, CatalogQuery] = {
    # query file
    "customers_by_plan": lambda c: reports.customers_by_plan(c.subscriptions()),
    "mrr_by_plan_all": lambda c: reports.mrr_by_plan_all(c.subscriptions()),
    "newest_customers": lambda c: reports.newest_customers(c.subscriptions()),
    "lifecycle_stage_rows": lambda c: reports.lifecycle_stage_rows(c.subscriptions()),
    "churn_by_lifecycle": lambda c: reports.churn_by_lifecycle(c.subscriptions()),
    "ltv_by_lifecycle_vs_overall": lambda c: reports.ltv_by_lifecycle_vs_overall(c.subscriptions()),
    "high_value_churned": lambda c: reports.high_value_churned(c.subscriptions()),
    "top_churned_by_plan": lambda c: reports.top_churned_by_plan(c.subscriptions()),
    "ab_summary": lambda c: reports.ab_summary(c.exposures()),
    # report visuals (measure catalogue)
    "kpi_cards": lambda c: dashboard.kpi_cards(c.subscriptions()),
    "kpi_cards_sliced": lambda c: dashboard.kpi_cards(c.subscriptions(), SLICER_EXAMPLE),
    "kpi_cards_display": lambda c: dashboard.kpi_cards_display(c.subscriptions()),
    "implicit_sums_by_label": lambda c: dashboard.implicit_sums_by_label(c.subscriptions()),
    "measure_override_by_status": lambda c: dashboard.measure_override_by_status(c.subscriptions()),
    "bars_mrr_by_label": lambda c: dashboard.bars_mrr_by_label(c.subscriptions()),
    "bars_churn_by_stage_bi": lambda c: dashboard.bars_churn_by(c.subscriptions(), "lifecycle_stage"),
    "bars_churn_by_label_bi": lambda c: dashboard.bars_churn_by(c.subscriptions(), "plan_label"),
    "bars_churn_by_payment_bi": lambda c: dashboard.bars_churn_by(c.subscriptions(), "payment_method"),
    "stage_plan_matrix": lambda c: dashboard.stage_plan_matrix(c.subscriptions()),
    "tenure_mrr_scatter": lambda c: dashboard.tenure_mrr_scatter(c.subscriptions()),
    "churn_gauge": lambda c: dashboard.churn_gauge(c.subscriptions()),
    "churn_gauge_sliced": lambda c: dashboard.churn_gauge(c.subscriptions(), SLICER_EXAMPLE),
    "bars_mrr_sliced": lambda c: dashboard.bars_mrr_by_label(c.subscriptions(), SLICER_EXAMPLE),
    # workbook tables
    "workbook_raw_data": lambda c: workbook.raw_data(c.subscriptions()),
    "kpi_block": lambda c: workbook.kpi_block(c.subscriptions()),
    "active_mrr_by_plan_label": lambda c: workbook.active_mrr_by_plan_label(c.subscriptions()),
    "churn_by_plan_label": lambda c: workbook.churn_by_plan_label(c.subscriptions()),
    "ltv_distribution": lambda c: workbook.ltv_distribution(c.subscriptions(), FIXTURE_LTV_EDGES),
    "plan_dimension_usage": lambda c: workbook.plan_dimension_usage(c.subscriptions()),
    # KPI notebook
    "mrr_by_plan_nb": lambda c: cohorts.mrr_by_plan_nb(c.subscriptions()),
    "churn_by_plan_banded": lambda c: cohorts.churn_by_plan_banded(c.subscriptions()),
    "churn_by_payment_banded": lambda c: cohorts.churn_by_payment_banded(c.subscriptions()),
    "churn_by_lifecycle_nb": lambda c: cohorts.churn_by_lifecycle_nb(c.subscriptions()),
    "cohort_retention_long": lambda c: cohorts.cohort_retention_long(c.subscriptions()),
    "cohort_churn_matrix": lambda c: cohorts.cohort_churn_matrix(c.subscriptions()),
    "cohort_retention_matrix": lambda c: cohorts.cohort_retention_matrix(c.subscriptions()),
    "ltv_stats_by_plan": lambda c: cohorts.ltv_stats_by_plan(c.subscriptions()),
    "ltv_histogram_by_plan": lambda c: cohorts.ltv_histogram_by_plan(c.subscriptions()),
    "ltv_histogram_dense": lambda c: cohorts.ltv_histogram_by_plan(c.subscriptions(), dense=True),
    "class_balance": lambda c: cohorts.class_balance(c.subscriptions()),
    "numeric_describe": lambda c: quality.numeric_describe(c.subscriptions()),
    "missing_counts": lambda c: quality.missing_counts(c.subscriptions()),
    "arm_values": lambda c: quality.distinct_values(c.exposures(), ("grp", "landing_page", "converted")),
    "date_range": lambda c: quality.date_range(c.exposures()),
    # experiment notebook
    "ab_group_rates": lambda c: experiment.group_rates(c.exposures()),
    "split_check": lambda c: experiment.split_check(c.exposures()),
    "contamination_check": lambda c: experiment.contamination_check(c.exposures()),
    "alignment_crosstab": lambda c: experiment.alignment_crosstab(c.exposures()),
    "misaligned_summary": lambda c: experiment.misaligned_summary(c.exposures()),
    "misaligned_breakdown": lambda c: experiment.misaligned_breakdown(c.exposures()),
    "ab_clean_counts": lambda c: experiment.clean_counts(c.exposures()),
    "ab_clean_summary": lambda c: experiment.clean_summary(c.exposures()),
    "ab_test_stats": lambda c: experiment.experiment_stats(c.exposures()),
    "ab_report_rows": lambda c: experiment.report_rows(c.exposures()),
    # the same operators on tables with null and unlisted values
    "gaps_mrr_by_plan_nb": lambda c: cohorts.mrr_by_plan_nb(c.subscriptions_with_gaps()),
    "gaps_churn_by_plan_banded": lambda c: cohorts.churn_by_plan_banded(c.subscriptions_with_gaps()),
    "gaps_churn_by_payment_banded": lambda c: cohorts.churn_by_payment_banded(c.subscriptions_with_gaps()),
    "gaps_class_balance": lambda c: cohorts.class_balance(c.subscriptions_with_gaps()),
    "gaps_cohort_retention_long": lambda c: cohorts.cohort_retention_long(c.subscriptions_with_gaps()),
    "gaps_cohort_churn_matrix": lambda c: cohorts.cohort_churn_matrix(c.subscriptions_with_gaps()),
    "gaps_ltv_stats_by_plan": lambda c: cohorts.ltv_stats_by_plan(c.subscriptions_with_gaps(), null_plan=True),
    "gaps_top_churned_by_plan": lambda c: reports.top_churned_by_plan(c.subscriptions_with_gaps()),
    "gaps_plan_dimension_usage": lambda c: workbook.plan_dimension_usage(c.subscriptions_with_gaps()),
    "gaps_ab_group_rates": lambda c: experiment.group_rates(c.exposures_with_gaps()),
    "gaps_split_check": lambda c: experiment.split_check(c.exposures_with_gaps()),
    "gaps_alignment_crosstab": lambda c: experiment.alignment_crosstab(c.exposures_with_gaps()),
    "gaps_contamination_check": lambda c: experiment.contamination_check(c.exposures_with_gaps()),
    "gaps_ab_clean_summary": lambda c: experiment.clean_summary(c.exposures_with_gaps()),
    # load path and load checks
    "load_roundtrip_customers": loading.roundtrip_customers,
    "load_roundtrip_customers_renamed": loading.roundtrip_customers_renamed,
    "load_roundtrip_exposures": loading.roundtrip_exposures,
    "pk_check": loading.pk_check,
    "duplicate_customer_ids": loading.duplicate_customer_ids,
    "row_count_gate": loading.row_count_gate,
    "load_verification_customers": loading.verify_customers,
    "load_verification_ab": loading.verify_exposures,
    "ab_clean_summary_file_order": lambda c: experiment.clean_summary(loading.exposures_in_file_order(c)),
    "ab_test_stats_file_order": lambda c: experiment.experiment_stats(loading.exposures_in_file_order(c)),
    "ab_report_rows_file_order": lambda c: experiment.report_rows(loading.exposures_in_file_order(c)),
    "fixed_schema_table": loading.fixed_schema_table,
    "result_preview": loading.result_preview,
    "gaps_cohort_retention_matrix": lambda c: cohorts.cohort_retention_matrix(c.subscriptions_with_gaps()),
    "load_rejects_customers": loading.load_rejects,
    "load_accepted_customers": loading.load_accepted,
    "file_line_gate": loading.file_line_gate,
    "load_once_readback": loading.load_once_readback,
    "result_csv_readback": loading.result_csv_readback,
    "report_tables_readback": loading.report_tables_readback,
    # churn drivers
    "churn_drivers": lambda c: drivers.churn_drivers(c.subscriptions()),
    "churn_tree": lambda c: drivers.churn_tree(c.subscriptions()),
    "top_churn_drivers": lambda c: drivers.churn_drivers(c.source_customers(), top=5),
}

FLAGSHIP = "churn_by_lifecycle"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: CatalogQuery) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Catalog(spark, sf_dir))
    return {name: bind(fn) for name, fn in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from retentio.plans.oracle import ORACLE
    return {name: sql for name, sql in ORACLE.items() if name in REGISTRY}
