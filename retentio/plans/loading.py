"""Load-side queries: the derived tables go out in the source files' CSV layout
to the shared folder and come back through the CSV load path, plus the load
checks. The written copy lives below ``spark.checkpoint.dir`` (a fresh folder
per call)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.expr import money_double
from retentio.operators import reports
from retentio.plans.catalog import Catalog
from retentio.schemas import AB_TEST_SCHEMA, CUSTOMER_CSV_HEADER
from retentio.session import scratch_path
from retentio.sources import checks, csv_io, sinks


def roundtrip_customers(cat: Catalog) -> DataFrame:
    """Customer table through the positional CSV reader (blank LTV -> null)."""
    path = scratch_path(cat.spark, "customers-csv")
    csv_io.write_customers_csv(cat.subscriptions(), path)
    df = csv_io.read_customers_csv(cat.spark, path, on_error="fail")
    return df.select("customer_id", "plan_type", "payment_method", "subscription_months",
                     money_double("monthly_mrr").alias("monthly_mrr"),
                     money_double("lifetime_value").alias("lifetime_value"), "churned")


def roundtrip_customers_renamed(cat: Catalog) -> DataFrame:
    """Customer table through the rename + snake_case reader with churn flag and stage."""
    path = scratch_path(cat.spark, "customers-csv")
    csv_io.write_customers_csv(cat.subscriptions(), path)
    df = csv_io.read_customers_renamed(cat.spark, path)
    return df.select("customer_id", "plan_type", "payment_method", "subscription_months", "monthly_mrr",
                     "lifetime_value", "churned", "churned_flag", "lifecycle_stage")


def roundtrip_exposures(cat: Catalog) -> DataFrame:
    """Experiment table through the positional CSV reader."""
    path = scratch_path(cat.spark, "ab-csv")
    csv_io.write_ab_csv(cat.exposures(), path)
    # The parsed timestamp is reported as microsecond text, so the comparison
    # with another engine does not depend on its datetime resolution.
    return (csv_io.read_ab_csv(cat.spark, path)
            .withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def pk_check(cat: Catalog) -> DataFrame:
    return checks.pk_check(cat.subscriptions(), "customer_id")


def duplicate_customer_ids(cat: Catalog) -> DataFrame:
    return checks.duplicate_keys(cat.subscriptions(), "customer_id")


def row_count_gate(cat: Catalog) -> DataFrame:
    """One derived row per source row is expected: the source row counts enter
    as scalar subqueries."""
    expected = {
        "subscriptions": cat.raw("customer").select(F.count(F.lit(1))).scalar(),
        "exposures": cat.raw("events").select(F.count(F.lit(1))).scalar(),
    }
    return checks.row_count_gate({"subscriptions": cat.subscriptions(), "exposures": cat.exposures()},
                                 expected)


def verify_customers(cat: Catalog) -> DataFrame:
    return checks.verify_customers(cat.subscriptions())


def verify_exposures(cat: Catalog) -> DataFrame:
    return checks.verify_exposures(cat.exposures())


def exposures_in_file_order(cat: Catalog) -> DataFrame:
    """The experiment table from a file whose lines stand in descending event order: the first line of a
    user is the latest event, whatever its time says."""
    path = scratch_path(cat.spark, "ab-csv-order")
    csv_io.write_ab_csv(cat.exposures().orderBy(F.desc("event_id")), path)
    return csv_io.read_ab_csv(cat.spark, path, file_order=True)


def fixed_schema_table(cat: Catalog) -> DataFrame:
    """The experiment table created by its fixed schema (twice: the second is no error), filled and read back by name."""
    name, path = f"ab_test_{uuid.uuid4().hex[:12]}", scratch_path(cat.spark, "ab-table")
    for _ in range(2):
        sinks.create_table_if_not_exists(cat.spark, name, AB_TEST_SCHEMA, path)
    cat.exposures().select(*AB_TEST_SCHEMA.names).write.insertInto(name)
    return checks.verify_exposures(cat.spark.table(name))


def result_preview(cat: Catalog) -> DataFrame:
    """The first rows of a written result, in its order, as the batch run shows them."""
    path = scratch_path(cat.spark, "preview")
    shown = reports.newest_customers(cat.subscriptions())
    _, rows = sinks.write_result_csv(shown, path, preview=5)
    return cat.spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)],
                                     T.StructType([T.StructField("position", T.IntegerType()), *shown.schema.fields]))


def damaged_customer_lines(subs: DataFrame) -> DataFrame:
    """``value``: the customer file's lines without header, some damaged by customer id: an extra field, one too
    few, a tenure or a lifetime value that is no number."""
    at = {c: i for i, c in enumerate(CUSTOMER_CSV_HEADER)}
    cells = [F.lit("")] * len(at)
    for name, c in (("customerID", "customer_id"), ("tenure", "subscription_months"), ("Contract", "plan_type"),
                    ("PaymentMethod", "payment_method"), ("MonthlyCharges", "monthly_mrr"), ("TotalCharges", "lifetime_value"), ("Churn", "churned")):
        cells[at[name]] = F.coalesce(F.col(c).cast("string"), F.lit(" "))
    every = lambda k: F.col("customer_id").cast("long") % k == 0
    cells[at["tenure"]] = F.when(every(47), "twelve").otherwise(cells[at["tenure"]])
    cells[at["TotalCharges"]] = F.when(every(43), "1.2.3").otherwise(cells[at["TotalCharges"]])
    line, short = F.concat_ws(",", *cells), F.concat_ws(",", *cells[:-1])
    return subs.select(F.when(every(59), F.concat(line, F.lit(",x"))).when(every(61), short).otherwise(line).alias("value"))


def load_rejects(cat: Catalog) -> DataFrame:
    """Damaged lines of the customer file that the load keeps out, with the reason."""
    path = scratch_path(cat.spark, "customers-damaged")
    damaged_customer_lines(cat.subscriptions()).write.text(path)
    return csv_io.rejected_customers(cat.spark, path, header=False).select("customer_id", "reject_reason")


def load_accepted(cat: Catalog) -> DataFrame:
    """Post-load verification of the sound lines of the same file."""
    path = scratch_path(cat.spark, "customers-damaged")
    damaged_customer_lines(cat.subscriptions()).write.text(path)
    return checks.verify_customers(csv_io.read_customers_csv(cat.spark, path, on_error="reject", header=False))


def file_line_gate(cat: Catalog) -> DataFrame:
    """The gate on written source files: as many rows as expected, nine lines off and ten lines off."""
    customers, ab = (scratch_path(cat.spark, n) for n in ("gate-customers", "gate-ab"))
    csv_io.write_customers_csv(cat.subscriptions(), customers)
    csv_io.write_ab_csv(cat.exposures(), ab)
    rows = cat.raw("customer").select(F.count(F.lit(1)))
    return checks.file_line_gate(cat.spark, {"customers": customers, "nine off": customers, "ten off": customers, "ab_test": ab},
                                 {"customers": rows.scalar(), "nine off": cat.raw("customer").select(F.count(F.lit(1)) - 8).scalar(),
                                  "ten off": cat.raw("customer").select(F.count(F.lit(1)) - 9).scalar(), "ab_test": None})


def load_once_readback(cat: Catalog) -> DataFrame:
    """The experiment table, loaded twice: one load writes, the other finds it there."""
    path = scratch_path(cat.spark, "load-once")
    wrote = sum(sinks.load_once(cat.exposures(), path, "exposures") for _ in range(2))
    return checks.verify_exposures(cat.spark.read.parquet(path)).withColumn("loads", F.lit(wrote))


def result_csv_readback(cat: Catalog) -> DataFrame:
    """A result that the CSV sink wrote, and how many rows the sink left of an empty one."""
    path = scratch_path(cat.spark, "results")
    sinks.write_result_csv(reports.customers_by_plan(cat.subscriptions()), f"{path}/customers_by_plan")
    wrote, _ = sinks.write_result_csv(checks.duplicate_keys(cat.subscriptions(), "customer_id"), f"{path}/duplicates")
    back = cat.spark.read.option("header", True).schema("plan_type string, customer_count long").csv(f"{path}/customers_by_plan")
    return back.withColumn("empty_written", F.lit(wrote or sinks.path_exists(cat.spark, f"{path}/duplicates")))


def report_tables_readback(cat: Catalog) -> DataFrame:
    """Rows of the workbook's written tables."""
    path = scratch_path(cat.spark, "workbook")
    names = sinks.write_report_tables(cat.subscriptions(), path)
    counts = [cat.spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
