import os

from conftest import SF001, make_subs
from retentio.plans.catalog import Catalog
from retentio.plans.runner import run_all
from retentio.schemas import CUSTOMER_CSV_HEADER
from retentio.sources import checks, csv_io, sinks
from retentio.sources.literals import data_dictionary, plan_dimension


def _write_text(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def _customer_line(cid, tenure, mrr, total, churn, contract="Month-to-month"):
    vals = {h: "" for h in CUSTOMER_CSV_HEADER}
    vals.update({"customerID": cid, "gender": "Female", "SeniorCitizen": "0", "tenure": tenure,
                 "Contract": contract, "PaymentMethod": "Electronic check", "MonthlyCharges": mrr,
                 "TotalCharges": total, "Churn": churn, "StreamingTV": "Yes"})
    return ",".join(vals[h] for h in CUSTOMER_CSV_HEADER)


def test_customer_csv_positional_blank_and_bad_text(spark, tmp_dir):
    path = f"{tmp_dir}/customer_src/part.csv"
    _write_text(path, ["whatever,the,header,says"] + [
        _customer_line("A1", "0", "20.05", " ", "No"),
        _customer_line("A2", "12", "70.10", "841.20", "Yes"),
        _customer_line("A3", "3", "30.00", "abc", "No"),
    ])
    df = csv_io.read_customers_csv(spark, f"{tmp_dir}/customer_src")
    got = {r.customer_id: (r.subscription_months, r.monthly_mrr, r.lifetime_value, r.churned)
           for r in df.collect()}
    assert float(got["A2"][1]) == 70.10 and float(got["A2"][2]) == 841.20
    assert got["A1"][2] is None and got["A3"][2] is None and got["A1"][0] == 0
    assert df.schema["monthly_mrr"].dataType.simpleString() == "decimal(8,2)"
    nb = csv_io.read_customers_renamed(spark, f"{tmp_dir}/customer_src")
    assert "streaming_tv" in nb.columns and "payment_method" in nb.columns and "senior_citizen" in nb.columns
    r = {x.customer_id: x for x in nb.collect()}
    assert r["A2"].churned_flag == 1 and r["A1"].lifetime_value is None
    assert r["A1"].lifecycle_stage == "new (0-6mo)" and r["A2"].lifecycle_stage == "growing (7-24mo)"


def test_ab_csv_positional_and_null(spark, tmp_dir):
    path = f"{tmp_dir}/ab/part.csv"
    _write_text(path, ["user_id,timestamp,group,landing_page,converted",
                       "851104,2017-01-21 22:11:48.556739,control,old_page,0",
                       "804228,2017-01-12 08:01:45.159739,control,,0"])
    rows = csv_io.read_ab_csv(spark, f"{tmp_dir}/ab").orderBy("user_id").collect()
    assert rows[0].landing_page is None and rows[1].grp == "control"
    assert str(rows[1].ts) == "2017-01-21 22:11:48.556739"


def test_pk_check_reports_duplicates_and_nulls(spark):
    df = make_subs(spark, [("1", "One year", "x", 1, 1, 1, "No"), ("1", "One year", "x", 1, 1, 1, "No"),
                           ("2", "One year", "x", 1, 1, 1, "No"), (None, "One year", "x", 1, 1, 1, "No")])
    r = checks.pk_check(df, "customer_id").collect()[0]
    assert (r.rows, r.distinct_keys, r.duplicate_keys, r.null_keys, r.status) == (4, 2, 1, 1, "KEY VIOLATION")
    assert [(x.customer_id, x.n) for x in checks.duplicate_keys(df, "customer_id").collect()] == [("1", 2)]


def test_row_count_gate_tolerance(spark):
    t = {"a": spark.range(7043 - 1 + 9 - 1), "b": spark.range(7043 - 1 + 10 - 1), "c": spark.range(5)}
    # lines = rows + 1 (header): a is 8 lines off (OK), b is 9 off (OK); add one more row -> 10 off
    got = {r.table_name: (r.lines, r.status) for r in checks.row_count_gate(t, {"a": 7043, "b": 7043}).collect()}
    assert got["a"] == (7051, "OK") and got["b"] == (7052, "OK") and got["c"] == (6, "OK")
    got = {r.table_name: r.status for r in checks.row_count_gate({"b": spark.range(7052)}, {"b": 7043}).collect()}
    assert got == {"b": "UNEXPECTED COUNT"}


def test_csv_sink_skips_empty_and_load_once(spark, tmp_dir):
    assert sinks.write_result_csv(spark.range(0), f"{tmp_dir}/empty") == (False, [])
    assert not os.path.exists(f"{tmp_dir}/empty")
    wrote, rows = sinks.write_result_csv(spark.range(3), f"{tmp_dir}/three", preview=2)
    assert wrote is True and [r.id for r in rows] == [0, 1]
    assert spark.read.option("header", True).csv(f"{tmp_dir}/three").count() == 3
    assert sinks.load_once(spark.range(3), f"{tmp_dir}/t") is True
    assert sinks.load_once(spark.range(10), f"{tmp_dir}/t") is False  # skipped: data already there
    assert spark.read.parquet(f"{tmp_dir}/t").count() == 3


def test_report_tables_and_literals(spark, tmp_dir):
    subs = Catalog(spark, SF001).subscriptions()
    names = sinks.write_report_tables(subs, f"{tmp_dir}/report", (0, 200_000, 400_000, 600_000, 1_000_000,
                                                                   2_000_000, 3_000_000))
    assert spark.read.parquet(f"{tmp_dir}/report/kpis").count() == 6
    assert spark.read.parquet(f"{tmp_dir}/report/raw_data").count() == 150 and "kpis" in names
    assert [r.plan_label for r in plan_dimension(spark).orderBy("plan_order").collect()] == [
        "Starter", "Growth", "Enterprise"]
    dd = data_dictionary(spark).collect()
    assert len(dd) == 14 and [r.Type for r in dd] == sorted(r.Type for r in dd)


def test_create_table_if_not_exists(spark, tmp_dir):
    from retentio.schemas import AB_TEST_SCHEMA
    sinks.create_table_if_not_exists(spark, "ab_test_t", AB_TEST_SCHEMA, f"{tmp_dir}/ab_test_t")
    sinks.create_table_if_not_exists(spark, "ab_test_t", AB_TEST_SCHEMA, f"{tmp_dir}/ab_test_t")
    assert spark.table("ab_test_t").columns == ["user_id", "ts", "grp", "landing_page", "converted"]


def test_runner_isolates_errors(spark, tmp_dir, monkeypatch):
    from retentio.plans import registry
    monkeypatch.setitem(registry.REGISTRY, "broken", lambda c: c.subscriptions().select("no_such_column"))
    res = {r.name: r for r in run_all(spark, SF001, f"{tmp_dir}/out",
                                      ["customers_by_plan", "broken", "duplicate_customer_ids"])}
    assert res["customers_by_plan"].status == "written" and res["broken"].status == "error"
    assert res["duplicate_customer_ids"].status == "empty"


def test_file_line_gate_counts_header_line(spark, tmp_dir):
    _write_text(f"{tmp_dir}/f1.csv", ["h"] + [str(i) for i in range(100)])        # 101 lines
    _write_text(f"{tmp_dir}/f2.csv", ["h"] + [str(i) for i in range(89)])         # 90 lines
    got = {r.file_name: (r.lines, r.status) for r in checks.file_line_gate(
        spark, {"f1.csv": f"{tmp_dir}/f1.csv", "f2.csv": f"{tmp_dir}/f2.csv", "f3.csv": f"{tmp_dir}/f1.csv"},
        {"f1.csv": 100, "f2.csv": 100}).collect()}
    assert got == {"f1.csv": (101, "OK"), "f2.csv": (90, "UNEXPECTED COUNT"), "f3.csv": (101, "OK")}


def test_command_line_run_and_report(spark, tmp_dir, capsys):
    from retentio.__main__ import main
    assert main(["run", SF001, f"{tmp_dir}/out", "--only", "customers_by_plan,duplicate_customer_ids",
                 "--load", f"{tmp_dir}/loaded", "--show", "20"]) == 0
    out = capsys.readouterr().out
    assert "written" in out and "empty" in out and "plan_type  customer_count" in out
    assert spark.read.option("header", True).csv(f"{tmp_dir}/out/customers_by_plan").count() == 3
    assert main(["report", SF001, f"{tmp_dir}/report", "--ltv-edges",
                 "0,200000,400000,600000,1000000,2000000,3000000", "--load", f"{tmp_dir}/loaded"]) == 0
    assert spark.read.parquet(f"{tmp_dir}/report/ltv_distribution").count() == 6


def test_load_repairs_interrupted_write_and_keeps_completed_one(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/subscriptions")            # an interrupted write: no _SUCCESS marker
    with open(f"{tmp_dir}/subscriptions/part-junk.parquet", "w") as f:
        f.write("not parquet")
    cat = Catalog(spark, SF001).load(tmp_dir)
    assert cat.subscriptions().count() == 150
    assert not os.path.exists(f"{tmp_dir}/subscriptions/part-junk.parquet")
    stamp = os.path.getmtime(f"{tmp_dir}/subscriptions/_SUCCESS")
    Catalog(spark, SF001).load(tmp_dir)
    assert os.path.getmtime(f"{tmp_dir}/subscriptions/_SUCCESS") == stamp


def test_batch_run_of_every_registered_query(spark, tmp_dir):
    from retentio.plans.registry import REGISTRY
    cat = Catalog(spark, SF001).load(f"{tmp_dir}/loaded")
    results = {r.name: r for r in run_all(spark, SF001, f"{tmp_dir}/all", catalog=cat)}
    assert set(results) == set(REGISTRY)
    errors = {n: r.error for n, r in results.items() if r.status == "error"}
    assert errors == {}
    assert {n for n, r in results.items() if r.status == "empty"} == {"duplicate_customer_ids"}
