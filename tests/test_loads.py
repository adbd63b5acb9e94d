"""Damaged source lines, loads skipped by content, the line gate on files, and the CSV sink."""

import os

import pytest

from conftest import SF001
from retentio.plans.catalog import Catalog
from retentio.schemas import CUSTOMER_CSV_HEADER
from retentio.sources import checks, csv_io, sinks


def _line(cid, **given):
    vals = dict.fromkeys(CUSTOMER_CSV_HEADER, "") | {"customerID": cid, "SeniorCitizen": "0", "tenure": "3", "Contract": "One year",
                                                     "MonthlyCharges": "9.50", "TotalCharges": "28.50", "Churn": "No"} | given
    return ",".join(vals[h] for h in CUSTOMER_CSV_HEADER)


def _file(path, lines, end="\n"):
    with open(path, "w", newline="") as f:
        f.write("\n".join(lines) + end)
    return path


SOUND = [_line("A"), _line("B", TotalCharges="  "), _line("C", MonthlyCharges="", SeniorCitizen="")]
DAMAGED = {"D": _line("D", tenure="x"), "E": _line("E") + ",extra", "F": _line("F").rsplit(",", 1)[0],
           "G": _line("G", MonthlyCharges="1e", TotalCharges="?"), "H": _line("H", MonthlyCharges="12345678.00")}


def test_rejects_name_what_is_wrong(spark, tmp_dir):
    path = _file(f"{tmp_dir}/c.csv", ["header", *SOUND, *DAMAGED.values()])
    got = {r.customer_id: r for r in csv_io.rejected_customers(spark, path).collect()}
    assert {k: r.reject_reason for k, r in got.items()} == {
        "D": "bad subscription_months", "E": csv_io.REJECT_FIELDS, "F": csv_io.REJECT_FIELDS,
        "G": "bad monthly_mrr, bad lifetime_value", "H": "bad monthly_mrr"}
    assert got["E"].line == DAMAGED["E"] and got["F"].line == DAMAGED["F"]
    kept = {r.customer_id: r for r in csv_io.read_customers_csv(spark, path, on_error="reject").collect()}
    assert set(kept) == {"A", "B", "C"} and kept["B"].lifetime_value is None and kept["C"].monthly_mrr is None
    assert csv_io.read_customers_csv(spark, path, on_error="reject").groupBy("churned").count().collect()[0][1] == 3   # one column read
    assert {r.customer_id for r in csv_io.read_customers_csv(spark, path).collect()} == set("ABCDEFGH")


@pytest.mark.parametrize("which", sorted(DAMAGED))
def test_fail_mode_takes_a_file_whole_or_not(spark, tmp_dir, which):
    path = _file(f"{tmp_dir}/c.csv", ["header", *SOUND, DAMAGED[which]])
    with pytest.raises(Exception, match="damaged line"):
        csv_io.read_customers_csv(spark, path, on_error="fail").select("churned").collect()    # not even a damaged column
    with pytest.raises(Exception, match="damaged line"):
        csv_io.read_customers_csv(spark, path, on_error="fail").count()
    sound = _file(f"{tmp_dir}/sound.csv", ["header", *SOUND])
    assert csv_io.read_customers_csv(spark, sound, on_error="fail").count() == 3
    with pytest.raises(ValueError):
        csv_io.read_customers_csv(spark, sound, on_error="ignore")


def test_load_goes_by_content(spark, tmp_dir):
    _file(f"{tmp_dir}/a.csv", ["1", "2"])
    _file(f"{tmp_dir}/b.csv", ["3"])
    _file(f"{tmp_dir}/none.csv", [], end="")
    read = lambda n: spark.read.schema("x int").csv(f"{tmp_dir}/{n}.csv")
    table = f"{tmp_dir}/table"
    # an empty load is no load
    assert sinks.load_once(read("none"), table) is True
    assert sinks.read_manifest(spark, table).rows == 0
    assert sinks.load_once(read("a"), table) is True
    assert sinks.read_manifest(spark, table) == sinks.Manifest(sinks.source_of(read("a"))[0], 1, 2)
    assert sinks.load_once(read("a"), table) is False
    # another source is refused and changes nothing
    with pytest.raises(sinks.LoadConflict):
        sinks.load_once(read("b"), table)
    with pytest.raises(sinks.LoadConflict):
        sinks.load_once(read("a"), table, "other label")
    assert sorted(r.x for r in spark.read.parquet(table).collect()) == [1, 2]
    # so is a table that was not loaded here
    read("b").write.parquet(f"{tmp_dir}/foreign")
    with pytest.raises(sinks.LoadConflict):
        sinks.load_once(read("a"), f"{tmp_dir}/foreign")
    # a write that was cut off is made good
    os.remove(f"{table}/_manifest/_SUCCESS")
    os.remove(f"{table}/_SUCCESS")
    assert sinks.load_once(read("b"), table) is True
    assert [r.x for r in spark.read.parquet(table).collect()] == [3]


def test_catalog_refuses_tables_of_other_data(spark, tmp_dir):
    Catalog(spark, SF001).load(tmp_dir)
    with pytest.raises(sinks.LoadConflict):
        Catalog(spark, SF001.replace("0.001", "0.01")).load(tmp_dir)


def test_line_gate_counts_newline_bytes(spark, tmp_dir):
    rows = [f"{i},é" for i in range(100)]
    paths = {"whole": _file(f"{tmp_dir}/w.csv", ["h", *rows]), "no end": _file(f"{tmp_dir}/n.csv", ["h", *rows], end=""),
             "returns": _file(f"{tmp_dir}/r.csv", [x + "\r" for x in ["h", *rows]]), "blank": _file(f"{tmp_dir}/b.csv", ["", "", ""]),
             "empty": _file(f"{tmp_dir}/e.csv", [], end=""), "nine": f"{tmp_dir}/w.csv", "ten": f"{tmp_dir}/w.csv"}
    want = {n: open(p, "rb").read().count(b"\n") for n, p in paths.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {r.file_name: (r.lines, r.status) for r in checks.file_line_gate(
                spark, paths, {"whole": 100, "no end": 100, "nine": 92, "ten": 91}).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert {n: lines for n, (lines, _) in got.items()} == want and want["no end"] == 100 and want["whole"] == 101
        assert got["nine"][1] == "OK" and got["ten"][1] == "UNEXPECTED COUNT" and got["blank"][1] == "OK"


def test_line_gate_on_part_files_counts_one_header(spark, tmp_dir):
    spark.range(90).repartition(5).write.option("header", True).csv(f"{tmp_dir}/parts")
    assert checks.file_line_gate(spark, {"p": f"{tmp_dir}/parts"}, {"p": 90}).first().lines == 91


def test_result_sink_runs_the_query_once_and_keeps_old_results(spark, tmp_dir):
    ran = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    df = spark.range(50).repartition(3).mapInArrow(touch, "id long")
    wrote, rows = sinks.write_result_csv(df, f"{tmp_dir}/out", preview=5)
    assert wrote and len(rows) == 5 and ran.value == 50
    assert spark.read.option("header", True).csv(f"{tmp_dir}/out").count() == 50
    # an empty result leaves what was there, and no other folder
    assert sinks.write_result_csv(spark.range(50).where("id > 99"), f"{tmp_dir}/out") == (False, [])
    assert spark.read.option("header", True).csv(f"{tmp_dir}/out").count() == 50
    assert sinks.write_result_csv(spark.range(3), f"{tmp_dir}/out")[0] is True
    assert spark.read.option("header", True).csv(f"{tmp_dir}/out").count() == 3
    assert [n for n in os.listdir(tmp_dir) if "writing" in n] == []
    assert not spark.sparkContext._jsc.getPersistentRDDs()
