"""First row per user in the order of the source file, and ties without one."""

import datetime as dt

import pytest

from conftest import SF001
from retentio.operators import experiment as X
from retentio.plans.catalog import Catalog
from retentio.schemas import FILE_ORDER
from retentio.sources import csv_io

HEADER = "user_id,timestamp,group,landing_page,converted"


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def _arms(df):
    return {r.user_id: (r.grp, r.converted) for r in X.clean_exposures(df).collect()}


def test_equal_times_go_by_the_file_whichever_arm_stands_first(spark, tmp_dir):
    at = "2017-01-02 00:00:00.000000"
    _write(f"{tmp_dir}/ab.csv", [HEADER, f"1,{at},treatment,new_page,1", f"1,{at},control,old_page,0",
                                 f"2,{at},control,old_page,1", f"2,{at},treatment,new_page,0",
                                 "3,,treatment,new_page,1", "3,,control,old_page,0",
                                 # a later line with an earlier time is still the second
                                 f"4,{at},treatment,new_page,0", "4,2017-01-01 00:00:00.000000,control,old_page,1",
                                 # the first line of the user is misaligned
                                 f"5,{at},control,new_page,1", f"5,{at},treatment,new_page,0", f"5,{at},control,old_page,1"])
    df = csv_io.read_ab_csv(spark, f"{tmp_dir}/ab.csv", file_order=True)
    assert _arms(df) == {1: ("treatment", 1), 2: ("control", 1), 3: ("treatment", 1), 4: ("treatment", 0), 5: ("treatment", 0)}


def test_order_holds_over_many_splits_and_part_files(spark, tmp_dir):
    """The file is cut into splits of a few hundred bytes; every line of a user says where it stands."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    lines = [f"{i % 37},2017-01-02 00:00:00.000000,{('control', 'treatment')[i % 2]},{('old_page', 'new_page')[i % 2]},{i}" for i in range(3000)]
    for n, part in enumerate((lines[:1700], lines[1700:])):
        _write(f"{tmp_dir}/part-{99999 + n:05d}-x.csv", [HEADER, *part])      # by name, the second would come first
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = csv_io.read_ab_csv(spark, tmp_dir, file_order=True)
        assert df.rdd.getNumPartitions() > 50
        got = [r.converted for r in df.orderBy(FILE_ORDER).collect()]
        assert got == list(range(3000))
        assert {u: c for u, (_, c) in _arms(df).items()} == {u: u for u in range(37)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ties_without_a_file_favour_no_arm(spark):
    at = dt.datetime(2020, 1, 1)
    rows = [(u, when, g, p, 0) for u in range(400) for when in ([at] if u % 2 else [None])
            for g, p in (("control", "old_page"), ("treatment", "new_page"))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, grp string, landing_page string, converted int")
    arms = [g for g, _ in _arms(df).values()]
    assert 120 < arms.count("control") < 280
    assert _arms(df) == _arms(df.repartition(7))


@pytest.mark.parametrize("drop", [False, True])
def test_contaminated_users_by_one_shuffle(spark, drop):
    e = Catalog(spark, SF001).exposures()
    plan = X.contamination_check(e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user_id") == 1 and "Expand" not in plan and "SortAggregate" not in plan
    both = {r.user_id for r in e.groupBy("user_id").agg({"grp": "approx_count_distinct"}).where("`approx_count_distinct(grp)` > 1").collect()}
    got = {r.user_id for r in X.clean_exposures(e, drop_contaminated=drop).collect()}
    assert X.contamination_check(e).first().contaminated_users == len(both)
    assert bool(got & both) is (not drop and bool(both))
