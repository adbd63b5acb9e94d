import datetime as dt
import math

import pytest

from conftest import SF001, SF01
from retentio.operators import experiment as X
from retentio.plans.catalog import Catalog

T0 = dt.datetime(2024, 1, 1)


def _expo(spark, rows):
    data = [(u, T0 + dt.timedelta(minutes=m), e, g, p, c) for u, m, e, g, p, c in rows]
    return spark.createDataFrame(data, "user_id long, ts timestamp_ntz, event_id long, grp string, "
                                       "landing_page string, converted int")


EDGE = [
    # user, minute, event, grp, page, converted
    (1, 5, 10, "control", "old_page", 0),
    (1, 1, 11, "control", "old_page", 1),      # earlier -> kept for user 1
    (2, 1, 12, "treatment", "new_page", 1),
    (2, 1, 9, "treatment", "new_page", 0),     # same ts, smaller event id -> kept
    (3, 0, 13, "control", "new_page", 1),      # misaligned first row, dropped
    (3, 2, 14, "control", "old_page", 0),      # first aligned row -> kept
    (4, 0, 15, "treatment", "new_page", 0),
    (4, 3, 16, "control", "old_page", 1),      # user in both arms (kept by default)
    (5, 0, 17, None, "old_page", 1),           # null arm: neither aligned nor misaligned
    (6, 0, 18, "treatment", None, 1),          # null page
]


def test_clean_keeps_first_aligned_row(spark):
    got = {r.user_id: (r.event_id, r.grp, r.converted) for r in X.clean_exposures(_expo(spark, EDGE)).collect()}
    assert got == {1: (11, "control", 1), 2: (9, "treatment", 0), 3: (14, "control", 0), 4: (15, "treatment", 0)}
    got = {r.user_id for r in X.clean_exposures(_expo(spark, EDGE), drop_contaminated=True).collect()}
    assert got == {1, 2, 3}


def test_checks_on_edge_rows(spark):
    e = _expo(spark, EDGE)
    assert X.contamination_check(e).collect()[0].contaminated_users == 1
    s = X.misaligned_summary(e).collect()[0]
    assert (s.misaligned_rows, s.total_rows) == (1, 10)
    aligned = e.where(X.aligned()).count()
    nulls = e.where("grp is null or landing_page is null").count()
    assert aligned + s.misaligned_rows + nulls == s.total_rows
    ct = {r.grp: (r.new_page, r.old_page) for r in X.alignment_crosstab(e).collect()}
    assert ct == {"control": (1, 4), "treatment": (3, 0)}


def test_split_check_status(spark):
    rows = [(i, 0, i, "control" if i < 50 else "treatment", "old_page", 0) for i in range(100)]
    got = {r.grp: r.status for r in X.split_check(_expo(spark, rows)).collect()}
    assert got == {"control": "OK", "treatment": "OK"}
    rows = [(i, 0, i, "control" if i < 52 else "treatment", "old_page", 0) for i in range(100)]
    got = {r.grp: r.status for r in X.split_check(_expo(spark, rows)).collect()}
    assert got["control"] == X.SPLIT_WARNING


def test_zero_row_arm_gives_nulls_not_errors(spark):
    rows = [(1, 0, 1, "control", "old_page", 1), (2, 0, 2, "control", "old_page", 0)]
    r = X.experiment_stats(_expo(spark, rows)).collect()[0]
    assert r.n_treat == 0 and r.p_treat is None and r.z_stat is None


def test_stats_match_published_formulas(spark):
    expo = Catalog(spark, SF01).exposures()
    r = X.experiment_stats(expo).collect()[0]
    # observed fixture facts (FIXTURES.md): cleaned arms and the z-test
    assert (r.n_ctrl, r.conv_ctrl, r.n_treat, r.conv_treat) == (3641, 719, 3626, 715)
    assert r.z_stat == pytest.approx(-0.030656, abs=1e-6)
    assert r.p_value == pytest.approx(0.9755, abs=1e-4)
    pc, pt = 719 / 3641, 715 / 3626
    pool = (719 + 715) / (3641 + 3626)
    z = (pt - pc) / math.sqrt(pool * (1 - pool) * (1 / 3641 + 1 / 3626))
    assert r.z_stat == pytest.approx(z, abs=1e-6)
    assert r.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-4)
    za, zb = 1.959963984540054, 0.8416212335729143
    assert r.n_required == math.ceil(2 * (za + zb) ** 2 * pc * (1 - pc) / 0.02 ** 2)
    h = 2 * math.asin(math.sqrt(pt)) - 2 * math.asin(math.sqrt(pc))
    assert r.cohen_h == pytest.approx(h, abs=1e-6) and r.effect_size == "negligible"
    se = math.sqrt(pc * (1 - pc) / 3641 + pt * (1 - pt) / 3626)
    assert r.ci_diff_low == pytest.approx((pt - pc) - 1.959963984540054 * se, abs=1e-6)
    assert r.delta_mrr_month == pytest.approx((10000 * pt - 10000 * pc) * 65.0, abs=1e-6)
    assert r.verdict == "DO NOT ROLL OUT" and r.significant is False


def test_pvalue_cross_check_with_chi_square(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    from pyspark.sql import functions as F
    cleaned = X.clean_exposures(Catalog(spark, SF01).exposures())
    data = VectorAssembler(inputCols=["arm"], outputCol="features").transform(
        cleaned.select((F.col("grp") == "treatment").cast("double").alias("arm"),
                       F.col("converted").cast("double").alias("label")))
    p_chi = ChiSquareTest.test(data, "features", "label").collect()[0].pValues[0]
    p_z = X.experiment_stats(Catalog(spark, SF01).exposures()).collect()[0].p_value
    assert p_z == pytest.approx(p_chi, abs=1e-4)


def test_report_rows(spark):
    rows = X.report_rows(Catalog(spark, SF001).exposures()).collect()
    assert [r.label for r in rows] == ["Experiment", "Control rate", "Treatment rate", "Difference", "P-value",
                                       "Statistical sig.", "Effect size", "MRR impact", "VERDICT"]
    assert rows[1].value.endswith("users)") and "%" in rows[1].value
    assert rows[8].value in (X.ROLL_OUT, X.DO_NOT_ROLL_OUT)


def test_hot_user_first_row_matches_brute_force(spark):
    import random

    import pandas as pd
    rnd = random.Random(3)
    rows = []
    for e in range(3000):
        user = 7 if e % 3 == 0 else rnd.randrange(1, 400)          # user 7 holds a third of all rows
        grp = rnd.choice(["control", "treatment"])
        page = {"control": "old_page", "treatment": "new_page"}[grp] if rnd.random() > 0.05 else \
            {"control": "new_page", "treatment": "old_page"}[grp]
        rows.append((user, rnd.randrange(0, 500), e, grp, page, rnd.randrange(0, 2)))
    e = _expo(spark, rows)
    got = {r.user_id: (r.event_id, r.grp, r.converted) for r in X.clean_exposures(e).collect()}
    pdf = pd.DataFrame(rows, columns=["user_id", "m", "event_id", "grp", "landing_page", "converted"])
    ok = ((pdf.grp == "control") & (pdf.landing_page == "old_page")) | \
         ((pdf.grp == "treatment") & (pdf.landing_page == "new_page"))
    first = pdf[ok].sort_values(["user_id", "m", "event_id"]).groupby("user_id").head(1)
    assert got == {r.user_id: (r.event_id, r.grp, r.converted) for r in first.itertuples()}
    plan = X.clean_exposures(e)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan


def test_no_conversions_gives_null_test_not_error(spark):
    rows = [(1, 0, 1, "control", "old_page", 0), (2, 0, 2, "treatment", "new_page", 0)]
    r = X.experiment_stats(_expo(spark, rows)).collect()[0]
    assert r.z_stat is None and r.p_value is None and r.relative_change_pct is None
    assert r.significant is None and r.verdict == X.ROLL_OUT      # a NaN p-value is not >= alpha
    assert len(X.report_rows(_expo(spark, rows)).collect()) == 9


def test_first_row_key_before_1970_and_negative_ids(spark):
    old = dt.datetime(1960, 5, 1, 12, 0, 0, 123456)
    rows = [(9, old + dt.timedelta(seconds=5), -7, "treatment", "new_page", 1),
            (9, old, -2, "treatment", "new_page", 0),
            (9, old, -3, "treatment", "new_page", 1),           # same ts, smaller id -> first
            (8, old, 2 ** 62, "control", "old_page", 1)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, grp string, "
                                     "landing_page string, converted int")
    got = {r.user_id: (r.ts, r.event_id, r.grp, r.landing_page, r.converted)
           for r in X.clean_exposures(df).collect()}
    assert got == {9: (old, -3, "treatment", "new_page", 1), 8: (old, 2 ** 62, "control", "old_page", 1)}


def test_clean_keeps_each_first_row_as_it_is(spark):
    """Null and very late timestamps, null event ids: the arm and the outcome are the row's own."""
    from datetime import datetime
    late = datetime(9999, 12, 31, 23, 59, 59)
    rows = [("u1", None, 5, "treatment", "new_page", 1), ("u2", late, None, "treatment", "new_page", 1),
            ("u3", late, 9, "treatment", "new_page", 0), ("u3", datetime(2020, 1, 1), None, "control", "old_page", 1)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp_ntz, event_id long, grp string, landing_page string, converted int")
    got = {r.user_id: (r.grp, r.landing_page, r.converted) for r in X.clean_exposures(df).collect()}
    assert got == {"u1": ("treatment", "new_page", 1), "u2": ("treatment", "new_page", 1), "u3": ("control", "old_page", 1)}
    # the source's own table has no event id
    assert {r.user_id: (r.grp, r.landing_page, r.converted) for r in X.clean_exposures(df.drop("event_id")).collect()} == got


def test_report_on_the_source_table_without_event_id(spark):
    df = spark.createDataFrame([(f"u{i}", None, ("treatment", "control")[i % 2], ("new_page", "old_page")[i % 2], i % 3 % 2) for i in range(60)],
                               "user_id string, ts timestamp_ntz, grp string, landing_page string, converted int")
    assert len(X.report_rows(df).collect()) == 9
