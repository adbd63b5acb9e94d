import numpy as np
import pytest

from retentio.operators.stats import exact_percentiles


def _frame(spark, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    # hot group with a third+ of the rows and many ties
    rows += [("hot", float(v)) for v in rng.integers(0, 50, 3000)]
    rows += [("wide", float(v)) for v in rng.normal(1000, 300, 1500).round(2)]
    rows += [("neg", float(v)) for v in rng.normal(-5, 10, 700).round(3)]
    rows += [("one", 42.0)]
    rows += [("two", 1.0), ("two", 4.0)]
    rows += [("const", 7.5)] * 10
    rows += [("nulls", None), ("nulls", 3.0)]
    return spark.createDataFrame(rows, "g string, v double"), rows


@pytest.mark.parametrize("method", ["exact", "builtin"])
def test_percentiles_equal_numpy_linear(spark, method):
    df, rows = _frame(spark)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r.g: r for r in exact_percentiles(df, "v", ["g"], probs, method=method).collect()}
    for g in {g for g, _ in rows}:
        vals = np.array([v for gg, v in rows if gg == g and v is not None])
        for p in probs:
            exp = float(np.quantile(vals, p))  # linear interpolation
            name = "p" + f"{p * 100:g}"
            assert getattr(got[g], name) == pytest.approx(exp, rel=1e-12, abs=1e-9), (g, p)


def test_global_percentiles(spark):
    df, rows = _frame(spark)
    r = exact_percentiles(df, "v", [], [0.5]).collect()[0]
    vals = np.array([v for _, v in rows if v is not None])
    assert r.p50 == pytest.approx(float(np.median(vals)))


def test_exact_plan_never_ranks_a_whole_group(spark):
    import re
    df, _ = _frame(spark)
    plan = exact_percentiles(df, "v", ["g"], [0.5])._jdf.queryExecution().executedPlan().toString()
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plan)
    value_windows = [w for w in specs if "_v#" in w]
    assert value_windows, plan
    # the window over values is partitioned by group, coarse bucket, target and fine bucket
    for w in value_windows:
        for col in ("g#", "_b#", "_pi#", "_side#", "_f#"):
            assert col in w, w
    assert "SortAggregate" not in plan


def test_values_concentrated_in_one_coarse_bucket(spark):
    # 6000 distinct values (plus duplicates) within 0.5 % of each other: one or two
    # coarse buckets, split by the fine level.
    rng = np.random.default_rng(11)
    vals = [1000.0 + i * 0.0008 for i in range(6000)] + [1002.0] * 500 + list(rng.uniform(1000, 1005, 300))
    df = spark.createDataFrame([("g", float(v)) for v in vals] + [("h", float(v)) for v in vals[::7]],
                               "g string, v double")
    probs = [0.01, 0.25, 0.5, 0.77, 0.99]
    got = {r.g: r for r in exact_percentiles(df, "v", ["g"], probs).collect()}
    for g, sub in (("g", vals), ("h", vals[::7])):
        for p in probs:
            name = "p" + f"{p * 100:g}"
            assert getattr(got[g], name) == pytest.approx(float(np.quantile(np.array(sub), p)), rel=1e-13)


def test_approx_method_within_rank_error(spark):
    df, rows = _frame(spark)
    got = {r.g: r for r in exact_percentiles(df, "v", ["g"], [0.5], method="approx", accuracy=10_000).collect()}
    for g in ("hot", "wide", "neg"):
        vals = np.sort(np.array([v for gg, v in rows if gg == g and v is not None]))
        # the approximate median's rank is within n / accuracy of the true median rank
        rank = np.searchsorted(vals, got[g].p50)
        assert abs(rank - len(vals) / 2) <= len(vals) / 10_000 + 2 or vals[len(vals) // 2] == got[g].p50


def test_exact_without_broadcast_hint_matches(spark):
    df, rows = _frame(spark)
    probs = [0.1, 0.5, 0.9]
    a = {r.g: r for r in exact_percentiles(df, "v", ["g"], probs, few_groups=False).collect()}
    b = {r.g: r for r in exact_percentiles(df, "v", ["g"], probs).collect()}
    assert a == b
