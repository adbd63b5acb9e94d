"""The drivers' tree against an exhaustive search in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import make_subs
from retentio.operators import drivers


def gini(ys):
    p = sum(ys) / len(ys)
    return 1.0 - p * p - (1.0 - p) * (1.0 - p)


def brute(rows, features, depth, node=1):
    """rows: dicts with features and 'y'. Every boundary of every feature is tried at every node."""
    ys = [r["y"] for r in rows]
    if depth == 0 or len(set(ys)) < 2:
        return []
    best = None
    for i, f in enumerate(features):
        for v in sorted({r[f] for r in rows})[:-1]:
            left, right = [r["y"] for r in rows if r[f] <= v], [r["y"] for r in rows if r[f] > v]
            gain = gini(ys) - len(left) / len(ys) * gini(left) - len(right) / len(ys) * gini(right)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, v, len(left))
    if best is None:
        return []
    gain, f, v, n = best
    return [(node, f, v, len(ys), n, round(gain, 9)), *brute([r for r in rows if r[f] <= v], features, depth - 1, 2 * node),
            *brute([r for r in rows if r[f] > v], features, depth - 1, 2 * node + 1)]


def frame(spark, rows):
    return spark.createDataFrame([(r["a"], r["b"], r["t"], r["y"]) for r in rows], "a double, b int, t string, label int")


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_exhaustive_search(spark, seed):
    rnd = random.Random(seed)
    rows = [{"a": rnd.choice([rnd.uniform(-5, 5), rnd.uniform(0, 1e6), float(rnd.randrange(4))]), "b": rnd.randrange(-3, 9),
             "t": rnd.choice(["é", "Yes", "No", "DSL", "日本", "Yesterday", ""])} for _ in range(250)]
    for r in rows:
        r["y"] = int(rnd.random() < (0.8 if r["a"] > 3.3 and r["t"] > "No" else 0.3 if r["b"] % 2 else 0.1))
    got = drivers.grow_tree(frame(spark, rows), ["a", "b", "t"], max_depth=4)
    want = brute(rows, ["a", "b", "t"], 4)
    assert sorted((s.node, s.feature, s.value, s.rows, s.rows_left, round(s.gain, 9)) for s in got) == sorted(want)
    for s in got:
        if s.feature != "t":
            later = min(r[s.feature] for r in rows if r[s.feature] > s.value)
            assert s.value < s.threshold


def test_best_cut_inside_what_a_coarse_binning_would_merge(spark):
    """A thousand values between 100 and 101, the label changes at one of them; equal-frequency bins miss it."""
    rows = [{"a": 100 + i / 1000, "b": i % 2, "t": "x", "y": int(i >= 517)} for i in range(1000)]
    (only,) = drivers.grow_tree(frame(spark, rows), ["a", "b", "t"])
    assert (only.feature, only.value, only.rows_left) == ("a", 100.516, 517) and only.threshold == pytest.approx(100.5165)
    assert only.gain == pytest.approx(gini([r["y"] for r in rows]))


def test_no_split_for_pure_equal_or_no_rows(spark):
    base = {"a": 1.0, "b": 2, "t": "x"}
    assert drivers.grow_tree(frame(spark, [base | {"y": 1}] * 5), ["a", "b", "t"]) == []
    assert drivers.grow_tree(frame(spark, [base | {"y": i % 2} for i in range(6)]), ["a", "b", "t"]) == []
    assert drivers.grow_tree(frame(spark, []), ["a", "b", "t"]) == []
    subs = make_subs(spark, [("1", "One year", "x", 1, 1, 1, "No")])
    assert [tuple(r) for r in drivers.churn_drivers(subs).collect()] == [
        ("monthly_mrr", 0.0, 1), ("payment_method", 0.0, 2), ("plan_type", 0.0, 3), ("subscription_months", 0.0, 4)]
    assert drivers.churn_tree(subs).collect() == []


def test_a_null_feature_drops_the_row_and_all_present_features_are_used(spark):
    subs = make_subs(spark, [(str(i), "One year" if i % 3 else "Two year", None if i == 7 else "x", i, 5, 1, "Yes" if i > 10 else "No") for i in range(20)])
    (split,) = drivers._splits(subs, None, 4)[1]
    assert (split.rows, split.feature, split.value) == (19, "subscription_months", 10.0)
    wide = subs.withColumns({f: F.lit("No") for f in drivers.DRIVER_FEATURES if f not in subs.columns})
    assert {r.feature for r in drivers.churn_drivers(wide).collect()} == set(drivers.DRIVER_FEATURES)
    assert len(drivers.churn_drivers(wide, top=5).collect()) == 5
