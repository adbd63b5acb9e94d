"""Property tests: random data, groupings and filters against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from retentio.operators.measures import MEASURES, measure_query
from retentio.operators.stats import exact_percentiles

LABELS = ["Starter", "Growth", "Enterprise"]
PAYMENTS = ["Bank transfer", "Credit card"]

row = st.tuples(st.sampled_from(LABELS + [None]), st.sampled_from(["Yes", "No"]), st.sampled_from(PAYMENTS),
                st.integers(0, 30), st.integers(0, 50_000).map(lambda c: c / 100),
                st.one_of(st.none(), st.integers(0, 900_000).map(lambda c: c / 100)))

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


def _part_value(p, rows):
    if p.kind == "count":
        return len(rows) if p.value is None else int(rows[p.value].notna().sum())
    vals = rows[p.value].dropna()
    return None if vals.empty else float(vals.sum())


def _where_mask(measure_name, part_name, rows):
    active = rows.churned == "No"
    conds = {
        ("total_mrr", "s"): active,
        ("churn_rate", "yes"): rows.churned == "Yes",
        ("avg_tenure_months", "s"): active, ("avg_tenure_months", "n"): active,
        ("at_risk_mrr", "s"): active & (rows.subscription_months < 6),
    }
    return conds.get((measure_name, part_name), pd.Series(True, index=rows.index))


def _brute(pdf, names, by, slicer):
    filt = pd.Series(True, index=pdf.index)
    for c, vals in slicer.items():
        filt &= pdf[c].isin(vals)
    groups = pdf[filt].groupby(list(by), dropna=False).size().index.tolist() if by else [()]
    out = {}
    for g in groups:
        g = g if isinstance(g, tuple) else (g,)
        res = {}
        for name in names:
            m = MEASURES[name]
            parts = {}
            for pname, p in m.parts.items():
                mask = _where_mask(name, pname, pdf)
                for c, v in zip(by, g):
                    if c not in p.overrides:
                        mask &= pdf[c].isna() if pd.isna(v) else (pdf[c] == v)
                for c, vals in slicer.items():
                    if c not in p.overrides:
                        mask &= pdf[c].isin(vals)
                parts[pname] = _part_value(p, pdf[mask])
            res[name] = parts
        out[g] = res
    return out


def _final(name, parts):
    div = lambda a, b: None if a is None or b in (None, 0) else a / b
    if name in ("total_mrr", "at_risk_mrr", "total_mrr_all") or name.startswith("sum_"):
        return parts["s"]
    if name == "churn_rate":
        return div(parts["yes"] or None, parts["all"])
    if name in ("avg_ltv", "avg_tenure_months"):
        return div(parts["s"], parts["n"])
    if name == "ltv_mrr_ratio":
        a, b = div(parts["ls"], parts["ln"]), div(parts["ms"], parts["mn"])
        return div(a, b)
    raise KeyError(name)


@SETTINGS
@given(rows=st.lists(row, min_size=1, max_size=40),
       by=st.sampled_from([(), ("plan_label",), ("churned",), ("plan_label", "churned"),
                           ("payment_method", "churned"), ("subscription_months",)]),
       slicer=st.sampled_from([{}, {"plan_label": ["Starter"]}, {"churned": ["Yes"]},
                               {"plan_label": ["Growth", "Enterprise"], "churned": ["No"]}]))
def test_measure_query_equals_brute_force(spark, rows, by, slicer):
    pdf = pd.DataFrame(rows, columns=["plan_label", "churned", "payment_method", "subscription_months",
                                      "monthly_mrr", "lifetime_value"])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "plan_label string, churned string, payment_method string, "
                               "subscription_months long, monthly_mrr double, lifetime_value double")
    names = list(MEASURES)
    got = {tuple(r[c] for c in by): r for r in measure_query(df, names, by, slicer).collect()}
    exp = {tuple(None if pd.isna(v) else v for v in g): parts for g, parts in _brute(pdf, names, by, slicer).items()}
    assert set(got) == set(exp)
    for g, parts in exp.items():
        for name in names:
            e, a = _final(name, parts[name]), got[g][name]
            if e is None:
                assert a is None, (g, name)
            else:
                assert a == pytest.approx(e, rel=1e-9, abs=1e-9), (g, name, by, slicer)


@SETTINGS
@given(values=st.lists(st.one_of(st.none(), st.integers(-500, 500).map(lambda v: v / 4)), min_size=1, max_size=120),
       hot=st.integers(0, 200),
       probs=st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]), min_size=1, max_size=3, unique=True))
def test_exact_percentiles_equal_numpy(spark, values, hot, probs):
    rows = [("a" if i % 3 else "b", v) for i, v in enumerate(values)] + [("hot", 1.5)] * hot
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_percentiles(df, "v", ["g"], probs).collect()}
    for g in {g for g, _ in rows}:
        vals = np.array([v for gg, v in rows if gg == g and v is not None])
        if len(vals) == 0:
            assert g not in got
            continue
        for p in probs:
            name = "p" + f"{p * 100:g}"
            assert getattr(got[g], name) == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)


@SETTINGS
@given(edges=st.lists(st.integers(-50, 1000), min_size=2, max_size=7, unique=True).map(sorted),
       values=st.lists(st.one_of(st.none(), st.integers(-100, 1100)), min_size=1, max_size=60),
       include_lowest=st.booleans())
def test_cut_equals_pandas_cut(spark, edges, values, include_lowest):
    from pyspark.sql import functions as F

    from retentio.functions.expr import cut, cut_ordinal
    labels = [f"b{i}" for i in range(len(edges) - 1)]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    got = df.select(cut("x", edges, labels, include_lowest).alias("l"),
                    cut_ordinal("x", edges, include_lowest).alias("o"),
                    cut(F.col("x"), edges, labels, include_lowest).alias("lc")).collect()
    exp = pd.cut(pd.Series(values, dtype="float64"), bins=edges, labels=labels, include_lowest=include_lowest)
    for r, e in zip(got, exp):
        e = None if pd.isna(e) else str(e)
        assert r.l == e and r.lc == e
        assert r.o == (None if e is None else labels.index(e) + 1)


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(-10 ** 11, 10 ** 11), st.integers(1, 10 ** 6)), min_size=1, max_size=30),
       digits=st.integers(0, 4))
def test_round_ratio_equals_decimal(spark, pairs, digits):
    from decimal import ROUND_HALF_UP, Decimal

    from pyspark.sql import functions as F

    from retentio.functions.expr import round_ratio_sql
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(F.expr(round_ratio_sql("n", "d", digits))).collect()]
    q = Decimal(1).scaleb(-digits)
    # |n/d| * 10^digits stays below 2^53, where the DOUBLE result is exact
    for (n, d), g in zip(pairs, got):
        assert g == float((Decimal(n) / Decimal(d)).quantize(q, rounding=ROUND_HALF_UP))


exposure = st.tuples(st.integers(1, 6), st.integers(0, 30), st.integers(-5, 10 ** 6),
                     st.sampled_from(["control", "treatment", None]),
                     st.sampled_from(["old_page", "new_page", None]), st.integers(0, 1))


@SETTINGS
@given(rows=st.lists(exposure, min_size=1, max_size=50, unique_by=lambda r: r[2]))
def test_clean_exposures_equals_brute_force(spark, rows):
    import datetime as dt

    from retentio.operators.experiment import clean_exposures
    t0 = dt.datetime(2024, 1, 1)
    data = [(u, t0 + dt.timedelta(seconds=s), e, g, p, c) for u, s, e, g, p, c in rows]
    df = spark.createDataFrame(data, "user_id long, ts timestamp_ntz, event_id long, grp string, "
                                     "landing_page string, converted int")
    got = {r.user_id: (r.ts, r.event_id, r.grp, r.landing_page, r.converted)
           for r in clean_exposures(df).collect()}
    pdf = pd.DataFrame(data, columns=["user_id", "ts", "event_id", "grp", "landing_page", "converted"])
    ok = (((pdf.grp == "control") & (pdf.landing_page == "old_page"))
          | ((pdf.grp == "treatment") & (pdf.landing_page == "new_page")))
    first = pdf[ok].sort_values(["user_id", "ts", "event_id"]).groupby("user_id").head(1)
    exp = {r.user_id: (r.ts.to_pydatetime(), r.event_id, r.grp, r.landing_page, r.converted)
           for r in first.itertuples()}
    assert got == exp


@SETTINGS
@given(arms=st.lists(st.tuples(st.integers(1, 10 ** 6), st.integers(1, 10 ** 6), st.floats(0.0, 1.0),
                               st.floats(0.0, 1.0)), min_size=1, max_size=10))
def test_experiment_statistics_equal_python_formulas(spark, arms):
    import math

    from retentio.operators.experiment import ExperimentParams, _stats_sql
    rows = [(nc, int(round(fc * nc)), nt, int(round(ft * nt))) for nc, nt, fc, ft in arms]
    df = spark.createDataFrame(rows, "n_ctrl long, conv_ctrl long, n_treat long, conv_treat long") \
        .selectExpr("*", "conv_ctrl / n_ctrl AS p_ctrl", "conv_treat / n_treat AS p_treat")
    params = ExperimentParams()
    stats = _stats_sql(params)
    got = df.selectExpr(*[f"{v} AS {k}" for k, v in stats.items()]).collect()
    za, zb, zc = params.z_alpha, params.z_power, params.z_ci
    for (nc, cc, nt, ct), g in zip(rows, got):
        pc, pt = cc / nc, ct / nt
        assert g.n_required == math.ceil(2 * (za + zb) ** 2 * pc * (1 - pc) / params.mde ** 2) \
            or abs(2 * (za + zb) ** 2 * pc * (1 - pc) / params.mde ** 2 % 1) < 1e-9
        pool = (ct + cc) / (nt + nc)
        var = pool * (1 - pool) * (1 / nt + 1 / nc)
        if var == 0:
            assert g.z_stat is None and g.p_value is None
            continue
        z = (pt - pc) / math.sqrt(var)
        assert g.z_stat == pytest.approx(z, rel=1e-9, abs=1e-12)
        assert g.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=2e-7)
        assert g.cohen_h == pytest.approx(2 * math.asin(math.sqrt(pt)) - 2 * math.asin(math.sqrt(pc)), abs=1e-12)
        se = math.sqrt(pc * (1 - pc) / nc + pt * (1 - pt) / nt)
        assert g.ci_diff_low == pytest.approx((pt - pc) - zc * se, abs=1e-12)
        assert g.ci_ctrl_low == pytest.approx(max(0.0, pc - zc * math.sqrt(pc * (1 - pc) / nc)), abs=1e-12)
        assert g.ci_treat_high == pytest.approx(min(1.0, pt + zc * math.sqrt(pt * (1 - pt) / nt)), abs=1e-12)
        assert g.delta_mrr_month == pytest.approx((10000 * pt - 10000 * pc) * 65.0, abs=1e-9)


@SETTINGS
@given(vals=st.lists(st.one_of(st.integers(0, 40), st.integers(0, 400).map(lambda v: v / 4),
                               st.integers(0, 10 ** 6).map(lambda v: v / 100)), min_size=1, max_size=60))
def test_histogram_equals_numpy(spark, vals):
    from conftest import make_subs
    from retentio.operators.cohorts import ltv_histogram_by_plan
    rows = [(f"c{i}", "One year", "x", 1, 1, v, "No") for i, v in enumerate(vals)]
    got = {r.bin: r.customers for r in ltv_histogram_by_plan(make_subs(spark, rows)).collect()}
    counts, _ = np.histogram(np.array([float(v) for v in vals]), bins=40)
    assert got == {i + 1: int(c) for i, c in enumerate(counts) if c}


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 80), st.integers(0, 10 ** 6).map(lambda c: c / 100),
                               st.one_of(st.none(), st.integers(0, 10 ** 8).map(lambda c: c / 100))),
                     min_size=2, max_size=50))
def test_describe_equals_pandas(spark, rows):
    from conftest import make_subs
    from retentio.operators.quality import numeric_describe
    subs = make_subs(spark, [(f"c{i}", "One year", "x", m, mrr, ltv, "No") for i, (m, mrr, ltv) in enumerate(rows)])
    got = {r.field: r for r in numeric_describe(subs).collect()}
    pdf = pd.DataFrame(rows, columns=["subscription_months", "monthly_mrr", "lifetime_value"]).astype(float)
    desc = pdf.describe().round(2)
    for field in pdf.columns:
        exp, r = desc[field], got[field]
        assert r["count"] == int(exp["count"])
        if r["count"] == 0:
            continue
        for ours, theirs in ((r.mean, exp["mean"]), (r.min, exp["min"]), (r.max, exp["max"]),
                             (r.p25, exp["25%"]), (r.p50, exp["50%"]), (r.p75, exp["75%"])):
            assert abs(ours - theirs) <= 0.0100001, (field, ours, theirs)
        if r["count"] > 1:
            assert abs(r.std - exp["std"]) <= 0.0100001, (field, r.std, exp["std"])


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["Month-to-month", "One year", "Two year"]),
                               st.integers(0, 1100), st.sampled_from(["Yes", "No"])), min_size=1, max_size=80))
def test_cohort_matrix_equals_pandas(spark, rows):
    from conftest import make_subs
    from retentio.functions.expr import TENURE_EDGES, TENURE_LABELS
    from retentio.operators.cohorts import cohort_churn_matrix
    subs = make_subs(spark, [(f"c{i}", p, "x", m, 1, 1, ch) for i, (p, m, ch) in enumerate(rows)])
    got = {r.tenure_bucket: r.asDict() for r in cohort_churn_matrix(subs).collect()}
    pdf = pd.DataFrame(rows, columns=["plan_type", "m", "churned"])
    pdf["flag"] = (pdf.churned == "Yes").astype(int)
    pdf["bucket"] = pd.cut(pdf.m, bins=list(TENURE_EDGES), labels=list(TENURE_LABELS), include_lowest=True)
    exp = pdf.groupby(["bucket", "plan_type"], observed=True)["flag"].mean().unstack("plan_type").mul(100).round(1)
    assert set(got) == {str(b) for b in exp.index}
    for b in exp.index:
        for plan in ("Month-to-month", "One year", "Two year"):
            e = exp.loc[b, plan] if plan in exp.columns else float("nan")
            g = got[str(b)][plan]
            assert (g is None and pd.isna(e)) or g == e, (b, plan, g, e)


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["Month-to-month", "One year", "Two year"]),
                               st.one_of(st.none(), st.integers(0, 10 ** 8).map(lambda c: c / 100))),
                     min_size=1, max_size=60))
def test_ltv_stats_equal_pandas(spark, rows):
    from conftest import make_subs
    from retentio.operators.cohorts import ltv_stats_by_plan
    subs = make_subs(spark, [(f"c{i}", p, "x", 1, 1, v, "No") for i, (p, v) in enumerate(rows)])
    got = {r.plan_type: r for r in ltv_stats_by_plan(subs).collect()}
    pdf = pd.DataFrame(rows, columns=["plan_type", "ltv"]).dropna()
    exp = pdf.groupby("plan_type")["ltv"].agg(["median", "mean", "std", "count"]).round(2)
    assert set(got) == set(exp.index)
    for plan, e in exp.iterrows():
        r = got[plan]
        assert r["count"] == int(e["count"])
        assert abs(r.median - e["median"]) <= 0.0100001 and abs(r.mean - e["mean"]) <= 0.0100001
        assert (r.std is None and pd.isna(e["std"])) or abs(r.std - e["std"]) <= 0.0100001


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(0, 80), st.integers(1, 10 ** 6).map(lambda c: c / 100),
                               st.one_of(st.none(), st.integers(0, 10 ** 8).map(lambda c: c / 100)),
                               st.sampled_from(["Yes", "No"])), min_size=1, max_size=60))
def test_kpi_block_equals_pandas(spark, rows):
    from conftest import make_subs
    from retentio.operators.workbook import kpi_block
    subs = make_subs(spark, [(f"c{i}", "One year", "x", m, mrr, ltv, ch) for i, (m, mrr, ltv, ch) in enumerate(rows)])
    got = {r.metric: r.value for r in kpi_block(subs).collect()}
    df = pd.DataFrame(rows, columns=["m", "mrr", "ltv", "churned"])
    active = df[df.churned == "No"]
    exp = {
        "Total MRR (Active)": active.mrr.sum() if len(active) else None,
        "Churn Rate %": (df.churned == "Yes").sum() / len(df),
        "Avg LTV": df.ltv.mean(),
        "Avg Tenure Months": active.m.mean() if len(active) else None,
        "At-Risk MRR": active[active.m < 6].mrr.sum() if (active.m < 6).any() else None,
        "LTV MRR Ratio": df.ltv.mean() / df.mrr.mean(),
    }
    for k, e in exp.items():
        if e is None or pd.isna(e):
            assert got[k] is None, (k, got[k])
        else:
            assert got[k] == pytest.approx(e, rel=1e-9), (k, got[k], e)
