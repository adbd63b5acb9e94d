import math

import pytest
from pyspark.sql import functions as F

from retentio.functions.expr import (
    LTV_EDGES_REFERENCE, LTV_LABELS_REFERENCE, cut, cut_ordinal, effect_size_label, lifecycle_stage,
    ltv_bin_labels, risk_band, round_half_away, round_half_even, tenure_bucket, to_snake,
)
from retentio.functions.stats import erfc_python, normal_quantile, two_sided_p

MONTHS = [0, 5, 6, 7, 23, 24, 25, 60, 61, 999, 1000, None, -1]


def _eval(spark, values, expr, dtype="int"):
    if dtype == "double":
        values = [None if v is None else float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_stage_rules_differ_only_at_6_and_24(spark):
    closed = _eval(spark, MONTHS, lambda c: lifecycle_stage(c, "closed"))
    half = _eval(spark, MONTHS, lambda c: lifecycle_stage(c, "half_open"))
    nb = _eval(spark, MONTHS, lambda c: lifecycle_stage(c, "notebook"))
    assert closed == ["new", "new", "new", "growing", "growing", "growing", "mature", "mature",
                      "mature", "mature", "mature", "mature", "new"]
    assert half == ["New (0-6mo)", "New (0-6mo)", "Growing (6-24mo)", "Growing (6-24mo)",
                    "Growing (6-24mo)", "Mature (24mo+)", "Mature (24mo+)", "Mature (24mo+)",
                    "Mature (24mo+)", "Mature (24mo+)", "Mature (24mo+)", "Mature (24mo+)", "New (0-6mo)"]
    # notebook bins (-1, 6], (6, 24], (24, 999]: above 999, null and -1 have no stage
    assert nb == ["new (0-6mo)", "new (0-6mo)", "new (0-6mo)", "growing (7-24mo)", "growing (7-24mo)",
                  "growing (7-24mo)", "mature (25mo+)", "mature (25mo+)", "mature (25mo+)",
                  "mature (25mo+)", None, None, None]


def test_tenure_buckets_right_closed_lowest_included(spark):
    got = _eval(spark, [0, 6, 7, 12, 13, 24, 25, 60, 61, 999, 1000, -1, None], tenure_bucket)
    assert got == ["0-6", "0-6", "7-12", "7-12", "13-18", "19-24", "25-36", "49-60", "60+", "60+",
                   None, None, None]


def test_ltv_bins_and_out_of_range(spark):
    vals = [0, 500, 500.01, 1000, 10000, 10000.01, None]
    got = _eval(spark, vals, lambda c: cut(c, LTV_EDGES_REFERENCE, LTV_LABELS_REFERENCE, include_lowest=True),
                "double")
    assert got == ["$0-500", "$0-500", "$500-1K", "$500-1K", "$5K+", None, None]
    got = _eval(spark, vals, lambda c: cut_ordinal(c, LTV_EDGES_REFERENCE, include_lowest=True), "double")
    assert got == [1, 1, 2, 2, 6, None, None]


def test_ltv_labels_from_edges():
    assert ltv_bin_labels(LTV_EDGES_REFERENCE) == list(LTV_LABELS_REFERENCE)
    assert ltv_bin_labels((0, 200_000, 400_000, 600_000, 1_000_000, 2_000_000, 3_000_000)) == [
        "$0-200K", "$200K-400K", "$400K-600K", "$600K-1M", "$1M-2M", "$2M+"]


@pytest.mark.parametrize("rate,strict,inclusive", [
    (0.0, "low", "low"), (0.15, "low", "medium"), (0.2, "medium", "medium"),
    (0.3, "medium", "high"), (0.31, "high", "high"), (1.0, "high", "high"),
])
def test_risk_bands_at_thresholds(spark, rate, strict, inclusive):
    assert _eval(spark, [rate], lambda c: risk_band(c, (0.30, 0.15)), "double") == [strict]
    assert _eval(spark, [rate], lambda c: risk_band(c, (0.30, 0.15), inclusive=True), "double") == [inclusive]


def test_payment_band_threshold_020(spark):
    assert _eval(spark, [0.2, 0.2001], lambda c: risk_band(c, (0.30, 0.20)), "double") == ["low", "medium"]


def test_rounding_helpers(spark):
    vals = [1.005, 2.5, -2.5, 0.125, 6.25, -1.25, None]
    assert _eval(spark, vals, lambda c: round_half_away(c, 2), "double")[:4] == [1.0, 2.5, -2.5, 0.13]
    assert _eval(spark, [2.5, -2.5, 0.5], lambda c: round_half_away(c, 0), "double") == [3.0, -3.0, 1.0]
    # numpy semantics: half to even on the scaled value
    assert _eval(spark, [6.25, 0.125, 2.5, 3.5], lambda c: round_half_even(c, 1), "double") == [6.2, 0.1, 2.5, 3.5]
    assert _eval(spark, [2.5, 3.5], lambda c: round_half_even(c, 0), "double") == [2.0, 4.0]


def test_effect_size_labels(spark):
    got = _eval(spark, [0.0, -0.19, 0.2, 0.49, -0.5, 0.8], effect_size_label, "double")
    assert got == ["negligible", "negligible", "small", "small", "medium", "large"]


def test_erfc_approximation_close_to_math():
    for x in [0.0, 0.03, 0.5, 1.0, 1.96, 3.0, 5.0]:
        assert abs(erfc_python(x) - math.erfc(x)) < 2e-7


def test_two_sided_p_column(spark):
    z = [0.0, 1.959963984540054, -2.5758293035489, 0.030656]
    got = _eval(spark, z, two_sided_p, "double")
    for zi, p in zip(z, got):
        assert abs(p - math.erfc(abs(zi) / math.sqrt(2))) < 2e-7
    assert abs(normal_quantile(0.975) - 1.959963984540054) < 1e-12


def test_snake_case_rule():
    assert [to_snake(c) for c in ["PaymentMethod", "InternetService", "StreamingTV", "SeniorCitizen",
                                  "gender", "customer_id"]] == [
        "payment_method", "internet_service", "streaming_tv", "senior_citizen", "gender", "customer_id"]


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class _Context:
    def __init__(self, conf_value, ckpt=None):
        self._conf, self.ckpt = _Conf(conf_value), ckpt

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self.ckpt

    def setCheckpointDir(self, d):
        self.ckpt = d


class _Session:
    def __init__(self, conf_value, ckpt=None):
        self.sparkContext = _Context(conf_value, ckpt)
        self.conf = _Conf(conf_value)


def test_shared_dir_reads_setting_and_falls_back_only_when_unset():
    from retentio.session import shared_dir
    s = _Session("hdfs://cluster/shared/ckpt")
    assert shared_dir(s) == "hdfs://cluster/shared/ckpt"
    assert s.sparkContext.ckpt == "hdfs://cluster/shared/ckpt"
    s = _Session(None, ckpt="s3a://bucket/ckpt/uuid")
    assert shared_dir(s) == "s3a://bucket/ckpt/uuid"
    s = _Session(None)
    s.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        shared_dir(s)
    s.sparkContext.master = "local[4]"
    local = shared_dir(s)
    assert local.startswith("/") and s.sparkContext.ckpt == local


def test_round_ratio_is_exact_half_away_from_zero(spark):
    from decimal import ROUND_HALF_UP, Decimal

    from retentio.functions.expr import round_ratio_sql
    # (num, den): exact ties that a double gets wrong (12.345 = 2469/200), negatives, zero denominator
    pairs = [(2469, 200), (-2469, 200), (1, 8), (-1, 8), (1005, 1000), (7, 3), (-7, 3), (0, 5), (5, 0),
             (123456789012345, 1000), (1, 40), (3, 20)]
    df = spark.createDataFrame(pairs, "n long, d long")
    got = [r[0] for r in df.select(F.expr(round_ratio_sql("n", "d", 2))).collect()]
    for (n, d), g in zip(pairs, got):
        if d == 0:
            assert g is None
        else:
            exp = float((Decimal(n) / Decimal(d)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))
            assert g == exp, (n, d, g, exp)


def test_round_ratio_does_not_overflow_on_large_sums(spark):
    from retentio.functions.expr import round_ratio_sql
    # 2 * n * 10^4 exceeds BIGINT; the DECIMAL(38,0) arithmetic does not overflow
    df = spark.createDataFrame([(461_168_601_842_739, 1_000_000)], "n long, d long")
    got = df.select(F.expr(round_ratio_sql("n", "d", 4))).collect()[0][0]
    assert got == 461168601.8427
