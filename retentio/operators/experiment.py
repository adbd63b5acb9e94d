"""A/B experiment analysis as DataFrame operators.

Row-level work (checks, cleaning, per-arm counts) runs in Spark; the data
collapses to ONE row of per-arm counts in a single aggregation, and every
statistic (power, pooled z-test, p-value, Cohen's h, intervals, revenue impact,
verdict) is a column expression on that row — nothing is collected.

Scale notes:
* "first row per user" is ``min_by`` of the row itself over its order key — an
  aggregate with a map-side partial step (Spark sorts each task's rows for it,
  as the carried row has no fixed width), so a user with a third of all rows is
  reduced to one row per task before the shuffle (a row_number window would
  sort all of that user's rows in one task);
* users in both arms: smallest and largest digest of the user's arms in one
  fixed-width hash aggregate keyed by user, then a global count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.expr import mean_sql, rate, round_half_away_sql, round_half_even, sql_num, sql_str
from retentio.functions.stats import normal_quantile, two_sided_p_sql
from retentio.operators.common import order_aggregated, pivot_present
from retentio.schemas import FILE_ORDER

CONTROL, TREATMENT = "control", "treatment"
OLD_PAGE, NEW_PAGE = "old_page", "new_page"
# Check messages, verdicts and report texts.
SPLIT_OK, SPLIT_WARNING = "OK", "WARNING — not 50/50!"
CONTAMINATION_ACTION = "ACTION: These users should be removed before analysis."
CONTAMINATION_OK = "Status: OK — no cross-group contamination"
ROLL_OUT, DO_NOT_ROLL_OUT = "ROLL OUT", "DO NOT ROLL OUT"
EXPERIMENT_NAME = "New onboarding landing page vs. old page"
NOT_SIGNIFICANT = "No — cannot conclude a real difference exists"
EFFECT_PREFIX = "Cohen's h = "


@dataclass(frozen=True)
class ExperimentParams:
    alpha: float = 0.05
    power: float = 0.80
    mde: float = 0.02                 # minimum detectable effect (absolute)
    ci_level: float = 0.95
    split_tolerance: float = 0.01
    monthly_visitors: int = 10_000
    avg_deal_value: float = 65.00

    @property
    def z_alpha(self) -> float:
        return normal_quantile(1 - self.alpha / 2)

    @property
    def z_power(self) -> float:
        return normal_quantile(self.power)

    @property
    def z_ci(self) -> float:
        return normal_quantile(1 - (1 - self.ci_level) / 2)


ALIGNED = (f"((grp = {sql_str(CONTROL)} AND landing_page = {sql_str(OLD_PAGE)}) OR "
           f"(grp = {sql_str(TREATMENT)} AND landing_page = {sql_str(NEW_PAGE)}))")
MISALIGNED = (f"((grp = {sql_str(CONTROL)} AND landing_page = {sql_str(NEW_PAGE)}) OR "
              f"(grp = {sql_str(TREATMENT)} AND landing_page = {sql_str(OLD_PAGE)}))")


def aligned() -> Column:
    return F.expr(ALIGNED)


def misaligned() -> Column:
    return F.expr(MISALIGNED)


# ---------------------------------------------------------------------------
# Sanity checks (on the raw rows)
# ---------------------------------------------------------------------------

def _arms_per_user(expo: DataFrame) -> DataFrame:
    """(user_id, both): whether a user has more than one arm. The smallest and the
    largest 64-bit digest of the arm are two fixed-width buffers of one hash
    aggregate: one shuffle keyed by user, to which each task sends one row per
    user. (Two arm names of equal digest would count as one arm; their chance is 2^-64.)"""
    arm = F.xxhash64("grp")
    return (expo.where("grp IS NOT NULL").groupBy("user_id").agg(F.min(arm).alias("_lo"), F.max(arm).alias("_hi"))
            .select("user_id", (F.col("_lo") != F.col("_hi")).alias("both")))


def split_check(expo: DataFrame, params: ExperimentParams = ExperimentParams()) -> DataFrame:
    """Rows and share per arm; OK when the share is within tolerance of 50 %. The share is of all
    rows, those without an arm included; they have no row of their own."""
    counts = expo.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    # share of all rows (a window over the aggregated rows only)
    return (counts.withColumn("share", rate("n", "sum(n) OVER ()")).where("grp IS NOT NULL")
            .withColumn("status", F.expr(f"CASE WHEN abs(share - 0.5D) < {sql_num(params.split_tolerance)} "
                                         f"THEN {sql_str(SPLIT_OK)} ELSE {sql_str(SPLIT_WARNING)} END"))
            .transform(order_aggregated, "grp"))


def contamination_check(expo: DataFrame) -> DataFrame:
    """Users seen in more than one arm."""
    per_user = _arms_per_user(expo)
    return (per_user.agg(F.count(F.lit(1)).alias("users"),
                         F.expr("count_if(both)").alias("contaminated_users"))
            .withColumn("status", F.when(F.col("contaminated_users") > 0, CONTAMINATION_ACTION)
                        .otherwise(CONTAMINATION_OK)))


def alignment_crosstab(expo: DataFrame) -> DataFrame:
    """Arm x page row counts, 0 for an empty cell: every page that occurs has a
    column (the two of the experiment always); rows without arm or page are left out."""
    rows = expo.where("grp IS NOT NULL AND landing_page IS NOT NULL")
    return pivot_present(rows, ["grp"], "landing_page", (NEW_PAGE, OLD_PAGE),
                         lambda cell: F.expr(f"count_if({cell})")).transform(order_aggregated, "grp")


def misaligned_summary(expo: DataFrame) -> DataFrame:
    """Misaligned rows, all rows and their share, in one pass."""
    return (expo.agg(F.expr(f"count_if({MISALIGNED})").alias("misaligned_rows"),
                     F.count(F.lit(1)).alias("total_rows"))
            .withColumn("share", rate("misaligned_rows", "total_rows")))


def misaligned_breakdown(expo: DataFrame) -> DataFrame:
    """Misaligned rows per (arm, page)."""
    return (expo.where(MISALIGNED).groupBy("grp", "landing_page")
            .agg(F.count(F.lit(1)).alias("n")).transform(order_aggregated, "grp", "landing_page"))


def group_rates(expo: DataFrame) -> DataFrame:
    """Per (arm, page): rows, conversions and conversion rate (4 dp, numpy rounding); rows without
    arm or page are in no group."""
    return (expo.where("grp IS NOT NULL AND landing_page IS NOT NULL").groupBy("grp", "landing_page")
            .agg(F.count("user_id").alias("users"), F.sum("converted").cast("long").alias("conversions"))
            .withColumn("rate", round_half_even(mean_sql("conversions", "users"), 4))
            .transform(order_aggregated, "grp", "landing_page"))


# ---------------------------------------------------------------------------
# Cleaning
# ---------------------------------------------------------------------------

def first_row_order(expo: DataFrame, order_by: tuple[str, ...] | None = None) -> Column:
    """Order in which a user's first row is looked for: ``order_by``, else the place in the source
    file where the reader recorded it, else ``ts`` and ``event_id`` as far as the table has them; nulls last.
    Rows equal in these are told apart by a digest of the whole row, which favours no arm, and
    then by its values, so reruns agree."""
    row = [c for c in ("user_id", "ts", "event_id", "grp", "landing_page", "converted") if c in expo.columns]
    given = order_by or ((FILE_ORDER,) if FILE_ORDER in expo.columns else tuple(c for c in ("ts", "event_id") if c in expo.columns))
    keys = [*[F.col(c) for c in given], F.xxhash64(*row), *[F.col(c) for c in row if c != "user_id"]]
    return F.struct(*[x for i, k in enumerate(keys) for x in (k.isNull().alias(f"n{i}"), k.alias(f"k{i}"))])


def clean_exposures(expo: DataFrame, drop_contaminated: bool = False,
                    order_by: tuple[str, ...] | None = None) -> DataFrame:
    """Aligned rows only, then the first row per user in the order of ``first_row_order``: as in the
    source file for a table that ``read_ab_csv(..., file_order=True)`` has read.

    ``drop_contaminated=True`` also removes users seen in both arms (the
    analysis recommends it; the original cleaning step does not do it).
    """
    rows = expo.where(ALIGNED)
    if drop_contaminated:
        rows = rows.join(_arms_per_user(expo).where("both").select("user_id"), "user_id", "left_anti")
    carried = [c for c in ("ts", "event_id", "grp", "landing_page", "converted") if c in expo.columns]
    # the row's own values are carried, never rebuilt from a key; partial aggregation
    # leaves a hot user one row per task
    first = rows.groupBy("user_id").agg(F.min_by(F.struct(*carried), first_row_order(expo, order_by)).alias("_row"))
    return first.select("user_id", "_row.*")


def clean_counts(expo: DataFrame) -> DataFrame:
    """Rows before and after cleaning and rows removed."""
    after = clean_exposures(expo).select(F.count(F.lit(1))).scalar()  # scalar subquery
    return (expo.agg(F.count(F.lit(1)).alias("rows_before"))
            .withColumn("rows_after", after)
            .withColumn("removed", F.col("rows_before") - F.col("rows_after")))


def clean_summary(expo: DataFrame) -> DataFrame:
    """Cleaned rows per arm: count, conversions, mean (4 dp, numpy rounding)."""
    return (clean_exposures(expo).groupBy("grp")
            .agg(F.count("converted").alias("n"), F.sum("converted").cast("long").alias("conversions"))
            .withColumn("rate", round_half_even(mean_sql("conversions", "n"), 4))
            .transform(order_aggregated, "grp"))


# ---------------------------------------------------------------------------
# Statistics on the one-row arm summary
# ---------------------------------------------------------------------------

def arm_stats(cleaned: DataFrame) -> DataFrame:
    """One row: n, conversions and rate per arm (conditional aggregates, one pass)."""
    c, t = f"grp = {sql_str(CONTROL)}", f"grp = {sql_str(TREATMENT)}"
    return (cleaned.agg(F.expr(f"count_if({c})").alias("n_ctrl"),
                        F.expr(f"CAST(sum(CASE WHEN {c} THEN converted END) AS BIGINT)").alias("conv_ctrl"),
                        F.expr(f"count_if({t})").alias("n_treat"),
                        F.expr(f"CAST(sum(CASE WHEN {t} THEN converted END) AS BIGINT)").alias("conv_treat"))
            .withColumns({"p_ctrl": rate("conv_ctrl", "n_ctrl"), "p_treat": rate("conv_treat", "n_treat")}))


def _stats_sql(params: ExperimentParams) -> dict[str, str]:
    """Every statistic as SQL over the one-row arm summary (doubles throughout)."""
    nc, nt = "CAST(n_ctrl AS DOUBLE)", "CAST(n_treat AS DOUBLE)"
    cc, ct = "CAST(conv_ctrl AS DOUBLE)", "CAST(conv_treat AS DOUBLE)"
    pc, pt = "p_ctrl", "p_treat"
    diff = f"({pt} - {pc})"
    zz = params.z_alpha + params.z_power
    # Power: required n per arm at the control rate.
    n_req = f"CEIL({sql_num(2.0 * zz * zz)} * {pc} * (1.0D - {pc}) / {sql_num(params.mde * params.mde)})"
    # Two-proportion z-test, pooled variance, treatment minus control.
    pool = f"(({ct} + {cc}) / ({nt} + {nc}))"
    # null (not an error) when the pooled variance is 0 (no or only conversions)
    z = f"try_divide({diff}, sqrt({pool} * (1.0D - {pool}) * (1.0D / {nt} + 1.0D / {nc})))"
    zc = sql_num(params.z_ci)

    def half(p: str, n: str) -> str:
        return f"({zc} * sqrt({p} * (1.0D - {p}) / {n}))"

    se_diff = f"sqrt({pc} * (1.0D - {pc}) / {nc} + {pt} * (1.0D - {pt}) / {nt})"
    visitors = sql_num(float(params.monthly_visitors))
    conv_c_m, conv_t_m = f"({visitors} * {pc})", f"({visitors} * {pt})"
    return {
        "lift_pp": f"{diff} * 100.0D",
        "relative_change_pct": f"(try_divide({pt}, {pc}) - 1.0D) * 100.0D",
        "n_required": n_req,
        "z_stat": z,
        "p_value": two_sided_p_sql(z),
        "cohen_h": f"2.0D * asin(sqrt({pt})) - 2.0D * asin(sqrt({pc}))",
        "ci_ctrl_low": f"greatest(0.0D, {pc} - {half(pc, nc)})",
        "ci_ctrl_high": f"least(1.0D, {pc} + {half(pc, nc)})",
        "ci_treat_low": f"greatest(0.0D, {pt} - {half(pt, nt)})",
        "ci_treat_high": f"least(1.0D, {pt} + {half(pt, nt)})",
        "ci_diff_low": f"{diff} - {zc} * {se_diff}",
        "ci_diff_high": f"{diff} + {zc} * {se_diff}",
        "conversions_ctrl_month": conv_c_m,
        "conversions_treat_month": conv_t_m,
        "delta_conversions_month": f"{conv_t_m} - {conv_c_m}",
        "delta_mrr_month": f"({conv_t_m} - {conv_c_m}) * {sql_num(float(params.avg_deal_value))}",
    }


REPORT_DIGITS = 6
_ROUNDED = ("ci_ctrl_low", "ci_ctrl_high", "ci_treat_low", "ci_treat_high", "ci_diff_low", "ci_diff_high",
            "conversions_ctrl_month", "conversions_treat_month", "delta_conversions_month", "delta_mrr_month")
_EFFECT_LABEL = ("CASE WHEN abs(_cohen_h) < 0.2D THEN 'negligible' WHEN abs(_cohen_h) < 0.5D THEN 'small' "
                 "WHEN abs(_cohen_h) < 0.8D THEN 'medium' ELSE 'large' END")


def _with_stats(expo: DataFrame, params: ExperimentParams, drop_contaminated: bool) -> DataFrame:
    arms = arm_stats(clean_exposures(expo, drop_contaminated))
    return arms.selectExpr("*", *[f"{v} AS _{k}" for k, v in _stats_sql(params).items()])


def _verdict_sql(params: ExperimentParams) -> str:
    return (f"CASE WHEN _p_value >= {sql_num(params.alpha)} OR p_treat < p_ctrl "
            f"THEN {sql_str(DO_NOT_ROLL_OUT)} ELSE {sql_str(ROLL_OUT)} END")


def experiment_stats(expo: DataFrame, params: ExperimentParams = ExperimentParams(),
                     drop_contaminated: bool = False) -> DataFrame:
    """One row with the arm counts and every test statistic. Reported doubles
    are rounded to 6 dp (the p-value to 4 dp); decisions use unrounded values."""
    def r(name: str, d: int = REPORT_DIGITS) -> str:
        return round_half_away_sql(name, d)

    return _with_stats(expo, params, drop_contaminated).selectExpr(
        "n_ctrl", "conv_ctrl", f"{r('p_ctrl')} AS p_ctrl",
        "n_treat", "conv_treat", f"{r('p_treat')} AS p_treat",
        f"{r('_lift_pp')} AS lift_pp", f"{r('_relative_change_pct')} AS relative_change_pct",
        "CAST(_n_required AS BIGINT) AS n_required",
        "n_ctrl >= _n_required AS powered",
        f"{r(mean_sql('n_ctrl', '_n_required'))} AS power_ratio",
        f"{r('_z_stat')} AS z_stat", f"{r('_p_value', 4)} AS p_value",
        f"_p_value < {sql_num(params.alpha)} AS significant",
        f"{r('_cohen_h')} AS cohen_h", f"{_EFFECT_LABEL} AS effect_size",
        *[f"{r('_' + k)} AS {k}" for k in _ROUNDED],
        f"{_verdict_sql(params)} AS verdict",
    )


def _signed_sql(x: str, digits: int) -> str:
    """'+1.234' / '-1.234' text of a value rounded half away from zero."""
    v = round_half_away_sql(x, digits)
    return f"concat(CASE WHEN {v} >= 0 THEN '+' ELSE '' END, format_number({v}, {digits}))"


def report_rows(expo: DataFrame, params: ExperimentParams = ExperimentParams()) -> DataFrame:
    """The nine-line experiment summary as (row_order, label, value) text rows."""
    def pct(p: str) -> str:
        return f"concat(format_number({round_half_away_sql(p + ' * 100.0D', 2)}, 2), '%')"

    def rate_text(p: str, conv: str, n: str) -> str:
        return f"concat({pct(p)}, ' (', format_number({conv}, 0), ' / ', format_number({n}, 0), ' users)')"

    lines = [
        ("Experiment", sql_str(EXPERIMENT_NAME)),
        ("Control rate", rate_text("p_ctrl", "conv_ctrl", "n_ctrl")),
        ("Treatment rate", rate_text("p_treat", "conv_treat", "n_treat")),
        ("Difference", f"concat({_signed_sql('_lift_pp', 3)}, ' pp  (95% CI: [', "
                       f"{_signed_sql('_ci_diff_low * 100.0D', 2)}, ', ', "
                       f"{_signed_sql('_ci_diff_high * 100.0D', 2)}, '] pp)')"),
        ("P-value", f"concat(format_number({round_half_away_sql('_p_value', 4)}, 4), "
                    f"{sql_str(f'  (threshold: {params.alpha:g})')})"),
        ("Statistical sig.", f"CASE WHEN _p_value < {sql_num(params.alpha)} THEN 'Yes' "
                             f"ELSE {sql_str(NOT_SIGNIFICANT)} END"),
        ("Effect size", f"concat({sql_str(EFFECT_PREFIX)}, "
                        f"format_number({round_half_away_sql('_cohen_h', 4)}, 4), ' (', {_EFFECT_LABEL}, ')')"),
        ("MRR impact", f"concat('$', {_signed_sql('_delta_mrr_month', 0)}, "
                       f"{sql_str(f'/month at {params.monthly_visitors:,} visitors')})"),
        ("VERDICT", _verdict_sql(params)),
    ]
    rows = ", ".join(f"struct({i + 1} AS row_order, {sql_str(k)} AS label, {v} AS value)"
                     for i, (k, v) in enumerate(lines))
    return _with_stats(expo, params, False).selectExpr(f"inline(array({rows}))")
