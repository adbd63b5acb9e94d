"""Row-level column expressions.

All of these are built-in Spark expressions (JVM side, inside whole-stage
codegen); none needs a Python UDF.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's)
# ---------------------------------------------------------------------------

# Lifecycle stage, SQL rule: months <= 6 new, <= 24 growing, else mature.
STAGE_BOUNDS = (6, 24)
STAGE_LABELS_SQL = ("new", "growing", "mature")
# Notebook rule: right-closed bins (-1, 6], (6, 24], (24, 999]; outside -> null.
STAGE_NOTEBOOK_EDGES = (-1, 6, 24, 999)
STAGE_LABELS_NOTEBOOK = ("new (0-6mo)", "growing (7-24mo)", "mature (25mo+)")
# Report / semantic-model rule: months < 6 new, < 24 growing, else mature.
STAGE_LABELS_REPORT = ("New (0-6mo)", "Growing (6-24mo)", "Mature (24mo+)")

# Tenure buckets for the cohort matrix: right-closed, lowest edge included.
TENURE_EDGES = (0, 6, 12, 18, 24, 36, 48, 60, 999)
TENURE_LABELS = ("0-6", "7-12", "13-18", "19-24", "25-36", "37-48", "49-60", "60+")

# Lifetime-value bins of the workbook: right-closed, lowest edge included.
LTV_EDGES_REFERENCE = (0, 500, 1000, 2000, 3000, 5000, 10000)
LTV_LABELS_REFERENCE = ("$0-500", "$500-1K", "$1K-2K", "$2K-3K", "$3K-5K", "$5K+")

# Churn-rate risk bands: notebook (strict >) and report (>=) thresholds.
PLAN_BAND_THRESHOLDS = (0.30, 0.15)
PAYMENT_BAND_THRESHOLDS = (0.30, 0.20)
REPORT_BAND_THRESHOLDS = (0.30, 0.15)
BAND_LABELS = ("high", "medium", "low")
REPORT_BAND_COLORS = ("#6F1010", "#575423", "#1A4A2D")

# Column-name rule: insert "_" between a lower-case and an upper-case letter.
SNAKE_PATTERN = r"(?<=[a-z])(?=[A-Z])"


def col(c: str | Column) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def sql_str(v: str) -> str:
    """A Spark SQL string literal."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_num(v: float) -> str:
    """A Spark SQL numeric literal: integers stay integral, other values are doubles."""
    if isinstance(v, int):
        return str(v)
    return f"{float(v)!r}D"


# Every helper takes either SQL expression text (``str``: a column name or any
# expression; the whole result is built with ONE ``F.expr`` call, parsed in the
# JVM) or a ``Column``. Double literals in expression text carry a ``D``
# suffix so arithmetic stays in DOUBLE (a bare ``100.0`` is a DECIMAL in Spark SQL).

# ---------------------------------------------------------------------------
# Flags and stages
# ---------------------------------------------------------------------------

def yes_flag(c: str | Column) -> Column:
    """'Yes' -> 1, anything else -> 0 (P5)."""
    if isinstance(c, str):
        return F.expr(f"CAST(({c}) = 'Yes' AS INT)")
    return (c == F.lit("Yes")).cast("int")


def lifecycle_stage(months: str | Column = "subscription_months", rule: str = "closed",
                    labels: Sequence[str] | None = None) -> Column:
    """Lifecycle stage of a tenure in months.

    ``rule="closed"``   : <= 6, <= 24 (SQL queries)
    ``rule="half_open"``: <  6, <  24 (workbook and report)
    ``rule="notebook"`` : right-closed bins (-1, 6], (6, 24], (24, 999]; outside -> null
    """
    lo, hi = STAGE_BOUNDS
    if rule == "notebook":
        return cut(months, STAGE_NOTEBOOK_EDGES, labels or STAGE_LABELS_NOTEBOOK)
    if rule not in ("closed", "half_open"):
        raise ValueError(f"unknown stage rule {rule!r}")
    op = "<=" if rule == "closed" else "<"
    a, b, c = labels or (STAGE_LABELS_SQL if rule == "closed" else STAGE_LABELS_REPORT)
    if isinstance(months, str):
        m = f"({months})"
        return F.expr(f"CASE WHEN {m} {op} {lo} THEN {sql_str(a)} WHEN {m} {op} {hi} THEN {sql_str(b)} "
                      f"ELSE {sql_str(c)} END")
    if rule == "closed":
        return F.when(months <= lo, a).when(months <= hi, b).otherwise(c)
    return F.when(months < lo, a).when(months < hi, b).otherwise(c)


def _cut_sql(x: str, edges: Sequence[float], outs: Sequence[str], include_lowest: bool) -> str:
    v = f"({x})"
    whens = []
    for i, out in enumerate(outs):
        lo, hi = sql_num(edges[i]), sql_num(edges[i + 1])
        low_op = ">=" if i == 0 and include_lowest else ">"
        whens.append(f"WHEN {v} {low_op} {lo} AND {v} <= {hi} THEN {out}")
    return "CASE " + " ".join(whens) + " END"


def cut(x: str | Column, edges: Sequence[float], labels: Sequence[str],
        include_lowest: bool = False) -> Column:
    """Right-closed binning like ``pandas.cut``: label i when edges[i] < x <= edges[i+1].

    Values outside the edges, and nulls, give null.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    if isinstance(x, str):
        return F.expr(_cut_sql(x, edges, [sql_str(lab) for lab in labels], include_lowest))
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = (x >= lo) & (x <= hi) if i == 0 and include_lowest else (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def cut_ordinal(x: str | Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """1-based bin number (INT) for the same bins as :func:`cut` (null outside)."""
    if isinstance(x, str):
        return F.expr(_cut_sql(x, edges, [str(i + 1) for i in range(len(edges) - 1)], include_lowest))
    return cut(x, edges, [str(i + 1) for i in range(len(edges) - 1)], include_lowest).cast("int")


def tenure_bucket(months: str | Column = "subscription_months") -> Column:
    return cut(months, TENURE_EDGES, TENURE_LABELS, include_lowest=True)


def tenure_bucket_order(months: str | Column = "subscription_months") -> Column:
    return cut_ordinal(months, TENURE_EDGES, include_lowest=True)


def money_label(v: float) -> str:
    """Compact money text used for bin labels: 500, 1K, 200K, 1M, 2.5M."""
    for div, suffix in ((1_000_000, "M"), (1_000, "K")):
        if v >= div:
            q = v / div
            return f"{q:g}{suffix}"
    return f"{v:g}"


def ltv_bin_labels(edges: Sequence[float]) -> list[str]:
    """Labels for LTV bins built from the edges: "$lo-hi", the last one "$lo+"."""
    out = [f"${money_label(edges[i])}-{money_label(edges[i + 1])}" for i in range(len(edges) - 2)]
    out.append(f"${money_label(edges[-2])}+")
    return out


def risk_band(rate: str | Column, thresholds: Sequence[float] = PLAN_BAND_THRESHOLDS,
              inclusive: bool = False, labels: Sequence[str] = BAND_LABELS) -> Column:
    """Band of a churn rate: above the first threshold high, above the second medium.

    ``inclusive=True`` uses >= (report rules, which also bound the rate to [0, 1]).
    """
    hi, mid = thresholds
    high, medium, low = labels
    if isinstance(rate, str):
        r, h, m = f"({rate})", f"{float(hi)!r}D", f"{float(mid)!r}D"
        if inclusive:
            return F.expr(f"CASE WHEN {r} >= {h} AND {r} <= 1 THEN {sql_str(high)} "
                          f"WHEN {r} >= {m} AND {r} < {h} THEN {sql_str(medium)} "
                          f"WHEN {r} >= 0 AND {r} < {m} THEN {sql_str(low)} END")
        return F.expr(f"CASE WHEN {r} > {h} THEN {sql_str(high)} WHEN {r} > {m} THEN {sql_str(medium)} "
                      f"ELSE {sql_str(low)} END")
    if inclusive:
        return (F.when((rate >= hi) & (rate <= 1), high)
                .when((rate >= mid) & (rate < hi), medium)
                .when((rate >= 0) & (rate < mid), low))
    return F.when(rate > hi, high).when(rate > mid, medium).otherwise(low)


def effect_size_label(h: str | Column) -> Column:
    """Cohen's h magnitude label on |h|: <0.2 negligible, <0.5 small, <0.8 medium."""
    if isinstance(h, str):
        a = f"abs({h})"
        return F.expr(f"CASE WHEN {a} < 0.2D THEN 'negligible' WHEN {a} < 0.5D THEN 'small' "
                      f"WHEN {a} < 0.8D THEN 'medium' ELSE 'large' END")
    a = F.abs(h)
    return (F.when(a < 0.2, "negligible").when(a < 0.5, "small")
            .when(a < 0.8, "medium").otherwise("large"))


# ---------------------------------------------------------------------------
# Arithmetic
# ---------------------------------------------------------------------------

def round_half_away_sql(x: str, digits: int) -> str:
    v = f"CAST(({x}) AS DOUBLE)"
    s = f"{float(10 ** digits)!r}D"
    return (f"CASE WHEN {v} < 0 THEN -FLOOR(-{v} * {s} + 0.5D) / {s} "
            f"ELSE FLOOR({v} * {s} + 0.5D) / {s} END")


def round_ratio_sql(num: str, den: str, digits: int) -> str:
    """num / den rounded half away from zero to ``digits`` decimals, computed
    exactly on integers (SQL ``ROUND`` of an exact numeric ratio): ``num`` and
    ``den`` are integral expressions, ``den`` > 0; the arithmetic runs in
    DECIMAL(38,0), so it cannot overflow for realistic sums. Returns a DOUBLE
    (the exact result's nearest double while |num/den| * 10^digits < 2^53); a
    zero or null denominator gives null."""
    s = 10 ** digits
    n = f"CAST(({num}) AS DECIMAL(38,0))"
    d = f"NULLIF(CAST(({den}) AS DECIMAL(38,0)), 0)"
    return (f"(CAST(CASE WHEN {n} < 0 THEN -((2 * -{n} * {s} + {d}) div (2 * {d})) "
            f"ELSE (2 * {n} * {s} + {d}) div (2 * {d}) END AS DOUBLE) / {float(s)!r}D)")


def cents(x: str, scale: int = 2) -> str:
    """An exact decimal (e.g. a money sum) as an integral DECIMAL(38,0) of its smallest unit."""
    return f"CAST(({x}) * {10 ** scale} AS DECIMAL(38,0))"


def round_half_away(x: str | Column, digits: int) -> Column:
    """Round a double half away from zero (SQL ``ROUND(numeric, d)`` semantics).

    Written as floor(|x| * 10^d + 0.5) so every engine evaluates the same IEEE
    operations; Spark's own ``round`` on doubles rounds the shortest decimal text
    instead and can differ at near-ties.
    """
    if isinstance(x, str):
        return F.expr(round_half_away_sql(x, digits))
    v = x.cast("double")
    s = float(10 ** digits)
    return (F.when(v < 0, -F.floor(-v * s + 0.5) / s)
            .otherwise(F.floor(v * s + 0.5) / s))


def round_half_even(x: str | Column, digits: int) -> Column:
    """numpy/pandas ``round(d)``: rint(x * 10^d) / 10^d."""
    s = float(10 ** digits)
    if isinstance(x, str):
        return F.expr(f"rint(CAST(({x}) AS DOUBLE) * {s!r}D) / {s!r}D")
    return F.rint(x.cast("double") * s) / s


def money_double(x: str | Column) -> Column:
    """Decimal money -> double, done last so sums stay exact."""
    return F.expr(f"CAST(({x}) AS DOUBLE)") if isinstance(x, str) else x.cast("double")


def mean_sql(sum_expr: str, count_expr: str) -> str:
    return f"try_divide(CAST(({sum_expr}) AS DOUBLE), CAST(({count_expr}) AS DOUBLE))"


def mean_of(sum_col: str | Column, count_col: str | Column) -> Column:
    """Mean from an exact (decimal or integral) sum and a count, as double."""
    if isinstance(sum_col, str) and isinstance(count_col, str):
        return F.expr(mean_sql(sum_col, count_col))
    return F.try_divide(col(sum_col).cast("double"), col(count_col).cast("double"))


def rate(numerator: str | Column, denominator: str | Column) -> Column:
    """Safe ratio: null (blank) instead of an error when the denominator is 0."""
    return mean_of(numerator, denominator)


def to_snake(name: str) -> str:
    """CamelCase -> snake_case for a column name (schema only, no data pass)."""
    return re.sub(SNAKE_PATTERN, "_", name).lower()


def blank_to_null(c: str | Column) -> Column:
    """Whitespace-only text -> null (S4)."""
    if isinstance(c, str):
        return F.expr(f"CASE WHEN trim({c}) != '' THEN {c} END")
    return F.when(F.trim(c) != "", c)
