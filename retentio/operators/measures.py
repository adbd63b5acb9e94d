"""Named measures evaluated under any grouping and filter.

A measure is a small set of additive *parts* (conditional sums and counts) and a
final expression over them. ``measure_query`` evaluates any list of measures
grouped by any columns, in ONE aggregation pass over the fact rows:

* a part's own condition is a conditional aggregate (``sum(CASE WHEN ..)``);
* slicer filters on columns that no part overrides are applied as an ordinary
  ``where`` (so they reach the scan as pushed filters);
* a part that *replaces* the outer filter on some columns (the report's
  ``CALCULATE(expr, col = v)``) ignores slicer filters on those columns, and
  when it is grouped by such a column its value is re-aggregated over the other
  grouping keys with a window over the already-aggregated rows (one row per
  group, never the fact rows), i.e. the coarser grain broadcast back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.functions.expr import mean_sql, sql_str


@dataclass(frozen=True)
class Part:
    kind: str                                   # "sum" | "count"
    value: str | None = None                    # column; None counts rows
    where: str | None = None                    # row condition of the part (SQL)
    overrides: tuple[str, ...] = ()             # columns whose outer filters it replaces


@dataclass(frozen=True)
class Measure:
    name: str
    label: str
    parts: Mapping[str, Part]
    final: Callable[[Mapping[str, str]], str]   # SQL over the parts' column names
    format_string: str
    tooltip: str | None = None
    folder: str | None = None
    hidden: bool = False


ACTIVE = "churned = 'No'"
CHURNED = "churned = 'Yes'"
ACTIVE_EARLY = "subscription_months < 6 AND churned = 'No'"


# ---------------------------------------------------------------------------
# The report's measures, format strings and tooltip texts
# ---------------------------------------------------------------------------
TOTAL_MRR = Measure(
    "total_mrr", "Total MRR",
    {"s": Part("sum", "monthly_mrr", ACTIVE, ("churned",))},
    lambda p: f"CAST({p['s']} AS DOUBLE)", '"$" #,##0',
    "Active subscriber revenue only. Churned customers are excluded from this total.")
CHURN_RATE = Measure(
    "churn_rate", "Churn Rate %",
    {"yes": Part("count", None, CHURNED), "all": Part("count")},
    # no churned row: a count of nothing is blank in the report, not 0
    lambda p: mean_sql(f"nullif({p['yes']}, 0)", p["all"]), "0.00%",
    "% of all customers (active + churned) who have cancelled. Baseline health indicator.",
    "Core KPIs")
AVG_LTV = Measure(
    "avg_ltv", "Avg LTV",
    {"s": Part("sum", "lifetime_value"), "n": Part("count", "lifetime_value")},
    lambda p: mean_sql(p["s"], p["n"]), '"$" #,##0',
    "Average lifetime revenue per customer across all records, including churned. "
    "Reflects full revenue capture.", "Core KPIs")
AVG_TENURE = Measure(
    "avg_tenure_months", "Avg Tenure Months",
    {"s": Part("sum", "subscription_months", ACTIVE, ("churned",)),
     "n": Part("count", "subscription_months", ACTIVE, ("churned",))},
    lambda p: mean_sql(p["s"], p["n"]), '0.0 "mths"',
    "Average months subscribed, active customers only. Higher = stronger retention.",
    "Core KPIs")
AT_RISK_MRR = Measure(
    "at_risk_mrr", "At-Risk MRR",
    {"s": Part("sum", "monthly_mrr", ACTIVE_EARLY, ("subscription_months", "churned"))},
    lambda p: f"CAST({p['s']} AS DOUBLE)", '"$" #,##0',
    "Revenue from subscribers in their first 6 months — the highest churn-risk window. "
    "Monitor closely.", "Risk")
LTV_MRR_RATIO = Measure(
    "ltv_mrr_ratio", "LTV MRR Ratio",
    {"ls": Part("sum", "lifetime_value"), "ln": Part("count", "lifetime_value"),
     "ms": Part("sum", "monthly_mrr"), "mn": Part("count", "monthly_mrr")},
    lambda p: f"try_divide({mean_sql(p['ls'], p['ln'])}, {mean_sql(p['ms'], p['mn'])})", "0.0",
    "Avg LTV ÷ Avg MRR. Indicates how many months of revenue the typical customer generates. "
    "~35x = healthy for SaaS.", "Efficiency")
TOTAL_MRR_ALL = Measure(
    "total_mrr_all", "Total MRR All Customers",
    {"s": Part("sum", "monthly_mrr")},
    lambda p: f"CAST({p['s']} AS DOUBLE)", r"\$#,0.###############;(\$#,0.###############);\$#,0.###############",
    hidden=True)

# Implicit measures: a numeric column dropped into a visual is summed
# (the model's default summarization of these columns is SUM).
SUM_SUBSCRIPTION_MONTHS = Measure(
    "sum_subscription_months", "Sum of subscription_months",
    {"s": Part("sum", "subscription_months")}, lambda p: f"CAST({p['s']} AS BIGINT)", "0", hidden=True)
SUM_MONTHLY_MRR = Measure(
    "sum_monthly_mrr", "Sum of monthly_mrr",
    {"s": Part("sum", "monthly_mrr")}, lambda p: f"CAST({p['s']} AS DOUBLE)", '"$" #,##0', hidden=True)
SUM_LIFETIME_VALUE = Measure(
    "sum_lifetime_value", "Sum of lifetime_value",
    {"s": Part("sum", "lifetime_value")}, lambda p: f"CAST({p['s']} AS DOUBLE)", '"$" #,##0', hidden=True)

MEASURES: dict[str, Measure] = {m.name: m for m in
                                (TOTAL_MRR, CHURN_RATE, AVG_LTV, AVG_TENURE, AT_RISK_MRR,
                                 LTV_MRR_RATIO, TOTAL_MRR_ALL, SUM_SUBSCRIPTION_MONTHS,
                                 SUM_MONTHLY_MRR, SUM_LIFETIME_VALUE)}
IMPLICIT_SUMS = ("sum_subscription_months", "sum_monthly_mrr", "sum_lifetime_value")
CARD_MEASURES = ("total_mrr", "churn_rate", "avg_ltv", "avg_tenure_months", "at_risk_mrr",
                 "ltv_mrr_ratio")


def _part_agg(p: Part, cond: str | None) -> str:
    if p.kind == "sum":
        return f"sum(CASE WHEN {cond} THEN {p.value} END)" if cond else f"sum({p.value})"
    if p.kind == "count":
        if p.value is None:
            return f"count_if({cond})" if cond else "count(1)"
        return f"count(CASE WHEN {cond} THEN {p.value} END)" if cond else f"count({p.value})"
    raise ValueError(p.kind)


def _and(conds: Sequence[str]) -> str | None:
    conds = [c for c in conds if c]
    return " AND ".join(f"({c})" for c in conds) if conds else None


def _in_list(column: str, values: Sequence) -> str:
    items = ", ".join(sql_str(v) if isinstance(v, str) else repr(v) for v in values)
    return f"`{column}` IN ({items})"


def measure_query(facts: DataFrame, measures: Sequence[str | Measure], by: Sequence[str] = (),
                  slicer: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Evaluate ``measures`` per group of ``by`` under ``slicer`` (column -> allowed values).

    Output: the ``by`` columns, then one column per measure (named ``measure.name``).
    Groups are those with at least one row passing every slicer filter; without
    ``by`` there is always exactly one row.
    """
    ms = [MEASURES[m] if isinstance(m, str) else m for m in measures]
    slicer = dict(slicer or {})
    by = list(by)
    overridden = {c for m in ms for p in m.parts.values() for c in p.overrides}
    # Filters no part overrides go to a plain where (pushed down to the scan).
    pre = [_in_list(c, v) for c, v in slicer.items() if c not in overridden]
    embedded = {c: _in_list(c, v) for c, v in slicer.items() if c in overridden}
    df = facts.where(_and(pre)) if pre else facts

    aggs, coarser = [], {}
    for m in ms:
        for pname, p in m.parts.items():
            alias = f"_{m.name}__{pname}"
            cond = _and([p.where] + [e for c, e in embedded.items() if c not in p.overrides])
            aggs.append(F.expr(_part_agg(p, cond)).alias(alias))
            keep = [b for b in by if b not in p.overrides]
            if len(keep) < len(by):
                coarser[alias] = keep
    rows = f"count_if({_and(list(embedded.values()))})" if embedded else "count(1)"
    aggs.append(F.expr(rows).alias("_rows"))
    agg = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)

    # Coarser grain for parts that replace a grouping column's filter: a window
    # over the aggregated groups (small), not over the fact rows.
    def part_sql(alias: str) -> str:
        if alias not in coarser:
            return alias
        keys = ", ".join(f"`{k}`" for k in coarser[alias])
        return f"sum({alias}) OVER (PARTITION BY {keys})" if keys else f"sum({alias}) OVER ()"

    if coarser:
        agg = agg.select(*[F.col(f"`{b}`") for b in by], "_rows",
                         *[F.expr(part_sql(f"_{m.name}__{pn}")).alias(f"_{m.name}__{pn}")
                           for m in ms for pn in m.parts])
    outs = [F.col(f"`{b}`") for b in by]
    for m in ms:
        parts = {pname: f"_{m.name}__{pname}" for pname in m.parts}
        outs.append(F.expr(m.final(parts)).alias(m.name))
    # Groups without a row passing the slicer are hidden; an ungrouped query (a
    # card) always returns its one row, blank when nothing matches.
    return (agg.where("_rows > 0") if by else agg).select(*outs)
