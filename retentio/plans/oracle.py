"""DuckDB oracle SQL, one statement per registered query.

Each statement runs on the raw test tables (registered as views) and rebuilds
``subscriptions`` / ``exposures`` in a CTE with the fixture rules, written
independently of the Spark code. Rounding of doubles is spelled out as
floor(|x| * 10^d + 0.5) (half away from zero) or round_even (half to even) so
both engines evaluate the same IEEE operations.
"""

from __future__ import annotations

SUBSCRIPTIONS_CTE = """subscriptions AS (
SELECT CAST(c.c_custkey AS STRING) AS customer_id,
 CASE WHEN c.c_mktsegment IN ('BUILDING','FURNITURE') THEN 'Month-to-month'
      WHEN c.c_mktsegment IN ('HOUSEHOLD','MACHINERY') THEN 'One year' ELSE 'Two year' END AS plan_type,
 CASE c.c_nationkey % 4 WHEN 0 THEN 'Bank transfer' WHEN 1 THEN 'Credit card'
      WHEN 2 THEN 'Electronic check' ELSE 'Mailed check' END AS payment_method,
 CAST(COALESCE((year(f.last_f)*12+month(f.last_f))-(year(f.first_f)*12+month(f.first_f)),0) AS INT) AS subscription_months,
 CAST(abs(c.c_acctbal) AS DECIMAL(8,2)) AS monthly_mrr,
 f.ltv AS lifetime_value,
 CASE WHEN a.last_any < TIMESTAMP '2000-08-01 00:00:00' OR a.last_any IS NULL THEN 'Yes' ELSE 'No' END AS churned
FROM customer c
LEFT JOIN (SELECT o_custkey, min(o_orderdate) first_f, max(o_orderdate) last_f,
                  CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) ltv
           FROM orders WHERE o_orderstatus='F' GROUP BY o_custkey) f ON c.c_custkey=f.o_custkey
LEFT JOIN (SELECT o_custkey, max(o_orderdate) last_any FROM orders GROUP BY o_custkey) a ON c.c_custkey=a.o_custkey
)"""

EXPOSURES_CTE = """exposures AS (
SELECT visitor AS user_id, ts, event_id,
 CASE WHEN (visitor % 2 = 0) <> (event_id % 83 = 0) THEN 'control' ELSE 'treatment' END AS grp,
 CASE WHEN ((visitor % 2 = 0) <> (event_id % 83 = 0)) <> (event_id % 67 = 0) THEN 'old_page' ELSE 'new_page' END AS landing_page,
 CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS converted
FROM (SELECT *, user_id*100 + (event_id*31) % 100 AS visitor FROM events) e
)"""

PLAN_DIM_CTE = """dim_plan_type AS (
SELECT plan_type, CAST(plan_order AS BIGINT) AS plan_order, plan_label
FROM (VALUES ('Month-to-month', 1, 'Starter'), ('One year', 2, 'Growth'),
             ('Two year', 3, 'Enterprise')) AS t(plan_type, plan_order, plan_label)
)"""

# Report view of the facts: plan labels joined, half-open lifecycle stage.
REPORT_FACTS_CTE = """f AS (
SELECT s.*, d.plan_order, d.plan_label,
       CASE WHEN subscription_months < 6 THEN 'New (0-6mo)'
            WHEN subscription_months < 24 THEN 'Growing (6-24mo)' ELSE 'Mature (24mo+)' END AS lifecycle_stage
FROM subscriptions s LEFT JOIN dim_plan_type d ON s.plan_type = d.plan_type
)"""


def rha(e: str, d: int) -> str:
    """Half-away-from-zero rounding of a double expression to d decimals."""
    s = f"{10 ** d}.0"
    # "+ 0.0" turns a negative zero into 0.0 (Spark's integral FLOOR never gives -0.0)
    return (f"(CASE WHEN ({e}) < 0 THEN -floor(-({e}) * {s} + 0.5) / {s} + 0.0 "
            f"ELSE floor(({e}) * {s} + 0.5) / {s} END)")


def rhe(e: str, d: int) -> str:
    """Half-to-even rounding (numpy) of a double expression to d decimals."""
    s = f"{10 ** d}.0"
    return f"(round_even(CAST({e} AS DOUBLE) * {s}, 0) / {s})"


def rratio(num: str, den: str, d: int) -> str:
    """Exact half-away-from-zero rounding of num / den (integers) to d decimals."""
    s = 10 ** d
    dd = f"NULLIF(({den}), 0)"
    return (f"(CAST(CASE WHEN ({num}) < 0 THEN -((2 * -({num}) * {s} + {dd}) // (2 * {dd})) "
            f"ELSE (2 * ({num}) * {s} + {dd}) // (2 * {dd}) END AS DOUBLE) / {s}.0)")


def with_ctes(sql: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def subs(sql: str, *extra: str) -> str:
    return with_ctes(sql, SUBSCRIPTIONS_CTE, *extra)


def expo(sql: str, *extra: str) -> str:
    return with_ctes(sql, EXPOSURES_CTE, *extra)


STAGE_CLOSED = ("CASE WHEN subscription_months <= 6 THEN 'new' "
                "WHEN subscription_months <= 24 THEN 'growing' ELSE 'mature' END")

ORACLE: dict[str, str] = {}

# --- the query file's reports -------------------------------------------------

ORACLE["customers_by_plan"] = subs("""
SELECT plan_type, COUNT(*) AS customer_count FROM subscriptions
GROUP BY plan_type ORDER BY customer_count DESC""")

ORACLE["mrr_by_plan_all"] = subs(f"""
SELECT plan_type, COUNT(*) AS customers,
       CAST(ROUND(SUM(monthly_mrr), 0) AS DOUBLE) AS total_mrr,
       {rratio("CAST(SUM(monthly_mrr) * 100 AS HUGEINT)", "COUNT(monthly_mrr) * 100", 2)} AS avg_mrr_per_customer
FROM subscriptions GROUP BY plan_type ORDER BY total_mrr DESC""")

ORACLE["newest_customers"] = subs("""
SELECT customer_id, plan_type, subscription_months, CAST(monthly_mrr AS DOUBLE) AS monthly_mrr, churned
FROM subscriptions WHERE subscription_months <= 6
ORDER BY subscription_months ASC, monthly_mrr DESC NULLS FIRST, customer_id ASC LIMIT 20""")

ORACLE["lifecycle_stage_rows"] = subs(f"""
SELECT customer_id, subscription_months, CAST(monthly_mrr AS DOUBLE) AS monthly_mrr, churned,
       {STAGE_CLOSED} AS lifecycle_stage
FROM subscriptions ORDER BY subscription_months""")

ORACLE["churn_by_lifecycle"] = subs(f"""
SELECT lifecycle_stage, COUNT(*) AS customers,
       CAST(SUM(CASE WHEN churned = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS churned_count,
       {rratio("SUM(CASE WHEN churned = 'Yes' THEN 1 ELSE 0 END) * 100", "COUNT(*)", 1)} AS churn_rate_pct
FROM (SELECT {STAGE_CLOSED} AS lifecycle_stage, churned FROM subscriptions) s
GROUP BY lifecycle_stage ORDER BY churn_rate_pct DESC""")

ORACLE["ltv_by_lifecycle_vs_overall"] = subs(f"""
SELECT stage, customers, {rratio("s", "customers * 100", 2)} AS avg_ltv, {rratio("t", "m * 100", 2)} AS overall_avg_ltv,
       {rratio("s * m - t * customers", "customers * m * 100", 2)} AS delta_vs_overall
FROM (SELECT stage, customers, s, CAST(SUM(s) OVER () AS HUGEINT) AS t, CAST(SUM(customers) OVER () AS HUGEINT) AS m
      FROM (SELECT {STAGE_CLOSED} AS stage, COUNT(lifetime_value) AS customers,
                   CAST(SUM(lifetime_value) * 100 AS HUGEINT) AS s
            FROM subscriptions WHERE lifetime_value IS NOT NULL GROUP BY 1) per_stage) with_totals
ORDER BY avg_ltv DESC""")

ORACLE["high_value_churned"] = subs("""
SELECT customer_id, plan_type, subscription_months, CAST(monthly_mrr AS DOUBLE) AS monthly_mrr,
       CAST(lifetime_value AS DOUBLE) AS lifetime_value
FROM subscriptions
WHERE churned = 'Yes'
  AND monthly_mrr * (SELECT COUNT(monthly_mrr) FROM subscriptions) > (SELECT SUM(monthly_mrr) FROM subscriptions)
ORDER BY monthly_mrr DESC, customer_id LIMIT 25""")

# A customer's rank is one more than the number of churned customers of the plan who pay more (a null
# price is above all, as PostgreSQL sorts it).
_TOP_CHURNED = """
SELECT c.customer_id, c.plan_type, c.subscription_months, CAST(c.monthly_mrr AS DOUBLE) AS monthly_mrr,
       CAST(1 + (SELECT COUNT(*) FROM subscriptions o
                 WHERE o.churned = 'Yes' AND o.plan_type IS NOT DISTINCT FROM c.plan_type
                   AND (o.monthly_mrr > c.monthly_mrr OR (o.monthly_mrr IS NULL AND c.monthly_mrr IS NOT NULL))) AS INTEGER)
         AS mrr_rank_within_plan
FROM subscriptions c WHERE c.churned = 'Yes' AND mrr_rank_within_plan <= 5"""
ORACLE["top_churned_by_plan"] = subs(_TOP_CHURNED)

ORACLE["ab_summary"] = expo(f"""
SELECT grp AS test_group, landing_page, COUNT(*) AS users,
       CAST(SUM(converted) AS BIGINT) AS conversions,
       {rratio("SUM(converted) * 100", "COUNT(*)", 2)} AS conversion_rate_pct
FROM exposures GROUP BY grp, landing_page ORDER BY grp, landing_page""")


def report(sql: str, *extra: str) -> str:
    return with_ctes(sql, SUBSCRIPTIONS_CTE, PLAN_DIM_CTE, REPORT_FACTS_CTE, *extra)


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def bi_churn(of: str = "TRUE") -> str:
    """The report's churn rate of the rows ``of``: blank, not 0, where no row is churned."""
    yes = f"COUNT(*) FILTER (WHERE {of} AND churned = 'Yes')"
    return f"""CASE WHEN {yes} > 0 THEN {div(yes, f"COUNT(*) FILTER (WHERE {of})")} END"""


CARD_SELECT = f"""
  CAST(SUM(monthly_mrr) FILTER (WHERE churned = 'No') AS DOUBLE) AS total_mrr,
  {bi_churn()} AS churn_rate,
  {div("SUM(lifetime_value)", "COUNT(lifetime_value)")} AS avg_ltv,
  {div("SUM(subscription_months) FILTER (WHERE churned = 'No')",
       "COUNT(subscription_months) FILTER (WHERE churned = 'No')")} AS avg_tenure_months,
  CAST(SUM(monthly_mrr) FILTER (WHERE churned = 'No' AND subscription_months < 6) AS DOUBLE) AS at_risk_mrr,
  ({div("SUM(lifetime_value)", "COUNT(lifetime_value)")} / {div("SUM(monthly_mrr)", "COUNT(monthly_mrr)")}) AS ltv_mrr_ratio,
  CAST(SUM(monthly_mrr) AS DOUBLE) AS total_mrr_all"""

# --- report visuals -----------------------------------------------------------

ORACLE["kpi_cards"] = report(f"SELECT {CARD_SELECT} FROM f")

ORACLE["kpi_cards_sliced"] = report(f"SELECT {CARD_SELECT} FROM f WHERE plan_label IN ('Starter', 'Enterprise')")

ORACLE["measure_override_by_status"] = report(f"""
SELECT plan_label, churned,
  CAST(SUM(mrr_active) OVER (PARTITION BY plan_label) AS DOUBLE) AS total_mrr,
  CASE WHEN n_yes > 0 THEN {div("n_yes", "n")} END AS churn_rate,
  {div("ltv_s", "ltv_n")} AS avg_ltv,
  {div("SUM(ten_s) OVER (PARTITION BY plan_label)", "SUM(ten_n) OVER (PARTITION BY plan_label)")} AS avg_tenure_months,
  CAST(SUM(risk) OVER (PARTITION BY plan_label) AS DOUBLE) AS at_risk_mrr,
  ({div("ltv_s", "ltv_n")} / {div("mrr_s", "mrr_n")}) AS ltv_mrr_ratio
FROM g""", """g AS (
SELECT plan_label, churned,
  SUM(monthly_mrr) FILTER (WHERE churned = 'No') AS mrr_active,
  COUNT(*) FILTER (WHERE churned = 'Yes') AS n_yes, COUNT(*) AS n,
  SUM(lifetime_value) AS ltv_s, COUNT(lifetime_value) AS ltv_n,
  SUM(subscription_months) FILTER (WHERE churned = 'No') AS ten_s,
  COUNT(subscription_months) FILTER (WHERE churned = 'No') AS ten_n,
  SUM(monthly_mrr) FILTER (WHERE churned = 'No' AND subscription_months < 6) AS risk,
  SUM(monthly_mrr) AS mrr_s, COUNT(monthly_mrr) AS mrr_n
FROM f GROUP BY plan_label, churned)""")

def _bars_mrr(where: str = "") -> str:
    """A bar per label of the dimension, and one for facts without a label where there are any."""
    mrr = "SELECT CAST(SUM(monthly_mrr) FILTER (WHERE churned = 'No') AS DOUBLE) FROM f WHERE"
    return report(f"""
SELECT plan_label, plan_order_count, total_mrr,
  'Active subscriber revenue only. Churned customers are excluded from this total.' AS tooltip
FROM (
  SELECT d.plan_label, COUNT(d.plan_order) AS plan_order_count, ({mrr} f.plan_label = d.plan_label) AS total_mrr
  FROM dim_plan_type d {where} GROUP BY d.plan_label
  UNION ALL
  SELECT NULL, NULL, ({mrr} f.plan_label IS NULL)
  WHERE EXISTS (SELECT 1 FROM f WHERE plan_label IS NULL) AND {'FALSE' if where else 'TRUE'}) x
ORDER BY total_mrr DESC NULLS LAST""")


ORACLE["bars_mrr_by_label"] = _bars_mrr()
ORACLE["bars_mrr_sliced"] = _bars_mrr("WHERE d.plan_label IN ('Starter', 'Enterprise')")

BAND_SQL = ("CASE WHEN churn_rate >= 0.3::DOUBLE AND churn_rate <= 1 THEN 'high' "
            "WHEN churn_rate >= 0.15::DOUBLE AND churn_rate < 0.3::DOUBLE THEN 'medium' "
            "WHEN churn_rate >= 0 AND churn_rate < 0.15::DOUBLE THEN 'low' END")
COLOR_SQL = ("CASE band WHEN 'high' THEN '#6F1010' WHEN 'medium' THEN '#575423' "
             "WHEN 'low' THEN '#1A4A2D' END")


def _bars_churn(category: str) -> str:
    return report(f"""
SELECT {category}, churn_rate, band, {COLOR_SQL} AS color FROM (
  SELECT {category}, churn_rate, {BAND_SQL} AS band FROM (
    SELECT {category}, {bi_churn()} AS churn_rate
    FROM f GROUP BY {category}) x) y
ORDER BY churn_rate DESC NULLS LAST""")


ORACLE["bars_churn_by_stage_bi"] = _bars_churn("lifecycle_stage")
ORACLE["bars_churn_by_label_bi"] = _bars_churn("plan_label")
ORACLE["bars_churn_by_payment_bi"] = _bars_churn("payment_method")

ORACLE["stage_plan_matrix"] = report(f"""
SELECT lifecycle_stage,
  {bi_churn("plan_label = 'Starter'")} AS "Starter",
  {bi_churn("plan_label = 'Growth'")} AS "Growth",
  {bi_churn("plan_label = 'Enterprise'")} AS "Enterprise",
  {bi_churn("plan_label IS NULL")} AS "(Blank)"
FROM f GROUP BY lifecycle_stage""")

ORACLE["tenure_mrr_scatter"] = subs(f"""
SELECT subscription_months, churned, {div("SUM(monthly_mrr)", "COUNT(monthly_mrr)")} AS avg_mrr,
       COUNT(customer_id) AS customers
FROM subscriptions GROUP BY subscription_months, churned""")

def _gauge(where: str = "") -> str:
    return report(f"""
SELECT churn_rate, 0.0::DOUBLE AS gauge_min, 0.5::DOUBLE AS gauge_max, 0.2::DOUBLE AS target,
  CASE WHEN churn_rate >= 0.2::DOUBLE THEN 'alert' ELSE 'ok' END AS status,
  '% of all customers (active + churned) who have cancelled. Baseline health indicator.' AS tooltip
FROM (SELECT {bi_churn()} AS churn_rate FROM f {where}) x""")


ORACLE["churn_gauge"] = _gauge()
ORACLE["churn_gauge_sliced"] = _gauge("WHERE plan_label IN ('Starter', 'Enterprise')")

# --- workbook tables ----------------------------------------------------------

ORACLE["workbook_raw_data"] = subs("""
SELECT customer_id, plan_type, subscription_months, CAST(monthly_mrr AS DOUBLE) AS monthly_mrr,
       CAST(lifetime_value AS DOUBLE) AS lifetime_value, churned, payment_method,
       CASE WHEN subscription_months < 6 THEN 'New (0-6mo)'
            WHEN subscription_months < 24 THEN 'Growing (6-24mo)' ELSE 'Mature (24mo+)' END AS lifecycle_stage
FROM subscriptions ORDER BY customer_id""")


def _kpi_display(v: str, fmt: str) -> str:
    if fmt == "$#,##0":
        return f"'$' || format('{{:,.0f}}', {rha(v, 0)})"
    if fmt == "0.00%":
        return f"format('{{:,.2f}}', {rha(v + ' * 100.0', 2)}) || '%'"
    return f"format('{{:,.1f}}', {rha(v, 1)})"


_KPI_VALUES = [
    ("Total MRR (Active)", "$#,##0", "CAST(active_mrr AS DOUBLE)"),
    ("Churn Rate %", "0.00%", div("n_yes", "n")),
    ("Avg LTV", "$#,##0", div("ltv_s", "ltv_n")),
    ("Avg Tenure Months", "0.0", div("ten_s", "ten_n")),
    ("At-Risk MRR", "$#,##0", "CAST(risk_mrr AS DOUBLE)"),
    ("LTV MRR Ratio", "0.0", f"({div('ltv_s', 'ltv_n')} / {div('mrr_s', 'mrr_n')})"),
]
ORACLE["kpi_block"] = subs(
    "SELECT row_order, metric, value, number_format, display FROM (\n" + "\nUNION ALL\n".join(
        f"SELECT {i + 1} AS row_order, '{label}' AS metric, {v} AS value, '{fmt}' AS number_format, "
        f"{_kpi_display(v, fmt)} AS display FROM a"
        for i, (label, fmt, v) in enumerate(_KPI_VALUES)) + ") k ORDER BY row_order",
    """a AS (SELECT
  SUM(monthly_mrr) FILTER (WHERE churned = 'No') AS active_mrr,
  COUNT(*) FILTER (WHERE churned = 'Yes') AS n_yes, COUNT(*) AS n,
  SUM(lifetime_value) AS ltv_s, COUNT(lifetime_value) AS ltv_n,
  SUM(subscription_months) FILTER (WHERE churned = 'No') AS ten_s,
  COUNT(subscription_months) FILTER (WHERE churned = 'No') AS ten_n,
  SUM(monthly_mrr) FILTER (WHERE churned = 'No' AND subscription_months < 6) AS risk_mrr,
  SUM(monthly_mrr) AS mrr_s, COUNT(monthly_mrr) AS mrr_n
FROM subscriptions)""")

ORACLE["active_mrr_by_plan_label"] = subs("""
SELECT d.plan_order, d.plan_label, CAST(a.s AS DOUBLE) AS total_mrr
FROM (SELECT plan_type, SUM(monthly_mrr) AS s FROM subscriptions WHERE churned = 'No' GROUP BY plan_type) a
LEFT JOIN dim_plan_type d ON a.plan_type = d.plan_type ORDER BY d.plan_order""", PLAN_DIM_CTE)

ORACLE["churn_by_plan_label"] = subs(f"""
SELECT d.plan_order, d.plan_label, a.churn_rate
FROM (SELECT plan_type, {div("COUNT(*) FILTER (WHERE churned = 'Yes')", "COUNT(*)")} AS churn_rate
      FROM subscriptions GROUP BY plan_type) a
LEFT JOIN dim_plan_type d ON a.plan_type = d.plan_type ORDER BY d.plan_order""", PLAN_DIM_CTE)

# LTV bins with the fixture edges 0, 200K, 400K, 600K, 1M, 2M, 3M.
ORACLE["ltv_distribution"] = subs("""
SELECT b.bin_order, b.ltv_range, COALESCE(c.customers, 0) AS customers
FROM (VALUES (1, '$0-200K'), (2, '$200K-400K'), (3, '$400K-600K'), (4, '$600K-1M'),
             (5, '$1M-2M'), (6, '$2M+')) AS b(bin_order, ltv_range)
LEFT JOIN (SELECT bin_order, COUNT(*) AS customers FROM (
  SELECT CASE WHEN lifetime_value >= 0 AND lifetime_value <= 200000 THEN 1
              WHEN lifetime_value > 200000 AND lifetime_value <= 400000 THEN 2
              WHEN lifetime_value > 400000 AND lifetime_value <= 600000 THEN 3
              WHEN lifetime_value > 600000 AND lifetime_value <= 1000000 THEN 4
              WHEN lifetime_value > 1000000 AND lifetime_value <= 2000000 THEN 5
              WHEN lifetime_value > 2000000 AND lifetime_value <= 3000000 THEN 6 END AS bin_order
  FROM subscriptions WHERE lifetime_value IS NOT NULL) x
  WHERE bin_order IS NOT NULL GROUP BY bin_order) c ON b.bin_order = c.bin_order
ORDER BY b.bin_order""")

ORACLE["plan_dimension_usage"] = subs("""
SELECT d.plan_type, d.plan_order, d.plan_label, COALESCE(c.customers, 0) AS customers
FROM dim_plan_type d LEFT JOIN (SELECT plan_type, COUNT(*) AS customers FROM subscriptions GROUP BY plan_type) c
  ON d.plan_type = c.plan_type ORDER BY d.plan_order""", PLAN_DIM_CTE)

# --- KPI notebook -------------------------------------------------------------

ORACLE["mrr_by_plan_nb"] = subs(f"""
SELECT plan_type, COUNT(customer_id) AS customers, CAST(SUM(monthly_mrr) AS DOUBLE) AS total_mrr,
       {div("SUM(monthly_mrr)", "COUNT(monthly_mrr)")} AS avg_mrr
FROM subscriptions GROUP BY plan_type ORDER BY total_mrr DESC""")


def _churn_counts(key: str, source: str = "subscriptions") -> str:
    return (f"SELECT {key}, CAST(SUM(CASE WHEN churned = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS churned, "
            f"COUNT(*) AS total, {div('SUM(CASE WHEN churned = ' + chr(39) + 'Yes' + chr(39) + ' THEN 1 ELSE 0 END)', 'COUNT(*)')} AS churn_rate "
            f"FROM {source} GROUP BY {key}")


ORACLE["churn_by_plan_banded"] = subs(f"""
SELECT *, CASE WHEN churn_rate > 0.3::DOUBLE THEN 'high' WHEN churn_rate > 0.15::DOUBLE THEN 'medium' ELSE 'low' END AS risk_band
FROM ({_churn_counts("plan_type")}) x ORDER BY churn_rate DESC""")

ORACLE["churn_by_payment_banded"] = subs(f"""
SELECT *, CASE WHEN churn_rate > 0.3::DOUBLE THEN 'high' WHEN churn_rate > 0.2::DOUBLE THEN 'medium' ELSE 'low' END AS risk_band
FROM ({_churn_counts("payment_method")}) x ORDER BY churn_rate ASC""")

ORACLE["churn_by_lifecycle_nb"] = subs(f"""
{_churn_counts("lifecycle_stage", "staged")} ORDER BY lifecycle_stage""",
    """staged AS (SELECT churned, CASE WHEN subscription_months > -1 AND subscription_months <= 6 THEN 'new (0-6mo)'
                                   WHEN subscription_months > 6 AND subscription_months <= 24 THEN 'growing (7-24mo)'
                                   WHEN subscription_months > 24 AND subscription_months <= 999 THEN 'mature (25mo+)' END AS lifecycle_stage
              FROM subscriptions WHERE subscription_months > -1 AND subscription_months <= 999)""")

TENURE_SQL = [("0-6", 1, "subscription_months >= 0 AND subscription_months <= 6"),
              ("7-12", 2, "subscription_months > 6 AND subscription_months <= 12"),
              ("13-18", 3, "subscription_months > 12 AND subscription_months <= 18"),
              ("19-24", 4, "subscription_months > 18 AND subscription_months <= 24"),
              ("25-36", 5, "subscription_months > 24 AND subscription_months <= 36"),
              ("37-48", 6, "subscription_months > 36 AND subscription_months <= 48"),
              ("49-60", 7, "subscription_months > 48 AND subscription_months <= 60"),
              ("60+", 8, "subscription_months > 60 AND subscription_months <= 999")]
BUCKETED_CTE = ("bucketed AS (SELECT plan_type, churned, CASE "
                + " ".join(f"WHEN {c} THEN '{lab}'" for lab, _, c in TENURE_SQL) + " END AS tenure_bucket, CASE "
                + " ".join(f"WHEN {c} THEN {o}" for _, o, c in TENURE_SQL)
                + " END AS bucket_order FROM subscriptions WHERE subscription_months >= 0 AND subscription_months <= 999)")


def _pct(yes: str, total: str) -> str:
    return rhe(f"{div(yes, total)} * 100.0", 1)


ORACLE["cohort_retention_long"] = subs(f"""
SELECT tenure_bucket, bucket_order, plan_type, churn_pct, 100.0::DOUBLE - churn_pct AS retention_pct FROM (
  SELECT tenure_bucket, bucket_order, plan_type,
         {_pct("COUNT(*) FILTER (WHERE churned = 'Yes')", "COUNT(*)")} AS churn_pct
  FROM bucketed GROUP BY tenure_bucket, bucket_order, plan_type) x
ORDER BY bucket_order, plan_type""", BUCKETED_CTE)

ORACLE["cohort_churn_matrix"] = subs("SELECT tenure_bucket, bucket_order, " + ", ".join(
    f"""{_pct(f"COUNT(*) FILTER (WHERE plan_type = '{p}' AND churned = 'Yes')", f"COUNT(*) FILTER (WHERE plan_type = '{p}')")} AS "{p}" """
    for p in ("Month-to-month", "One year", "Two year"))
    + " FROM bucketed GROUP BY tenure_bucket, bucket_order ORDER BY bucket_order", BUCKETED_CTE)

ORACLE["cohort_retention_matrix"] = subs("SELECT plan_type, " + ", ".join(
    f"""100.0::DOUBLE - {_pct(f"COUNT(*) FILTER (WHERE tenure_bucket = '{lab}' AND churned = 'Yes')", f"COUNT(*) FILTER (WHERE tenure_bucket = '{lab}')")} AS "{lab}" """
    for lab, _, _ in TENURE_SQL)
    + " FROM bucketed GROUP BY plan_type ORDER BY plan_type", BUCKETED_CTE)

ORACLE["ltv_stats_by_plan"] = subs(f"""
SELECT plan_type,
  {rhe("quantile_cont(CAST(lifetime_value AS DOUBLE), 0.5)", 2)} AS median,
  {rhe(div("SUM(lifetime_value)", "COUNT(lifetime_value)"), 2)} AS mean,
  {rhe("stddev_samp(CAST(lifetime_value AS DOUBLE))", 2)} AS std,
  COUNT(lifetime_value) AS count
FROM subscriptions WHERE lifetime_value IS NOT NULL GROUP BY plan_type ORDER BY plan_type""")

ORACLE["ltv_histogram_by_plan"] = subs("""
SELECT plan_type, bin, lo + (hi - lo) * (bin - 1) / 40.0 AS bin_start, lo + (hi - lo) * bin / 40.0 AS bin_end,
       COUNT(*) AS customers
FROM (SELECT plan_type, lo, hi, CAST(least(40, floor((v - lo) * 40.0 / (hi - lo)) + 1) AS INTEGER) AS bin
      FROM (SELECT s.plan_type, CAST(s.lifetime_value AS DOUBLE) AS v,
                   CASE WHEN r.mx = r.mn THEN r.mn - 0.5 ELSE r.mn END AS lo,
                   CASE WHEN r.mx = r.mn THEN r.mx + 0.5 ELSE r.mx END AS hi
            FROM subscriptions s JOIN (SELECT plan_type, min(CAST(lifetime_value AS DOUBLE)) AS mn,
                                              max(CAST(lifetime_value AS DOUBLE)) AS mx
                                       FROM subscriptions WHERE lifetime_value IS NOT NULL GROUP BY plan_type) r
              ON s.plan_type = r.plan_type
            WHERE s.lifetime_value IS NOT NULL) a) b
GROUP BY plan_type, bin, lo, hi ORDER BY plan_type, bin""")

ORACLE["class_balance"] = subs(f"""
SELECT churned, customers, {div("customers", "SUM(customers) OVER ()")} AS share
FROM (SELECT churned, COUNT(*) AS customers FROM subscriptions GROUP BY churned) x""")


def _describe_row(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS field, COUNT({c}) AS count, {rhe(div(f'SUM({c})', f'COUNT({c})'), 2)} AS mean, "
            f"{rhe(f'stddev_samp({v})', 2)} AS std, {rhe(f'min({v})', 2)} AS min, "
            f"{rhe(f'quantile_cont({v}, 0.25)', 2)} AS p25, {rhe(f'quantile_cont({v}, 0.5)', 2)} AS p50, "
            f"{rhe(f'quantile_cont({v}, 0.75)', 2)} AS p75, {rhe(f'max({v})', 2)} AS max FROM subscriptions")


ORACLE["numeric_describe"] = subs("\nUNION ALL\n".join(
    _describe_row(c) for c in ("subscription_months", "monthly_mrr", "lifetime_value")))

ORACLE["missing_counts"] = subs("SELECT column_name, n_missing FROM (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM subscriptions"
    for c in ("customer_id", "plan_type", "payment_method", "subscription_months", "monthly_mrr",
              "lifetime_value", "churned")) + ") x WHERE n_missing > 0")

ORACLE["arm_values"] = expo("""
SELECT DISTINCT column_name, value FROM (
  SELECT 'grp' AS column_name, CAST(grp AS VARCHAR) AS value FROM exposures
  UNION ALL SELECT 'landing_page', CAST(landing_page AS VARCHAR) FROM exposures
  UNION ALL SELECT 'converted', CAST(converted AS VARCHAR) FROM exposures) x
ORDER BY column_name, value""")

ORACLE["date_range"] = expo("""
SELECT COUNT(*) AS rows, strftime(min(ts), '%Y-%m-%d') AS start_date, strftime(max(ts), '%Y-%m-%d') AS end_date
FROM exposures""")

# --- experiment notebook ------------------------------------------------------

import math  # noqa: E402
from statistics import NormalDist  # noqa: E402


def dbl(x: float) -> str:
    """An exact double literal (parsed from its shortest text)."""
    return f"CAST('{x!r}' AS DOUBLE)"


ALIGNED_SQL = "((grp = 'control' AND landing_page = 'old_page') OR (grp = 'treatment' AND landing_page = 'new_page'))"
MISALIGNED_SQL = "((grp = 'control' AND landing_page = 'new_page') OR (grp = 'treatment' AND landing_page = 'old_page'))"
CLEANED_CTE = f"""cleaned AS (
SELECT user_id, ts, event_id, grp, landing_page, converted FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id NULLS LAST) AS rn
  FROM exposures WHERE {ALIGNED_SQL}) x WHERE rn = 1)"""
ARMS_CTE = """arms AS (
SELECT n_ctrl, conv_ctrl, n_treat, conv_treat,
       CAST(conv_ctrl AS DOUBLE) / CAST(n_ctrl AS DOUBLE) AS p_ctrl,
       CAST(conv_treat AS DOUBLE) / CAST(n_treat AS DOUBLE) AS p_treat
FROM (SELECT COUNT(*) FILTER (WHERE grp = 'control') AS n_ctrl,
             CAST(SUM(converted) FILTER (WHERE grp = 'control') AS BIGINT) AS conv_ctrl,
             COUNT(*) FILTER (WHERE grp = 'treatment') AS n_treat,
             CAST(SUM(converted) FILTER (WHERE grp = 'treatment') AS BIGINT) AS conv_treat
      FROM cleaned) c)"""

ORACLE["ab_group_rates"] = expo(f"""
SELECT grp, landing_page, COUNT(user_id) AS users, CAST(SUM(converted) AS BIGINT) AS conversions,
       {rhe(div("SUM(converted)", "COUNT(user_id)"), 4)} AS rate
FROM exposures GROUP BY grp, landing_page ORDER BY grp, landing_page""")

ORACLE["split_check"] = expo("""
SELECT grp, n, share, CASE WHEN abs(share - 0.5) < 0.01 THEN 'OK' ELSE 'WARNING — not 50/50!' END AS status
FROM (SELECT grp, n, CAST(n AS DOUBLE) / CAST(SUM(n) OVER () AS DOUBLE) AS share
      FROM (SELECT grp, COUNT(*) AS n FROM exposures GROUP BY grp) a) b ORDER BY grp""")

ORACLE["contamination_check"] = expo("""
SELECT users, contaminated_users,
  CASE WHEN contaminated_users > 0 THEN 'ACTION: These users should be removed before analysis.'
       ELSE 'Status: OK — no cross-group contamination' END AS status
FROM (SELECT COUNT(*) AS users, COUNT(*) FILTER (WHERE both_arms) AS contaminated_users
      FROM (SELECT user_id, min(grp) <> max(grp) AS both_arms FROM exposures
            WHERE grp IS NOT NULL GROUP BY user_id) u) x""")

ORACLE["alignment_crosstab"] = expo("""
SELECT grp, COUNT(*) FILTER (WHERE landing_page = 'new_page') AS new_page,
       COUNT(*) FILTER (WHERE landing_page = 'old_page') AS old_page
FROM exposures WHERE grp IS NOT NULL AND landing_page IS NOT NULL GROUP BY grp ORDER BY grp""")

ORACLE["misaligned_summary"] = expo(f"""
SELECT misaligned_rows, total_rows, {div("misaligned_rows", "total_rows")} AS share
FROM (SELECT COUNT(*) FILTER (WHERE {MISALIGNED_SQL}) AS misaligned_rows, COUNT(*) AS total_rows FROM exposures) x""")

ORACLE["misaligned_breakdown"] = expo(f"""
SELECT grp, landing_page, COUNT(*) AS n FROM exposures WHERE {MISALIGNED_SQL}
GROUP BY grp, landing_page ORDER BY grp, landing_page""")

ORACLE["ab_clean_counts"] = expo("""
SELECT b.rows_before, a.rows_after, b.rows_before - a.rows_after AS removed
FROM (SELECT COUNT(*) AS rows_before FROM exposures) b, (SELECT COUNT(*) AS rows_after FROM cleaned) a""",
    CLEANED_CTE)

ORACLE["ab_clean_summary"] = expo(f"""
SELECT grp, COUNT(converted) AS n, CAST(SUM(converted) AS BIGINT) AS conversions,
       {rhe(div("SUM(converted)", "COUNT(converted)"), 4)} AS rate
FROM cleaned GROUP BY grp ORDER BY grp""", CLEANED_CTE)

_ALPHA, _POWER, _MDE, _CI = 0.05, 0.80, 0.02, 0.95
_ZA = NormalDist().inv_cdf(1 - _ALPHA / 2)
_ZB = NormalDist().inv_cdf(_POWER)
_ZC = NormalDist().inv_cdf(1 - (1 - _CI) / 2)
_K = 2.0 * (_ZA + _ZB) * (_ZA + _ZB)
_M = _MDE * _MDE
_SQRT2 = math.sqrt(2.0)


def _erfc(x: str) -> str:
    t = f"(1.0 / (1.0 + {dbl(0.3275911)} * ({x})))"
    a1, a2, a3, a4, a5 = (dbl(v) for v in (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))
    return f"({t} * ({a1} + {t} * ({a2} + {t} * ({a3} + {t} * ({a4} + {t} * {a5})))) * exp(-(({x}) * ({x}))))"


STATS_CTE = f"""st AS (
SELECT *,
  (p_treat - p_ctrl) * 100.0 AS lift_pp,
  (p_treat / p_ctrl - 1.0) * 100.0 AS relative_change_pct,
  ceil({dbl(_K)} * p_ctrl * (1.0 - p_ctrl) / {dbl(_M)}) AS n_req,
  (p_treat - p_ctrl) / sqrt(pool * (1.0 - pool) * (1.0 / CAST(n_treat AS DOUBLE) + 1.0 / CAST(n_ctrl AS DOUBLE))) AS z,
  2.0 * asin(sqrt(p_treat)) - 2.0 * asin(sqrt(p_ctrl)) AS h,
  greatest(0.0, p_ctrl - {dbl(_ZC)} * sqrt(p_ctrl * (1.0 - p_ctrl) / CAST(n_ctrl AS DOUBLE))) AS ci_ctrl_low,
  least(1.0, p_ctrl + {dbl(_ZC)} * sqrt(p_ctrl * (1.0 - p_ctrl) / CAST(n_ctrl AS DOUBLE))) AS ci_ctrl_high,
  greatest(0.0, p_treat - {dbl(_ZC)} * sqrt(p_treat * (1.0 - p_treat) / CAST(n_treat AS DOUBLE))) AS ci_treat_low,
  least(1.0, p_treat + {dbl(_ZC)} * sqrt(p_treat * (1.0 - p_treat) / CAST(n_treat AS DOUBLE))) AS ci_treat_high,
  (p_treat - p_ctrl) - {dbl(_ZC)} * sqrt(p_ctrl * (1.0 - p_ctrl) / CAST(n_ctrl AS DOUBLE) + p_treat * (1.0 - p_treat) / CAST(n_treat AS DOUBLE)) AS ci_diff_low,
  (p_treat - p_ctrl) + {dbl(_ZC)} * sqrt(p_ctrl * (1.0 - p_ctrl) / CAST(n_ctrl AS DOUBLE) + p_treat * (1.0 - p_treat) / CAST(n_treat AS DOUBLE)) AS ci_diff_high,
  10000.0 * p_ctrl AS conversions_ctrl_month,
  10000.0 * p_treat AS conversions_treat_month,
  10000.0 * p_treat - 10000.0 * p_ctrl AS delta_conversions_month,
  (10000.0 * p_treat - 10000.0 * p_ctrl) * 65.0 AS delta_mrr_month
FROM (SELECT *, (CAST(conv_treat AS DOUBLE) + CAST(conv_ctrl AS DOUBLE)) / (CAST(n_treat AS DOUBLE) + CAST(n_ctrl AS DOUBLE)) AS pool
      FROM arms) a),
st2 AS (SELECT *, {_erfc(f"abs(z) / {dbl(_SQRT2)}")} AS pv FROM st)"""

_H_LABEL = ("CASE WHEN abs(h) < 0.2 THEN 'negligible' WHEN abs(h) < 0.5 THEN 'small' "
            "WHEN abs(h) < 0.8 THEN 'medium' ELSE 'large' END")
_VERDICT = "CASE WHEN pv >= 0.05 OR p_treat < p_ctrl THEN 'DO NOT ROLL OUT' ELSE 'ROLL OUT' END"

ORACLE["ab_test_stats"] = expo(f"""
SELECT n_ctrl, conv_ctrl, {rha("p_ctrl", 6)} AS p_ctrl, n_treat, conv_treat, {rha("p_treat", 6)} AS p_treat,
  {rha("lift_pp", 6)} AS lift_pp, {rha("relative_change_pct", 6)} AS relative_change_pct,
  CAST(n_req AS BIGINT) AS n_required, n_ctrl >= n_req AS powered,
  {rha("CAST(n_ctrl AS DOUBLE) / n_req", 6)} AS power_ratio,
  {rha("z", 6)} AS z_stat, {rha("pv", 4)} AS p_value, pv < 0.05 AS significant,
  {rha("h", 6)} AS cohen_h, {_H_LABEL} AS effect_size,
  {rha("ci_ctrl_low", 6)} AS ci_ctrl_low, {rha("ci_ctrl_high", 6)} AS ci_ctrl_high,
  {rha("ci_treat_low", 6)} AS ci_treat_low, {rha("ci_treat_high", 6)} AS ci_treat_high,
  {rha("ci_diff_low", 6)} AS ci_diff_low, {rha("ci_diff_high", 6)} AS ci_diff_high,
  {rha("conversions_ctrl_month", 6)} AS conversions_ctrl_month,
  {rha("conversions_treat_month", 6)} AS conversions_treat_month,
  {rha("delta_conversions_month", 6)} AS delta_conversions_month,
  {rha("delta_mrr_month", 6)} AS delta_mrr_month,
  {_VERDICT} AS verdict
FROM st2""", CLEANED_CTE, ARMS_CTE, STATS_CTE)


def _signed(x: str, d: int) -> str:
    r = rha(x, d)
    return f"(CASE WHEN {r} >= 0 THEN '+' ELSE '' END || format('{{:,.{d}f}}', {r}))"


def _rate_text(p: str, conv: str, n: str) -> str:
    return (f"format('{{:,.2f}}', {rha(p + ' * 100.0', 2)}) || '% (' || format('{{:,}}', {conv}) "
            f"|| ' / ' || format('{{:,}}', {n}) || ' users)'")


_REPORT_LINES = [
    ("Experiment", "'New onboarding landing page vs. old page'"),
    ("Control rate", _rate_text("p_ctrl", "conv_ctrl", "n_ctrl")),
    ("Treatment rate", _rate_text("p_treat", "conv_treat", "n_treat")),
    ("Difference", f"{_signed('lift_pp', 3)} || ' pp  (95% CI: [' || {_signed('ci_diff_low * 100.0', 2)} "
                   f"|| ', ' || {_signed('ci_diff_high * 100.0', 2)} || '] pp)'"),
    ("P-value", f"format('{{:,.4f}}', {rha('pv', 4)}) || '  (threshold: 0.05)'"),
    ("Statistical sig.", "CASE WHEN pv < 0.05 THEN 'Yes' ELSE 'No — cannot conclude a real difference exists' END"),
    ("Effect size", f"'Cohen''s h = ' || format('{{:,.4f}}', {rha('h', 4)}) || ' (' || {_H_LABEL} || ')'"),
    ("MRR impact", f"'$' || {_signed('delta_mrr_month', 0)} || '/month at 10,000 visitors'"),
    ("VERDICT", _VERDICT),
]
ORACLE["ab_report_rows"] = expo("\nUNION ALL\n".join(
    f"SELECT {i + 1} AS row_order, '{label}' AS label, {v} AS value FROM st2"
    for i, (label, v) in enumerate(_REPORT_LINES)), CLEANED_CTE, ARMS_CTE, STATS_CTE)

# --- load path and checks -----------------------------------------------------

ORACLE["load_roundtrip_customers"] = subs("""
SELECT customer_id, plan_type, payment_method, subscription_months, CAST(monthly_mrr AS DOUBLE) AS monthly_mrr,
       CAST(lifetime_value AS DOUBLE) AS lifetime_value, churned FROM subscriptions""")

ORACLE["load_roundtrip_customers_renamed"] = subs("""
SELECT customer_id, plan_type, payment_method, subscription_months, CAST(monthly_mrr AS DOUBLE) AS monthly_mrr,
       CAST(lifetime_value AS DOUBLE) AS lifetime_value, churned,
       CASE WHEN churned = 'Yes' THEN 1 ELSE 0 END AS churned_flag,
       CASE WHEN subscription_months > -1 AND subscription_months <= 6 THEN 'new (0-6mo)'
            WHEN subscription_months > 6 AND subscription_months <= 24 THEN 'growing (7-24mo)'
            WHEN subscription_months > 24 AND subscription_months <= 999 THEN 'mature (25mo+)' END AS lifecycle_stage
FROM subscriptions""")

ORACLE["load_roundtrip_exposures"] = expo(
    "SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, grp, landing_page, converted FROM exposures")

ORACLE["pk_check"] = subs("""
SELECT rows, distinct_keys, duplicate_keys, null_keys,
       CASE WHEN duplicate_keys = 0 AND null_keys = 0 THEN 'OK' ELSE 'KEY VIOLATION' END AS status
FROM (SELECT CAST(SUM(n) AS BIGINT) AS rows, COUNT(customer_id) AS distinct_keys,
             COUNT(*) FILTER (WHERE n > 1) AS duplicate_keys,
             CAST(COALESCE(SUM(n) FILTER (WHERE customer_id IS NULL), 0) AS BIGINT) AS null_keys
      FROM (SELECT customer_id, COUNT(*) AS n FROM subscriptions GROUP BY customer_id) k) x""")

ORACLE["duplicate_customer_ids"] = subs("""
SELECT customer_id, COUNT(*) AS n FROM subscriptions GROUP BY customer_id HAVING COUNT(*) > 1
ORDER BY n DESC, customer_id""")

ORACLE["row_count_gate"] = with_ctes("""
SELECT table_name, expected_rows, lines,
       CASE WHEN expected_rows IS NULL OR abs(lines - expected_rows) < 10 THEN 'OK' ELSE 'UNEXPECTED COUNT' END AS status
FROM (SELECT 'subscriptions' AS table_name, (SELECT COUNT(*) FROM customer) AS expected_rows,
             COUNT(*) + 1 AS lines FROM subscriptions
      UNION ALL
      SELECT 'exposures', (SELECT COUNT(*) FROM events), COUNT(*) + 1 FROM exposures) g""",
    SUBSCRIPTIONS_CTE, EXPOSURES_CTE)

ORACLE["load_verification_customers"] = subs(f"""
SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE churned = 'No') AS active,
       COUNT(*) FILTER (WHERE churned = 'Yes') AS churned,
       {rha(div("COUNT(*) FILTER (WHERE churned = 'Yes')", "COUNT(*)") + " * 100.0", 1)} AS churn_pct,
       {rha(div("SUM(monthly_mrr)", "COUNT(monthly_mrr)"), 2)} AS avg_mrr,
       CAST(ROUND(SUM(monthly_mrr), 0) AS DOUBLE) AS total_mrr
FROM subscriptions""")

ORACLE["load_verification_ab"] = expo(f"""
SELECT grp, COUNT(*) AS users, {rha(div("SUM(converted)", "COUNT(converted)"), 4)} AS conversion_rate
FROM exposures GROUP BY grp ORDER BY grp""")

_CARD_TEXT = [
    ("total_mrr", "Total MRR", lambda v: f"'$' || format('{{:,.0f}}', {rha(v, 0)})",
     "Active subscriber revenue only. Churned customers are excluded from this total."),
    ("churn_rate", "Churn Rate %", lambda v: f"format('{{:,.2f}}', {rha(v + ' * 100.0', 2)}) || '%'",
     "% of all customers (active + churned) who have cancelled. Baseline health indicator."),
    ("avg_ltv", "Avg LTV", lambda v: f"'$' || format('{{:,.0f}}', {rha(v, 0)})",
     "Average lifetime revenue per customer across all records, including churned. Reflects full revenue capture."),
    ("avg_tenure_months", "Avg Tenure Months", lambda v: f"format('{{:,.1f}}', {rha(v, 1)}) || ' mths'",
     "Average months subscribed, active customers only. Higher = stronger retention."),
    ("at_risk_mrr", "At-Risk MRR", lambda v: f"'$' || format('{{:,.0f}}', {rha(v, 0)})",
     "Revenue from subscribers in their first 6 months — the highest churn-risk window. Monitor closely."),
    ("ltv_mrr_ratio", "LTV MRR Ratio", lambda v: f"format('{{:,.1f}}', {rha(v, 1)})",
     "Avg LTV ÷ Avg MRR. Indicates how many months of revenue the typical customer generates. ~35x = healthy for SaaS."),
]
ORACLE["kpi_cards_display"] = report("\nUNION ALL\n".join(
    f"SELECT {i + 1} AS card_order, '{label}' AS measure, {col} AS value, {fmt(col)} AS display, "
    f"'{tip}' AS tooltip FROM cards"
    for i, (col, label, fmt, tip) in enumerate(_CARD_TEXT)), f"cards AS (SELECT {CARD_SELECT} FROM f)")

ORACLE["implicit_sums_by_label"] = report("""
SELECT plan_label, CAST(SUM(subscription_months) AS BIGINT) AS sum_subscription_months,
       CAST(SUM(monthly_mrr) AS DOUBLE) AS sum_monthly_mrr, CAST(SUM(lifetime_value) AS DOUBLE) AS sum_lifetime_value
FROM f GROUP BY plan_label ORDER BY plan_label""")

# --- every bin of every plan -----------------------------------------------------

ORACLE["ltv_histogram_dense"] = subs("""
SELECT r.plan_type, CAST(k AS INTEGER) AS bin, lo + (hi - lo) * (k - 1) / 40.0 AS bin_start, lo + (hi - lo) * k / 40.0 AS bin_end,
       (SELECT COUNT(*) FROM subscriptions s WHERE s.plan_type = r.plan_type AND s.lifetime_value IS NOT NULL
          AND least(40, floor((CAST(s.lifetime_value AS DOUBLE) - r.lo) * 40.0 / (r.hi - r.lo)) + 1) = k) AS customers
FROM r, range(1, 41) AS n(k)""",
    """r AS (SELECT plan_type, CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mx = mn THEN mx + 0.5 ELSE mx END AS hi
      FROM (SELECT plan_type, min(CAST(lifetime_value AS DOUBLE)) AS mn, max(CAST(lifetime_value AS DOUBLE)) AS mx
            FROM subscriptions WHERE lifetime_value IS NOT NULL GROUP BY plan_type) x)""")

# --- tables with null and unlisted values -----------------------------------------

_GAPPY_SUBS = SUBSCRIPTIONS_CTE.replace("subscriptions AS (", "base AS (", 1) + """,
subscriptions AS (
SELECT customer_id,
       CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN 'Weekly' ELSE plan_type END AS plan_type,
       CASE WHEN id % 17 <> 0 THEN payment_method END AS payment_method,
       CASE WHEN id % 23 = 0 THEN 1200 ELSE subscription_months END AS subscription_months,
       monthly_mrr, lifetime_value, CASE WHEN id % 19 <> 0 THEN churned END AS churned
FROM (SELECT *, CAST(customer_id AS BIGINT) AS id FROM base) b)"""
_GAPPY_EXPO = EXPOSURES_CTE.replace("exposures AS (", "base AS (", 1) + """,
exposures AS (
SELECT user_id, ts, event_id, CASE WHEN event_id % 29 <> 0 THEN grp END AS grp,
       CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_id % 31 = 0 THEN 'third_page' ELSE landing_page END AS landing_page, converted
FROM base)"""


def gappy_subs(sql: str, *extra: str) -> str:
    return with_ctes(sql, _GAPPY_SUBS, *extra)


def gappy_expo(sql: str, *extra: str) -> str:
    return with_ctes(sql, _GAPPY_EXPO, *extra)


_YES = "COUNT(*) FILTER (WHERE churned = 'Yes')"

ORACLE["gaps_mrr_by_plan_nb"] = gappy_subs(f"""
SELECT plan_type, COUNT(customer_id) AS customers, CAST(SUM(monthly_mrr) AS DOUBLE) AS total_mrr,
       {div("SUM(monthly_mrr)", "COUNT(monthly_mrr)")} AS avg_mrr
FROM subscriptions WHERE plan_type IS NOT NULL GROUP BY plan_type""")


def _gaps_banded(key: str, high: str, medium: str) -> str:
    return gappy_subs(f"""
SELECT {key}, churned, total, churn_rate, CASE WHEN churn_rate > {high} THEN 'high' WHEN churn_rate > {medium} THEN 'medium' ELSE 'low' END AS risk_band
FROM (SELECT {key}, {_YES} AS churned, COUNT(*) AS total, {div(_YES, "COUNT(*)")} AS churn_rate
      FROM subscriptions WHERE {key} IS NOT NULL GROUP BY {key}) x""")


ORACLE["gaps_churn_by_plan_banded"] = _gaps_banded("plan_type", "0.30", "0.15")
ORACLE["gaps_churn_by_payment_banded"] = _gaps_banded("payment_method", "0.30", "0.20")

ORACLE["gaps_class_balance"] = gappy_subs(f"""
SELECT churned, COUNT(*) AS customers, {div("COUNT(*)", "(SELECT COUNT(*) FROM subscriptions)")} AS share
FROM subscriptions WHERE churned IS NOT NULL GROUP BY churned""")

ORACLE["gaps_cohort_retention_long"] = gappy_subs(f"""
SELECT tenure_bucket, bucket_order, plan_type, churn_pct, 100.0::DOUBLE - churn_pct AS retention_pct
FROM (SELECT tenure_bucket, bucket_order, plan_type, {_pct(_YES, "COUNT(*)")} AS churn_pct
      FROM bucketed WHERE plan_type IS NOT NULL GROUP BY ALL) x""", BUCKETED_CTE)

ORACLE["gaps_cohort_churn_matrix"] = gappy_subs("SELECT tenure_bucket, bucket_order, " + ", ".join(
    f"""{_pct(f"{_YES[:-1]} AND plan_type = '{p}')", f"COUNT(*) FILTER (WHERE plan_type = '{p}')")} AS "{p}" """
    for p in ("Month-to-month", "One year", "Two year", "Weekly"))
    + " FROM bucketed WHERE plan_type IS NOT NULL GROUP BY tenure_bucket, bucket_order", BUCKETED_CTE)

ORACLE["gaps_ltv_stats_by_plan"] = gappy_subs(f"""
SELECT plan_type, {rhe("quantile_cont(CAST(lifetime_value AS DOUBLE), 0.5)", 2)} AS median,
  {rhe(div("SUM(lifetime_value)", "COUNT(lifetime_value)"), 2)} AS mean,
  {rhe("stddev_samp(CAST(lifetime_value AS DOUBLE))", 2)} AS std, COUNT(lifetime_value) AS count
FROM subscriptions WHERE lifetime_value IS NOT NULL GROUP BY plan_type""")

ORACLE["gaps_top_churned_by_plan"] = gappy_subs(_TOP_CHURNED)

ORACLE["gaps_plan_dimension_usage"] = gappy_subs("""
SELECT plan_type, plan_order, plan_label, (SELECT COUNT(*) FROM subscriptions s WHERE s.plan_type = d.plan_type) AS customers FROM dim_plan_type d
UNION ALL
SELECT plan_type, NULL, NULL, COUNT(*) FROM subscriptions
WHERE plan_type IS NULL OR plan_type NOT IN (SELECT plan_type FROM dim_plan_type) GROUP BY plan_type""", PLAN_DIM_CTE)

ORACLE["gaps_ab_group_rates"] = gappy_expo(f"""
SELECT grp, landing_page, COUNT(user_id) AS users, CAST(SUM(converted) AS BIGINT) AS conversions,
       {rhe(div("SUM(converted)", "COUNT(user_id)"), 4)} AS rate
FROM exposures WHERE grp IS NOT NULL AND landing_page IS NOT NULL GROUP BY grp, landing_page""")

ORACLE["gaps_split_check"] = gappy_expo(f"""
SELECT grp, n, share, CASE WHEN abs(share - 0.5) < 0.01 THEN 'OK' ELSE 'WARNING — not 50/50!' END AS status
FROM (SELECT grp, COUNT(*) AS n, {div("COUNT(*)", "(SELECT COUNT(*) FROM exposures)")} AS share
      FROM exposures WHERE grp IS NOT NULL GROUP BY grp) x""")

ORACLE["gaps_alignment_crosstab"] = gappy_expo("SELECT grp, " + ", ".join(
    f"COUNT(*) FILTER (WHERE landing_page = '{p}') AS {p}" for p in ("new_page", "old_page", "third_page"))
    + " FROM exposures WHERE grp IS NOT NULL AND landing_page IS NOT NULL GROUP BY grp")

ORACLE["gaps_contamination_check"] = gappy_expo("""
SELECT COUNT(*) AS users, COUNT(*) FILTER (WHERE arms > 1) AS contaminated_users,
  CASE WHEN COUNT(*) FILTER (WHERE arms > 1) > 0 THEN 'ACTION: These users should be removed before analysis.'
       ELSE 'Status: OK — no cross-group contamination' END AS status
FROM (SELECT user_id, COUNT(DISTINCT grp) AS arms FROM exposures WHERE grp IS NOT NULL GROUP BY user_id) u""")

ORACLE["gaps_ab_clean_summary"] = gappy_expo(f"""
SELECT grp, COUNT(converted) AS n, CAST(SUM(converted) AS BIGINT) AS conversions,
       {rhe(div("SUM(converted)", "COUNT(converted)"), 4)} AS rate
FROM cleaned GROUP BY grp""", CLEANED_CTE)

# --- source files, sinks and loads --------------------------------------------------

# The file's lines stand in descending event order, so a user's first aligned line is the latest such event.
_LAST_EVENT_CTE = f"""cleaned AS (
SELECT e.* FROM exposures e WHERE {ALIGNED_SQL}
  AND event_id = (SELECT max(o.event_id) FROM exposures o WHERE o.user_id = e.user_id AND {ALIGNED_SQL.replace('grp', 'o.grp').replace('landing_page', 'o.landing_page')}))"""
for _name in ("ab_clean_summary", "ab_test_stats", "ab_report_rows"):
    ORACLE[f"{_name}_file_order"] = ORACLE[_name].replace(CLEANED_CTE, _LAST_EVENT_CTE)

ORACLE["fixed_schema_table"] = ORACLE["load_verification_ab"]
ORACLE["result_preview"] = subs("""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY subscription_months, monthly_mrr DESC, customer_id) AS INTEGER) AS position, customer_id, plan_type,
       subscription_months, CAST(monthly_mrr AS DOUBLE) AS monthly_mrr, churned
FROM subscriptions WHERE subscription_months <= 6 QUALIFY position <= 5""")
ORACLE["gaps_cohort_retention_matrix"] = gappy_subs("SELECT plan_type, " + ", ".join(
    f"""100.0::DOUBLE - {_pct(f"{_YES[:-1]} AND tenure_bucket = '{lab}')", f"COUNT(*) FILTER (WHERE tenure_bucket = '{lab}')")} AS "{lab}" """
    for lab, _, _ in TENURE_SQL) + " FROM bucketed WHERE plan_type IS NOT NULL GROUP BY plan_type", BUCKETED_CTE)

_DAMAGE_CTE = """lines AS (
SELECT *, CASE WHEN id % 59 = 0 OR id % 61 = 0 THEN 'wrong number of fields'
               WHEN id % 47 = 0 AND id % 43 = 0 THEN 'bad subscription_months, bad lifetime_value'
               WHEN id % 47 = 0 THEN 'bad subscription_months' WHEN id % 43 = 0 THEN 'bad lifetime_value' END AS reject_reason
FROM (SELECT *, CAST(customer_id AS BIGINT) AS id FROM subscriptions) s)"""

ORACLE["load_rejects_customers"] = subs("SELECT customer_id, reject_reason FROM lines WHERE reject_reason IS NOT NULL", _DAMAGE_CTE)

ORACLE["load_accepted_customers"] = subs(f"""
SELECT COUNT(*) AS customers, COUNT(*) FILTER (WHERE churned = 'No') AS active, {_YES} AS churned,
       {rha(div(_YES, "COUNT(*)") + " * 100.0", 1)} AS churn_pct,
       {rha(div("SUM(monthly_mrr)", "COUNT(monthly_mrr)"), 2)} AS avg_mrr,
       CAST(ROUND(SUM(monthly_mrr), 0) AS DOUBLE) AS total_mrr
FROM lines WHERE reject_reason IS NULL""", _DAMAGE_CTE)

ORACLE["file_line_gate"] = """
SELECT 'customers' AS file_name, COUNT(*) AS expected_rows, COUNT(*) + 1 AS lines, 'OK' AS status FROM customer
UNION ALL SELECT 'nine off', COUNT(*) - 8, COUNT(*) + 1, 'OK' FROM customer
UNION ALL SELECT 'ten off', COUNT(*) - 9, COUNT(*) + 1, 'UNEXPECTED COUNT' FROM customer
UNION ALL SELECT 'ab_test', NULL, COUNT(*) + 1, 'OK' FROM events"""

ORACLE["load_once_readback"] = expo(f"""
SELECT grp, COUNT(*) AS users, {rha(div("SUM(converted)", "COUNT(converted)"), 4)} AS conversion_rate, 1 AS loads
FROM exposures GROUP BY grp""")

ORACLE["result_csv_readback"] = subs("SELECT plan_type, COUNT(*) AS customer_count, false AS empty_written FROM subscriptions GROUP BY plan_type")

ORACLE["report_tables_readback"] = subs("""
SELECT 'raw_data' AS table_name, COUNT(*) AS rows FROM subscriptions
UNION ALL SELECT 'kpis', 6
UNION ALL SELECT 'mrr_by_plan', COUNT(DISTINCT plan_type) FROM subscriptions WHERE churned = 'No'
UNION ALL SELECT 'churn_by_plan', COUNT(DISTINCT plan_type) FROM subscriptions
UNION ALL SELECT 'ltv_distribution', 6""")

# --- the drivers' tree, level by level ----------------------------------------------


def _gini(n: str, pos: str) -> str:
    p = f"(CAST({pos} AS DOUBLE) / CAST({n} AS DOUBLE))"
    return f"(1.0 - {p} * {p} - (1.0 - {p}) * (1.0 - {p}))"


def _tree(features: tuple[str, ...], text: set[str], depth: int = 4) -> str:
    """CTEs up to ``splits`` (node, f, v, n, pos, cl, sl, gain); texts are coded in alphabetical order."""
    value = {c: f"DENSE_RANK() OVER (ORDER BY {c}) - 1" if c in text else f"CAST({c} AS DOUBLE)" for c in features}
    ctes = [f"train AS (SELECT {', '.join(f'{value[c]} AS x{i}, {c} AS y{i}' for i, c in enumerate(features))}, "
            f"CASE WHEN churned = 'Yes' THEN 1 ELSE 0 END AS label, 1 AS node FROM customers WHERE {' AND '.join(f'{c} IS NOT NULL' for c in features)})"]
    rows = "train"
    gain = (f"{_gini('n', 'pos')} - (CAST(cl AS DOUBLE) / CAST(n AS DOUBLE)) * {_gini('cl', 'sl')} "
            f"- (CAST(n - cl AS DOUBLE) / CAST(n AS DOUBLE)) * {_gini('(n - cl)', '(pos - sl)')}")
    for level in range(depth):
        per = "\nUNION ALL ".join(
            f"SELECT node, {i} AS f, x{i} AS v, CAST(min(y{i}) AS VARCHAR) AS shown, COUNT(*) AS c, SUM(label) AS s FROM {rows} GROUP BY node, x{i}" for i in range(len(features)))
        ctes += [f"count{level} AS ({per})",
                 f"""run{level} AS (SELECT node, f, v, shown, SUM(c) OVER w AS cl, SUM(s) OVER w AS sl,
       SUM(c) OVER (PARTITION BY node, f) AS n, SUM(s) OVER (PARTITION BY node, f) AS pos FROM count{level} WINDOW w AS (PARTITION BY node, f ORDER BY v))""",
                 f"""split{level} AS (SELECT *, {gain} AS gain FROM run{level} WHERE cl < n AND pos > 0 AND pos < n
       QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1)"""]
        chosen = "CASE s.f " + " ".join(f"WHEN {i} THEN r.x{i}" for i in range(len(features))) + " END"
        ctes.append(f"rows{level} AS (SELECT r.* REPLACE (2 * r.node + CASE WHEN {chosen} <= s.v THEN 0 ELSE 1 END AS node) FROM {rows} r JOIN split{level} s ON r.node = s.node)")
        rows = f"rows{level}"
    ctes.append("splits AS (" + " UNION ALL ".join(f"SELECT * FROM split{k}" for k in range(depth)) + ")")
    ctes.append("features AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(features)) + ") AS t(f, feature))")
    return ",\n".join(ctes)


_RANKING = """
SELECT feature, importance, CAST(ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, round(coalesce(sum(n * gain), 0) / (SELECT sum(n * gain) FROM splits), 9) AS importance
      FROM features LEFT JOIN splits USING (f) GROUP BY feature) x"""
_FOUR = _tree(("subscription_months", "monthly_mrr", "plan_type", "payment_method"), {"plan_type", "payment_method"})

ORACLE["churn_drivers"] = subs(_RANKING, "customers AS (SELECT * FROM subscriptions)", _FOUR)

ORACLE["churn_tree"] = subs("""
SELECT CAST(node AS INTEGER) AS node, feature, CASE WHEN f < 2 THEN format('{:.2f}', v) ELSE shown END AS split_after,
       CAST(n AS BIGINT) AS rows, CAST(cl AS BIGINT) AS rows_left, round(gain, 9) AS gain
FROM splits JOIN features USING (f)""", "customers AS (SELECT * FROM subscriptions)", _FOUR)

ORACLE["top_churn_drivers"] = subs(_RANKING + " QUALIFY rank <= 5", """customers AS (
SELECT *, CASE WHEN i % 5 = 0 THEN 'No' WHEN i % 3 = 0 THEN 'DSL' ELSE 'Fiber optic' END AS internet_service,
       CASE WHEN i % 53 <> 0 THEN CASE WHEN i % 4 = 1 THEN 'Yes' ELSE 'No' END END AS online_security,
       CASE WHEN (i + subscription_months) % 3 = 0 THEN 'Yes' ELSE 'No' END AS tech_support,
       CASE WHEN i % 2 = 0 THEN 'Yes' ELSE 'No' END AS paperless_billing, CASE WHEN i % 6 = 0 THEN 1 ELSE 0 END AS senior_citizen,
       CASE WHEN subscription_months % 7 > 3 THEN 'Yes' ELSE 'No' END AS partner, CASE WHEN i % 10 < 3 THEN 'Yes' ELSE 'No' END AS dependents
FROM (SELECT *, CAST(customer_id AS BIGINT) AS i FROM subscriptions) s)""",
    _tree(("subscription_months", "monthly_mrr", "plan_type", "internet_service", "online_security", "tech_support", "payment_method",
           "paperless_billing", "senior_citizen", "partner", "dependents"),
          {"plan_type", "internet_service", "online_security", "tech_support", "payment_method", "paperless_billing", "partner", "dependents"}))
