"""Churn-driver ranking: the feature importances of a shallow decision tree.

The tree is grown level by level with exact splits: every boundary between two
neighbouring values of a feature is a candidate. One aggregate per level counts
(node, feature, value) with its churned rows; running counts over the values
give the rows and churned rows left of each boundary, hence its Gini gain, and
the best boundary of a node goes to the next level. Values run over buckets
(``operators/stats.py``): the totals of the buckets are summed up on their own,
so that no task holds all values of a feature. Only the splits, at most
``2 ** max_depth - 1`` rows, come back to the driver.

Text features are ordered like integer codes of their values in alphabetical
order, without making the codes: a boundary lies after a value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.expr import sql_str, yes_flag
from retentio.operators.stats import BUCKETS_PER_DOUBLING, bucket_sql
from retentio.sources.literals import literal_table

# The model's features, in order. Those that a table has are used.
DRIVER_FEATURES = ("subscription_months", "monthly_mrr", "plan_type", "internet_service", "online_security", "tech_support",
                   "payment_method", "paperless_billing", "senior_citizen", "partner", "dependents")
MAX_DEPTH = 4
IMPORTANCE_DIGITS = 9


@dataclass(frozen=True)
class Split:
    """A node (1: root; 2n and 2n + 1: children of n) whose rows with a value up to ``value`` (number or text) go left.
    ``threshold`` lies halfway to the next number; texts have none."""
    node: int
    feature: str
    value: float | str
    threshold: float | None
    rows: int
    rows_left: int
    gain: float


def features_of(df: DataFrame, features: Sequence[str] = DRIVER_FEATURES) -> list[str]:
    return [f for f in features if f in df.columns]


def gini_sql(n: str, pos: str) -> str:
    """Gini impurity of ``n`` rows with ``pos`` churned ones."""
    p = f"(CAST({pos} AS DOUBLE) / CAST({n} AS DOUBLE))"
    return f"(1.0D - {p} * {p} - (1.0D - {p}) * (1.0D - {p}))"


def _below(s: Split, text: bool) -> str:
    return f"`{s.feature}` <= {sql_str(s.value)}" if text else f"CAST(`{s.feature}` AS DOUBLE) <= {s.value!r}D"


def best_splits(data: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """The best boundary of every node of ``data`` (``node``, the features, ``label`` 0 or 1) that has one: largest
    Gini gain, then first feature, then lowest value. Pure nodes and nodes of equal rows have none."""
    kinds = dict(data.dtypes)
    entries = ", ".join(
        f"struct({i} AS f, {'CAST(NULL AS DOUBLE)' if kinds[c] == 'string' else f'CAST(`{c}` AS DOUBLE)'} AS num, "
        f"{f'`{c}`' if kinds[c] == 'string' else 'CAST(NULL AS STRING)'} AS txt)" for i, c in enumerate(features))
    counted = (data.select("node", F.col(label).alias("_y"), F.expr(f"explode(array({entries}))").alias("e"))
               .groupBy("node", "e.f", "e.num", "e.txt").agg(F.count(F.lit(1)).alias("c"), F.sum("_y").alias("s")))
    # buckets in the order of the values: logarithmic for numbers, by the first three bytes for texts
    counted = counted.withColumn("b", F.expr(f"CASE WHEN num IS NOT NULL THEN {bucket_sql('num', BUCKETS_PER_DOUBLING)} "
                                             "ELSE CAST(conv(left(rpad(hex(left(txt, 3)), 6, '0'), 6), 16, 10) AS BIGINT) END"))
    total = "OVER (PARTITION BY node, f)"
    order = "(PARTITION BY node, f ORDER BY b)"
    buckets = (counted.groupBy("node", "f", "b").agg(F.sum("c").alias("bc"), F.sum("s").alias("bs"), F.min("num").alias("b_num"), F.min("txt").alias("b_txt"))
               .selectExpr("node AS _n", "f AS _f", "b AS _b", f"sum(bc) OVER {order} - bc AS c0", f"sum(bs) OVER {order} - bs AS s0",
                           f"sum(bc) {total} AS n", f"sum(bs) {total} AS pos", f"lead(b_num) OVER {order} AS next_num", f"lead(b_txt) OVER {order} AS next_txt"))
    inside = "(PARTITION BY node, f, b ORDER BY num, txt)"
    runs = (counted.join(buckets.where("pos > 0 AND pos < n"), [F.col("node") == F.col("_n"), F.col("f") == F.col("_f"), F.col("b") == F.col("_b")])
            .selectExpr("node", "f", "num", "txt", "n", "pos", f"c0 + sum(c) OVER {inside} AS cl", f"s0 + sum(s) OVER {inside} AS sl",
                        f"coalesce(lead(num) OVER {inside}, next_num) AS nxt")
            .where("cl < n"))
    share = lambda n: f"(CAST({n} AS DOUBLE) / CAST(n AS DOUBLE))"
    gain = f"{gini_sql('n', 'pos')} - {share('cl')} * {gini_sql('cl', 'sl')} - {share('n - cl')} * {gini_sql('(n - cl)', '(pos - sl)')}"
    return (runs.withColumn("gain", F.expr(gain))
            .withColumn("_i", F.expr("row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, num, txt)")).where("_i = 1")
            .select("node", "f", "num", "txt", (F.col("num") + (F.col("nxt") - F.col("num")) / 2).alias("threshold"), "n", "cl", "gain"))


def grow_tree(rows: DataFrame, features: Sequence[str], label: str = "label", max_depth: int = MAX_DEPTH) -> list[Split]:
    """Splits of the tree over ``rows`` without nulls, level by level (one aggregate each)."""
    text = {c for c, t in rows.dtypes if t == "string"}
    found: list[Split] = []
    node = "1"
    for _ in range(max_depth):
        level = best_splits(rows.withColumn("node", F.expr(node)).where("node IS NOT NULL"), features, label).collect()
        splits = [Split(r["node"], features[r["f"]], r["num"] if r["txt"] is None else r["txt"], r["threshold"], r["n"], r["cl"], r["gain"]) for r in level]
        if not splits:
            break
        found += sorted(splits, key=lambda s: s.node)
        cases = " ".join(f"WHEN {s.node} THEN {2 * s.node} + CASE WHEN {_below(s, s.feature in text)} THEN 0 ELSE 1 END" for s in splits)
        node = f"CASE ({node}) {cases} END"
    return found


def _training_rows(subs: DataFrame, features: Sequence[str]) -> DataFrame:
    return subs.select(*features, yes_flag("churned").alias("label")).na.drop()


def _splits(subs: DataFrame, features: Sequence[str] | None, max_depth: int) -> tuple[list[str], list[Split]]:
    chosen = features_of(subs) if features is None else list(features)
    # read once per level: the narrow training rows are kept (memory, spilling to disk; lost blocks are recomputed)
    train = _training_rows(subs, chosen).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return chosen, grow_tree(train, chosen, max_depth=max_depth)
    finally:
        train.unpersist()


def churn_tree(subs: DataFrame, features: Sequence[str] | None = None, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The splits: (node, feature, split_after, rows, rows_left, gain)."""
    _, splits = _splits(subs, features, max_depth)
    schema = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("feature", T.StringType()), T.StructField("split_after", T.StringType()),
                           T.StructField("rows", T.LongType()), T.StructField("rows_left", T.LongType()), T.StructField("gain", T.DoubleType())])
    rows = [(s.node, s.feature, s.value if isinstance(s.value, str) else f"{s.value:.2f}", s.rows, s.rows_left, round(s.gain, IMPORTANCE_DIGITS)) for s in splits]
    return literal_table(subs.sparkSession, rows, schema) if rows else subs.sparkSession.createDataFrame([], schema)


def churn_drivers(subs: DataFrame, features: Sequence[str] | None = None, max_depth: int = MAX_DEPTH,
                  top: int | None = None) -> DataFrame:
    """(feature, importance, rank) ordered by importance; ``top`` keeps the first n. The importance of a
    feature is the sum of its splits' gains weighted by their rows, as a share of all. ``features`` defaults to the
    model's features that the table has."""
    chosen, splits = _splits(subs, features, max_depth)
    weight = {f: 0.0 for f in chosen}
    for s in splits:
        weight[s.feature] += s.rows * s.gain
    whole = sum(weight.values())
    share = {f: round(w / whole, IMPORTANCE_DIGITS) if whole else 0.0 for f, w in weight.items()}
    rows = sorted(share.items(), key=lambda r: (-r[1], r[0]))[:top]
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType()),
                           T.StructField("rank", T.IntegerType())])
    return literal_table(subs.sparkSession, [(f, float(v), i + 1) for i, (f, v) in enumerate(rows)], schema)
