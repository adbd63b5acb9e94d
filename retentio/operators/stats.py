"""Exact percentiles (linear interpolation, like ``quantile_cont`` / pandas)
that stay distributed when one group holds most of the rows.

``method="exact"`` (default):

1. ``freq``: rows collapse to (group, value, count) — a partially aggregated
   shuffle keyed by group AND value, so a hot group spreads over many tasks;
2. each value falls in a fixed log-scale coarse bucket (64 per doubling of
   |value|, a pure function of the value); per (group, bucket) counts are small
   (a few thousand rows per group), and a running count over them locates the
   coarse bucket that holds each target rank;
3. inside those target buckets (a join with at most groups x probabilities x 2
   target rows) the same is repeated on a 65536-times finer log grid — at most
   65536 fine buckets per target — to find the fine bucket of each rank;
4. only the values of the target fine buckets (~1.7e-7 relative width) are
   ranked, with a window per (group, target, fine bucket), so no task ever
   sorts a whole group or a whole coarse bucket.

``method="builtin"`` uses Spark's ``percentile`` (its per-group state holds one
entry per distinct value); ``method="approx"`` uses ``percentile_approx``.
Output: the group columns plus ``p<100*prob>`` columns (e.g. ``p50``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null equal to null; the keys stay once, from ``left``."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


BUCKETS_PER_DOUBLING = 64      # coarse buckets: ~1.1 % wide
FINE_SPLIT = 65536             # fine buckets per coarse bucket: ~1.7e-7 relative width


def _name(p: float) -> str:
    return "p" + f"{p * 100:g}".replace(".", "_")


def value_counts(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(group, ``value``, ``_v``, ``_c``): how often each non-null value occurs, ``_v`` as a double. Moments,
    extremes and percentiles all follow from these rows, so the source is read and shuffled once."""
    return (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_v", F.col("_x").cast("double")))


def profile_counts(freq: DataFrame, by: Sequence[str], probs: Sequence[float], few_groups: bool = True) -> DataFrame:
    """Per group of ``value_counts`` rows: n, total (exact for whole numbers and decimals), mean, std (sample),
    min, max and the percentiles ``p...``. A null group is a group like any other.

    The squared distances are taken from the group's mean (a row per group joined back), so a
    large mean costs no digits. ``few_groups`` as in ``exact_percentiles``."""
    by = list(by)
    if not by:
        raise ValueError("profile_counts needs a grouping column")
    hint = F.broadcast if few_groups else (lambda d: d)
    sums = freq.groupBy(*by).agg(F.sum("_c").alias("n"), F.expr("sum(_x * _c)").alias("total"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    sums = sums.withColumn("mean", F.col("total").cast("double") / F.col("n").cast("double"))
    far = (null_safe_join(freq, hint(sums.select(*by, F.col("mean").alias("_m"))), by)
           .groupBy(*by).agg(F.expr("sum(_c * (_v - _m) * (_v - _m))").alias("_ss")))
    out = null_safe_join(sums, far, by).withColumn("std", F.expr("CASE WHEN n > 1 THEN sqrt(_ss / (n - 1)) END")).drop("_ss")
    return null_safe_join(out, _of_counts(freq, by, list(probs), few_groups), by)


def exact_percentiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                      method: str = "exact", accuracy: int = 100_000, few_groups: bool = True) -> DataFrame:
    """Percentiles of ``value`` per group of ``by`` (linear interpolation).

    ``few_groups=True`` declares that ``by`` is a low-cardinality dimension (or
    empty): the table of target buckets — at most groups x 2 x len(probs) rows —
    is then broadcast, so the (group, value, count) rows are filtered map-side
    instead of being shuffled a second time. With ``few_groups=False`` the
    planner / AQE decides from sizes at run time.
    """
    by = list(by)
    v = F.col(value).cast("double")
    base = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    if method == "builtin":
        agg = F.percentile("_v", list(probs))
    elif method == "approx":
        agg = F.percentile_approx("_v", list(probs), accuracy)
    elif method == "exact":
        return _distributed(base, by, list(probs), few_groups)
    else:
        raise ValueError(method)
    grouped = base.groupBy(*by) if by else base.groupBy()
    out = grouped.agg(agg.alias("_q"))
    return out.select(*by, *[F.col("_q")[i].alias(_name(p)) for i, p in enumerate(probs)])


def bucket_sql(v: str, per_doubling: int) -> str:
    """Monotone log-scale bucket of a value: a pure function of the value, so no
    per-group range has to be joined back."""
    k = f"{float(per_doubling)!r}D"
    return (f"CAST(CASE WHEN {v} >= 0 THEN FLOOR(log2({v} + 1.0D) * {k}) "
            f"ELSE -FLOOR(log2(1.0D - {v}) * {k}) - 1 END AS BIGINT)")


def _distributed(base: DataFrame, by: list[str], probs: list[float], few_groups: bool) -> DataFrame:
    key = list(by)
    return _of_counts(base.groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_c")), by, probs, few_groups)


def _of_counts(freq: DataFrame, by: list[str], probs: list[float], few_groups: bool) -> DataFrame:
    key = list(by)
    keys = [f"`{k}`" for k in key]

    def over(*cols: str, order: str | None = None) -> str:
        part = f"PARTITION BY {', '.join(keys + list(cols))}" if keys or cols else ""
        return f"OVER ({part}{' ORDER BY ' + order if order else ''})"

    tagged = freq.withColumns({"_b": F.expr(bucket_sql("_v", BUCKETS_PER_DOUBLING)),
                               "_f": F.expr(bucket_sql("_v", BUCKETS_PER_DOUBLING * FINE_SPLIT))})

    # Level 1: running counts over coarse buckets (a few thousand rows per group).
    bcount = (tagged.groupBy(*key, "_b").agg(F.sum("_c").alias("_bc"))
              .withColumns({"_before": F.expr(f"sum(_bc) {over(order='_b')} - _bc"),
                            "_n": F.expr(f"sum(_bc) {over()}")}))

    # Target ranks (0-based) per probability: floor and ceil of (n-1)*p, and the
    # coarse bucket that holds each.
    targets = []
    for i, p in enumerate(probs):
        h = f"CAST(_n - 1 AS DOUBLE) * {float(p)!r}D"
        for side, fn in (("lo", "FLOOR"), ("hi", "CEIL")):
            targets.append(f"struct({i} AS _pi, '{side}' AS _side, CAST({fn}({h}) AS BIGINT) AS _r, {h} AS _h)")
    tg = (bcount.selectExpr(*keys, "_b", "_bc", "_before", f"explode(array({', '.join(targets)})) AS _t")
          .selectExpr(*keys, "_b", "_before", "_t.*")
          .where("_r >= _before AND _r < _before + _bc"))

    # Level 2: the rows of each target coarse bucket (joined once per target,
    # <= 2 x probs copies), counted per fine bucket (at most FINE_SPLIT per
    # coarse bucket); running counts locate the fine bucket of each target rank.
    inner = null_safe_join(tagged, F.broadcast(tg) if few_groups else tg, key + ["_b"])
    fine = (inner.groupBy(*key, "_b", "_pi", "_side", "_f")
            .agg(F.sum("_c").alias("_fc"), F.max("_before").alias("_before"), F.max("_r").alias("_r"))
            .withColumn("_before2", F.expr(f"_before + sum(_fc) {over('_b', '_pi', '_side', order='_f')} - _fc"))
            .where("_r >= _before2 AND _r < _before2 + _fc")
            .select(*key, "_b", "_pi", "_side", "_f", "_before2"))

    # Rank only the values of the target fine buckets: a window per (group,
    # target, fine bucket), never a whole group or a whole coarse bucket.
    picked = (null_safe_join(inner, fine, key + ["_b", "_pi", "_side", "_f"])
              .withColumn("_upto", F.expr(f"sum(_c) {over('_b', '_pi', '_side', '_f', order='_v')}"))
              .where("_r >= _before2 + _upto - _c AND _r < _before2 + _upto")
              .select(*key, "_pi", "_side", "_h", "_v"))
    # One aggregation per group: the two neighbouring values of every target rank.
    parts = []
    for i, _ in enumerate(probs):
        parts += [F.expr(f"max(CASE WHEN _pi = {i} AND _side = 'lo' THEN _v END)").alias(f"_lo{i}"),
                  F.expr(f"max(CASE WHEN _pi = {i} AND _side = 'hi' THEN _v END)").alias(f"_hi{i}"),
                  F.expr(f"max(CASE WHEN _pi = {i} THEN _h END)").alias(f"_h{i}")]
    ends = picked.groupBy(*key).agg(*parts) if key else picked.agg(*parts)
    return ends.selectExpr(*keys, *[
        f"_lo{i} + (_hi{i} - _lo{i}) * (_h{i} - FLOOR(_h{i})) AS {_name(p)}" for i, p in enumerate(probs)])
