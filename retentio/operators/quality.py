"""Data-quality profiles: describe(), null counts, distinct values, date range.

Each profile is one aggregation pass over the table, then an unpivot of the
single aggregated row (``inline`` of an array of structs) — never one job per
column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.expr import round_half_even, sql_str
from retentio.operators.stats import exact_percentiles, profile_counts, value_counts
from retentio.sources.literals import literal_table

DESCRIBE_COLUMNS = ("subscription_months", "monthly_mrr", "lifetime_value")
QUARTILES = (0.25, 0.5, 0.75)


def numeric_describe(df: DataFrame, columns: Sequence[str] = DESCRIBE_COLUMNS,
                     method: str = "exact") -> DataFrame:
    """count, mean, std, min, 25/50/75 % (linear interpolation), max per column,
    rounded to 2 dp (numpy rounding); one row per column, also for a column without values.

    The columns become (column, value) rows in one pass and are counted per value once; all
    figures follow from those counts. Whole numbers and decimals are added up exactly."""
    types = dict(df.dtypes)
    exact = all(types[c].startswith(("decimal", "tinyint", "smallint", "int", "bigint")) for c in columns)
    typ = "DECIMAL(38,6)" if exact else "DOUBLE"
    long = df.selectExpr("inline(array(" + ", ".join(
        f"struct({sql_str(c)} AS field, CAST(`{c}` AS {typ}) AS value)" for c in columns) + "))")
    stats = profile_counts(value_counts(long, "value", ["field"]), ["field"], QUARTILES)
    if method != "exact":
        stats = stats.drop("p25", "p50", "p75").join(exact_percentiles(long, "value", ["field"], QUARTILES, method=method), "field")
    fields = literal_table(df.sparkSession, [(c,) for c in columns], T.StructType([T.StructField("field", T.StringType())]))
    r = lambda name: round_half_even(name, 2).alias(name)
    return (fields.join(stats, "field", "left")
            .select("field", F.coalesce("n", F.lit(0)).alias("count"), r("mean"), r("std"), r("min"), r("p25"), r("p50"), r("p75"), r("max")))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null count per column, keeping only columns with at least one null."""
    cols = list(columns or df.columns)
    counted = df.agg(*[F.expr(f"count_if(`{c}` IS NULL)").alias(c) for c in cols])
    rows = ", ".join(f"struct({sql_str(c)} AS column_name, `{c}` AS n_missing)" for c in cols)
    return counted.selectExpr(f"inline(array({rows}))").where("n_missing > 0")


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of several columns in one pass: (column_name, value)."""
    rows = ", ".join(f"struct({sql_str(c)} AS column_name, CAST(`{c}` AS STRING) AS value)" for c in columns)
    return df.selectExpr(f"inline(array({rows}))").distinct().orderBy("column_name", "value")


def date_range(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Row count and first / last date of a timestamp column."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.date_format(F.min(ts), "yyyy-MM-dd").alias("start_date"),
                  F.date_format(F.max(ts), "yyyy-MM-dd").alias("end_date"))
