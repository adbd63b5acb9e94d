"""Load-time checks: key uniqueness, row-count gate, post-load verification.

Each check is one aggregation job; none collects rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.functions.expr import mean_sql, round_half_away
from retentio.operators.common import order_aggregated
from retentio.schemas import EXPECTED_SOURCE_ROWS

# Row-count gate rule (tolerance in lines) and its status texts.
GATE_TOLERANCE = 10
GATE_OK, GATE_BAD = "OK", "UNEXPECTED COUNT"



def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1).orderBy(F.desc("n"), key))


def pk_check(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, duplicated keys, null keys and a status.
    One shuffle keyed by the key column (partially aggregated)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return (per_key.agg(F.sum("n").alias("rows"),
                        F.count(key).alias("distinct_keys"),
                        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
                        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"))
            .withColumn("status", F.when((F.col("duplicate_keys") == 0) & (F.col("null_keys") == 0), "OK")
                        .otherwise("KEY VIOLATION")))


def gate_status(lines: Column, expected: Column) -> Column:
    """OK when there is no expectation or |lines - expected| < 10."""
    return (F.when(expected.isNull() | (F.abs(lines - expected) < GATE_TOLERANCE), GATE_OK)
            .otherwise(GATE_BAD))


def row_count_gate(tables: Mapping[str, DataFrame], expected: Mapping[str, Column | int | None]) -> DataFrame:
    """Row-count gate over several tables. ``lines`` counts the header line like
    a newline count of the file does (rows + 1). ``expected`` values may be
    literals or scalar-subquery columns."""
    parts = []
    for name, df in tables.items():
        exp = expected.get(name)
        exp_col = exp if isinstance(exp, Column) else F.lit(exp).cast("long")
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(name).alias("table_name"), exp_col.cast("long").alias("expected_rows"),
                             (F.col("rows") + 1).alias("lines")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", gate_status(F.col("lines"), F.col("expected_rows")))


def verify_customers(subs: DataFrame) -> DataFrame:
    """Post-load verification of the customer table, one pass."""
    return (subs.agg(F.count(F.lit(1)).alias("customers"),
                     F.expr("count_if(churned = 'No')").alias("active"),
                     F.expr("count_if(churned = 'Yes')").alias("churned"),
                     F.sum("monthly_mrr").alias("_s"), F.count("monthly_mrr").alias("_n"))
            .select("customers", "active", "churned",
                    round_half_away(f"{mean_sql('churned', 'customers')} * 100.0D", 1).alias("churn_pct"),
                    round_half_away(mean_sql("_s", "_n"), 2).alias("avg_mrr"),
                    F.expr("CAST(round(_s, 0) AS DOUBLE)").alias("total_mrr")))


def verify_exposures(expo: DataFrame) -> DataFrame:
    """Post-load verification of the experiment table: rows and conversion per arm."""
    return (expo.groupBy("grp")
            .agg(F.count(F.lit(1)).alias("users"), F.sum("converted").alias("_c"), F.count("converted").alias("_n"))
            .select("grp", "users", round_half_away(mean_sql("_c", "_n"), 4).alias("conversion_rate"))
            .transform(order_aggregated, "grp"))


def newline_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row (lines, files): newline bytes of a file, or of a folder's part files with all headers but one
    taken off. Splits are counted in parallel. A last line without a newline is no line, as for any count of newline bytes: it shows
    as the byte by which lines and their ends exceed the file's size."""
    text = spark.read.option("lineSep", "\n").text(path)
    per_file = (text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("n"))
                .groupBy("file", "size").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("n") + 1).alias("bytes")))
    return per_file.agg(F.coalesce(F.sum(F.col("lines") - (F.col("bytes") - F.col("size"))), F.lit(0)).alias("_lines"), F.count(F.lit(1)).alias("files")).select(
        (F.col("_lines") - F.greatest(F.col("files") - 1, F.lit(0))).alias("lines"), "files")


def file_line_gate(spark: SparkSession, files: Mapping[str, str],
                   expected: Mapping[str, Column | int | None] | None = None) -> DataFrame:
    """Row-count gate on source files: newline bytes of each file (header included)
    against the expected row count (default: the original files' counts;
    literals or scalar-subquery columns)."""
    exp = dict(EXPECTED_SOURCE_ROWS if expected is None else expected)
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    parts = [newline_counts(spark, path)
             .select(F.lit(name).alias("file_name"), as_column(exp.get(name)).cast("long").alias("expected_rows"), "lines")
             for name, path in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", gate_status(F.col("lines"), F.col("expected_rows")))
