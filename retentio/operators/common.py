"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.expr import sql_str

MAX_PIVOT_COLUMNS = 100     # values beyond these share one column
REST_COLUMN = "(other)"


def order_aggregated(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Final ORDER BY of an *aggregated* result whose row count is bounded by the
    grouping keys' domain (a handful of plans, stages, buckets, arms).

    The rows are gathered into one partition and sorted there, which skips the
    sampling job and extra stage of a range-partitioned global sort. Never used
    for row-level outputs or results whose size grows with the data — those keep
    ``orderBy``.
    """
    return df.coalesce(1).sortWithinPartitions(*cols)


def pivot_present(df: DataFrame, by: Sequence[str], key: str, known: Sequence[str], cell: Callable[[str], Column],
                  most: int = MAX_PIVOT_COLUMNS) -> DataFrame:
    """Pivot over the values that occur: one column for each ``known`` value and, in their order, for
    each further value of ``key``; values after the first ``most`` share the column ``REST_COLUMN``.

    ``cell(condition)`` gives the aggregate of a column from the SQL condition that its rows meet. The list
    of further values is a first, small job (a partially aggregated distinct, at most ``most`` + 1
    values come back); the cells are conditional aggregates of one pass over the rows.
    """
    quoted = ", ".join(sql_str(v) for v in known)
    new = (df.where(F.expr(f"`{key}` IS NOT NULL AND `{key}` NOT IN ({quoted})") if known else F.col(key).isNotNull())
           .select(F.col(key).alias("v")).distinct().orderBy("v").limit(most + 1))
    found = [r["v"] for r in new.collect()]
    names = [*known, *found[:most]]
    cells = [cell(f"`{key}` = {sql_str(v)}").alias(v) for v in names]
    if len(found) > most:
        listed = ", ".join(sql_str(v) for v in names)
        cells.append(cell(f"`{key}` NOT IN ({listed})").alias(REST_COLUMN))
    return df.groupBy(*by).agg(*cells)
