"""Inline literal tables of the semantic model (plan dimension, data dictionary).

They are tiny and fixed, so joining them is a broadcast with a proven size bound
(a ``LocalRelation`` of 3 / 14 rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.schemas import (
    DATA_DICTIONARY, DATA_DICTIONARY_SCHEMA, PLAN_DIMENSION, PLAN_DIMENSION_SCHEMA,
)


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A small fixed table as an inline ``VALUES`` relation (a LocalRelation whose
    size the planner knows, so joins with it are broadcast without a hint)."""
    names = [f.name for f in schema.fields]
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    cols = ", ".join(f"CAST(`{n}` AS {f.dataType.simpleString()}) AS `{n}`"
                     for n, f in zip(names, schema.fields))
    return spark.sql(f"SELECT {cols} FROM VALUES {values} AS t({', '.join('`' + n + '`' for n in names)})")


def plan_dimension(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PLAN_DIMENSION, PLAN_DIMENSION_SCHEMA)


def data_dictionary(spark: SparkSession) -> DataFrame:
    """The hidden dictionary table, sorted by Type like the report's table visual."""
    return literal_table(spark, DATA_DICTIONARY, DATA_DICTIONARY_SCHEMA).orderBy("Type")


def with_plan_labels(facts: DataFrame) -> DataFrame:
    """Many-to-one join fact -> plan dimension on ``plan_type`` (left: an unknown
    plan keeps a null label)."""
    dim = plan_dimension(facts.sparkSession)
    return facts.join(F.broadcast(dim), "plan_type", "left")
