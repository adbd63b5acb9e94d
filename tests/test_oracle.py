"""Differential test: every registered query against its DuckDB oracle SQL at sf0.01
(row count, column names, order-insensitive values)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF001, SF01
from retentio.plans import registry
from retentio.plans.catalog import RAW_TABLES

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


def _norm(v):
    if v is None or type(v).__name__ == "NAType":
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)) or type(v).__name__ == "Timestamp":
        return v.isoformat()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF01)
    got = sdf.toPandas()
    rel = duck.sql(ORACLE[name])
    exp = rel.df()
    assert sorted(got.columns) == sorted(exp.columns)
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    duck_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    assert spark_types == duck_types
    assert len(got) == len(exp)
    assert _rows(got) == _rows(exp)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and df.columns == ["lifecycle_stage", "customers", "churned_count", "churn_rate_pct"]
    assert SF001.endswith("sf0.001")
