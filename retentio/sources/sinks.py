"""Sinks: table creation, idempotent load, per-query CSV output, report tables."""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.operators import workbook
from retentio.schemas import FILE_ORDER
from retentio.sources.csv_io import row_place

MANIFEST = "_manifest"      # below the table's folder; readers skip names that begin with _


class LoadConflict(RuntimeError):
    """A table folder holds something else than the load that was asked for."""


def create_table_if_not_exists(spark: SparkSession, name: str, schema: T.StructType, path: str) -> None:
    """Fixed-schema parquet table at ``path`` (DDL ``CREATE TABLE IF NOT EXISTS``)."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet LOCATION '{path}'")


def _file_system(spark: SparkSession, path: str):
    """(Hadoop file system of the path's scheme, the path)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return bool(fs.exists(p))


def write_completed(spark: SparkSession, path: str) -> bool:
    """Whether a Spark write to ``path`` finished (its ``_SUCCESS`` marker exists)."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


@dataclass(frozen=True)
class Manifest:
    """What a load wrote: a digest of the source's files and its schema, how many files, and the rows."""
    source: str
    files: int
    rows: int


def source_of(df: DataFrame, label: str = "") -> tuple[str, int]:
    """(digest of the files that ``df`` reads, its schema and ``label``; number of files)."""
    files = sorted(df.inputFiles())
    text = "\n".join([label, df.schema.simpleString(), *files])
    return hashlib.sha256(text.encode()).hexdigest(), len(files)


def read_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest of the table at ``path``, if a load of this module completed there."""
    where = f"{path.rstrip('/')}/{MANIFEST}"
    if not write_completed(spark, where):
        return None
    row = spark.read.schema("source string, files long, rows long").json(where).first()
    return Manifest(row["source"], row["files"], row["rows"])


def load_once(df: DataFrame, path: str, label: str = "") -> bool:
    """Idempotent load: returns whether it wrote.

    A table that an earlier load of the same source (files, schema, label) filled is kept. An empty table
    does not count as loaded, nor does a folder that an interrupted write left: both are written anew. A
    table of another source, or one without a manifest, is refused with ``LoadConflict`` and left as it is.
    The manifest is written after the data, with the number of rows in the written files' footers.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    source, files = source_of(df, label)
    there = read_manifest(spark, path)
    if there is not None and there.rows > 0:
        if there.source != source:
            raise LoadConflict(f"{path} holds {there.rows} rows of another source")
        return False
    if there is None and write_completed(spark, path):
        raise LoadConflict(f"{path} holds a table that this loader did not write")
    df.write.mode("overwrite").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).count()
    spark.range(1).select(F.lit(source).alias("source"), F.lit(files).alias("files"), F.lit(rows).alias("rows")).coalesce(1).write.json(f"{path}/{MANIFEST}")
    return True


def write_result_csv(df: DataFrame, path: str, preview: int = 0) -> tuple[bool, list]:
    """Write a query result as CSV with a header; nothing is written for an empty
    result, and what ``path`` held before then stays. Returns (whether anything was written, the first
    ``preview`` rows).

    The query runs once and nothing is persisted: the rows are counted while they are written to a
    folder beside ``path``, which takes its place if there are any; a preview reads the written files.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    staged = f"{path}-writing-{uuid.uuid4().hex}"
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.option("header", True).csv(staged)
    fs, there = _file_system(spark, staged)
    if not counted.get["rows"]:
        fs.delete(there, True)
        return False, []
    _, target = _file_system(spark, path)
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(there, target):
        raise OSError(f"could not move {staged} to {path}")
    if not preview:
        return True, []
    written = spark.read.option("header", True).schema(df.schema).csv(path).select("*", row_place().alias(FILE_ORDER))
    return True, written.orderBy(FILE_ORDER).limit(preview).drop(FILE_ORDER).collect()


def write_report_tables(subs: DataFrame, out_dir: str, ltv_edges=workbook.LTV_EDGES_REFERENCE) -> list[str]:
    """The workbook's content as one parquet table per sheet / section."""
    out_dir = out_dir.rstrip("/")
    tables = {
        "raw_data": workbook.raw_data(subs),
        "kpis": workbook.kpi_block(subs),
        "mrr_by_plan": workbook.active_mrr_by_plan_label(subs),
        "churn_by_plan": workbook.churn_by_plan_label(subs),
        "ltv_distribution": workbook.ltv_distribution(subs, ltv_edges),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")
    return list(tables)
