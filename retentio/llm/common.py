"""Helpers shared by the training-data operators: words, written intermediates,
ordered neighbours and running sums that never pass through one task."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Word separators of the contracts: space and the control characters tab to CR.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else left as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``. Only on a
    local master without that setting a fresh local folder takes its place."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="retentio-llm-")
    spark.sparkContext.setCheckpointDir(path)
    return path


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: the lineage is
    cut and a lost executor only costs a re-read. The shuffle files of the write are
    deleted when it ends rather than when the driver next collects garbage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, once nothing reads them any more."""
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.saved_path)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def sliced(df: DataFrame, key: str, out: str, slices: int | None = None) -> DataFrame:
    """Add ``out``: the number of the slice of ``key``'s value range that a row falls in,
    ascending, about equally many rows each (null keys: slice -1). The driver holds the
    slice bounds only: 4 per shuffle partition, found by ``approx_percentile``. The two-step
    search compares a row with about 2 * sqrt(slices) bounds."""
    n = slices or 4 * shuffle_parts(df.sparkSession)
    at = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    got = df.agg(F.percentile_approx(key, at, 10 * max(n, 100)).alias("b")).first()["b"] or []
    bounds = sorted(set(got))
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)] or [[]]
    typ = df.schema[key].dataType.simpleString()
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast(f"array<{typ}>")
    coarse = F.size(F.filter(lit([g[-1] for g in groups[:-1]]), lambda b: b < F.col(key)))
    fine = F.size(F.filter(F.get(F.array(*[lit(g) for g in groups]), coarse), lambda b: b < F.col(key)))
    return df.withColumn(out, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(coarse * step + fine))


def running_sum(df: DataFrame, by: list[str], part: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` (null counts 0) per ``by`` in the order of (``part``,
    ``order``). One window per (by, part); the totals of the parts are summed up on their own,
    a row for each (by, part), and joined back, so that no group is ever in one task."""
    v = F.coalesce(F.col(value), F.lit(0)).cast("long")
    inner = Window.partitionBy(*by, part).orderBy(*order)
    within = df.withColumn("_in", F.coalesce(F.sum(v).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = df.groupBy(*by, part).agg(F.sum(v).alias("_t"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    for c in [*by, part]:
        totals = totals.withColumnRenamed(c, f"_k_{c}")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, part]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return (within.join(totals, cond, "left").withColumn(out, F.col("_in") + F.col("_off"))
            .drop("_in", "_off", *[f"_k_{c}" for c in [*by, part]]))
