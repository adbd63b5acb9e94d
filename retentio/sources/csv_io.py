"""CSV load path of the two source files.

* ``read_customers_csv`` — header skipped, columns mapped by POSITION onto the
  21 table names, whitespace-only lifetime value -> null; damaged lines become
  nulls, fail the load or go to a table of rejects;
* ``read_customers_renamed`` — the notebook path: header names, explicit rename
  map, CamelCase -> snake_case for the rest (schema only, no data pass),
  numeric coercion (bad text -> null), churn flag and notebook stage;
* ``read_ab_csv`` — positional mapping (timestamp -> ts, group -> grp), '' -> null;
* ``write_customers_csv`` / ``write_ab_csv`` — write a table in the source
  layout (used to round-trip derived data through the load path).

Every reader declares its schema; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.expr import blank_to_null, lifecycle_stage, to_snake, yes_flag
from retentio.schemas import (
    AB_CSV_HEADER, AB_RENAMES, AB_TEST_SCHEMA, CUSTOMER_CSV_HEADER, CUSTOMER_RENAMES, CUSTOMERS_SCHEMA, FILE_ORDER,
)


def _all_strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


REJECT_FIELDS = "wrong number of fields"
DAMAGED = "_damaged"


def scan_customers_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Every line of the customer file, by position: the 21 typed columns, ``line`` (the text) and
    ``reject_reason``: null for a sound line, else what is wrong with it (number of fields, or the columns whose text is no
    number of the column's type). A blank lifetime value is sound."""
    names = [f.name for f in CUSTOMERS_SCHEMA.fields]
    # the reader keeps the text of lines with too few or too many fields in the extra column; it would not
    # count fields if it left out columns that the query does not use
    raw = (spark.read.option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnPruning", False)
           .option("columnNameOfCorruptRecord", DAMAGED).schema(_all_strings([*names, DAMAGED])).csv(path))
    cols, bad = [], []
    for f in CUSTOMERS_SCHEMA.fields:
        text = blank_to_null(F.col(f.name)) if f.name == "lifetime_value" else F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            cols.append(text.alias(f.name))
        else:
            cols.append(text.try_cast(f.dataType).alias(f.name))
            bad.append(F.when(text.isNotNull() & text.try_cast(f.dataType).isNull(), F.lit(f"bad {f.name}")))
    reason = F.when(F.col(DAMAGED).isNotNull(), REJECT_FIELDS).otherwise(F.nullif(F.concat_ws(", ", *bad), F.lit("")))
    return raw.select(*cols, F.coalesce(F.col(DAMAGED), F.to_csv(F.struct(*names))).alias("line"), reason.alias("reject_reason"))


def read_customers_csv(spark: SparkSession, path: str, on_error: str = "null", header: bool = True) -> DataFrame:
    """The customer table. ``on_error`` says what a damaged line does:

    * ``"null"``: bad numbers and missing fields become null (the notebook's coercion);
    * ``"fail"``: the load fails and names the line, like a bulk load that takes a file whole or not at all;
    * ``"reject"``: the line is left out; ``rejected_customers`` has it, with the reason.
    """
    rows = scan_customers_csv(spark, path, header)
    names = [f.name for f in CUSTOMERS_SCHEMA.fields]
    if on_error == "reject":
        rows = rows.where("reject_reason IS NULL")
    elif on_error == "fail":
        # as a filter, so that it is evaluated whichever columns are read
        broken = F.raise_error(F.concat(F.lit("damaged line: "), F.col("reject_reason"), F.lit(": "), F.col("line")))
        rows = rows.where(F.when(F.col("reject_reason").isNull(), F.lit(True)).otherwise(broken.cast("boolean")))
    elif on_error != "null":
        raise ValueError(f"unknown on_error {on_error!r}")
    return rows.select(*names)


def rejected_customers(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(customer_id, reject_reason, line) of the damaged lines."""
    return (scan_customers_csv(spark, path, header).where("reject_reason IS NOT NULL")
            .select("customer_id", "reject_reason", "line"))


def read_customers_renamed(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).schema(_all_strings(CUSTOMER_CSV_HEADER)).csv(path)
    renamed = raw.withColumnsRenamed(CUSTOMER_RENAMES)
    snake = renamed.toDF(*[to_snake(c) for c in renamed.columns])
    typed = snake.withColumns({
        "senior_citizen": F.col("senior_citizen").try_cast("int"),
        "subscription_months": F.col("subscription_months").try_cast("int"),
        "monthly_mrr": F.col("monthly_mrr").try_cast("double"),
        "lifetime_value": F.trim("lifetime_value").try_cast("double"),
        "churned_flag": yes_flag("churned"),
    })
    return typed.withColumn("lifecycle_stage", lifecycle_stage("subscription_months", "notebook"))


def row_place() -> Column:
    """Sortable place of a row in its source files: folder, number of the part file (0 for other names), file
    name, start of the split in the file, and a number that rises along the split. A split is read by
    one task from its start to its end, so the order is that of the file however many tasks read it."""
    name = F.col("_metadata.file_name")
    return F.struct(
        F.regexp_replace(F.col("_metadata.file_path"), "[^/]*$", "").alias("folder"),
        F.coalesce(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), F.lit(0)).alias("part"), name.alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_ab_csv(spark: SparkSession, path: str, file_order: bool = False) -> DataFrame:
    """The experiment table; ``file_order=True`` adds the column ``FILE_ORDER`` (``row_place``), by which
    "first row" means the first in the file."""
    df = (spark.read.option("header", True).option("enforceSchema", True)
          .option("nullValue", "").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
          .schema(AB_TEST_SCHEMA).csv(path))
    return df.select("*", row_place().alias(FILE_ORDER)) if file_order else df


def write_customers_csv(subs: DataFrame, path: str) -> None:
    """Write ``subscriptions`` in the source file's layout: 21 columns with the
    source header; columns the table lacks are blank; a null lifetime value is a
    single space, as in the original file."""
    by_name = {v: k for k, v in CUSTOMER_RENAMES.items()}
    by_name["payment_method"] = "PaymentMethod"
    present = {by_name.get(c, c): c for c in subs.columns}
    cols = []
    for h in CUSTOMER_CSV_HEADER:
        if h in present:
            c = F.col(present[h]).cast("string")
            if h == "TotalCharges":
                c = F.coalesce(c, F.lit(" "))
            cols.append(c.alias(h))
        else:
            cols.append(F.lit(None).cast("string").alias(h))
    (subs.select(*cols).write.mode("overwrite").option("header", True)
     .option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path))


def write_ab_csv(expo: DataFrame, path: str) -> None:
    cols = [F.col(AB_RENAMES.get(h, h)).alias(h) for h in AB_CSV_HEADER]
    (expo.select(*cols).write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
