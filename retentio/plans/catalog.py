"""Catalog: where the operators get their input DataFrames.

A catalog either derives ``subscriptions`` / ``exposures`` from the raw test
tables on every use (the default, used by the registered queries), or reads
them from a loaded copy written once by :meth:`Catalog.load` (the workflow of a
deployment: load once, run many reports).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retentio.sources import adapters
from retentio.sources.sinks import load_once

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")


class Catalog:
    """Input tables of one session. Each table's DataFrame is built once per
    catalog and reused by every query (one file listing / footer read per table,
    which matters on object stores with many files)."""

    def __init__(self, spark: SparkSession, sf_dir: str, loaded_dir: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.loaded_dir = loaded_dir.rstrip("/") if loaded_dir else None
        self._frames: dict[str, DataFrame] = {}

    def _read(self, key: str, path: str) -> DataFrame:
        if key not in self._frames:
            self._frames[key] = self.spark.read.parquet(path)
        return self._frames[key]

    def raw(self, name: str) -> DataFrame:
        return self._read(f"raw:{name}", f"{self.sf_dir}/{name}.parquet")

    def subscriptions(self) -> DataFrame:
        if self.loaded_dir:
            return self._read("subscriptions", f"{self.loaded_dir}/subscriptions")
        if "subscriptions" not in self._frames:
            self._frames["subscriptions"] = adapters.subscriptions(self.raw("customer"), self.raw("orders"))
        return self._frames["subscriptions"]

    def exposures(self) -> DataFrame:
        if self.loaded_dir:
            return self._read("exposures", f"{self.loaded_dir}/exposures")
        if "exposures" not in self._frames:
            self._frames["exposures"] = adapters.exposures(self.raw("events"))
        return self._frames["exposures"]

    def subscriptions_with_gaps(self) -> DataFrame:
        return adapters.with_subscription_gaps(self.subscriptions())

    def source_customers(self) -> DataFrame:
        """The customer table with the service columns of the source file."""
        return adapters.with_services(self.subscriptions())

    def exposures_with_gaps(self) -> DataFrame:
        return adapters.with_exposure_gaps(self.exposures())

    def load(self, target_dir: str) -> "Catalog":
        """Write both derived tables once and return a catalog that reads them.

        A table that an earlier load of the same files filled is kept, so a re-run does
        not load twice; an empty table and a folder left by an interrupted write are
        overwritten, and a table of other files is refused (``load_once``).
        ``target_dir`` should be a folder every executor can read.
        """
        target_dir = target_dir.rstrip("/")
        # Rows are clustered by plan inside each written file (a per-task sort, no
        # shuffle), so a plan filter can skip parquet row groups by their statistics.
        subs = self.subscriptions().sortWithinPartitions("plan_type")
        for name, df in (("subscriptions", subs), ("exposures", self.exposures())):
            load_once(df, f"{target_dir}/{name}", name)
        return Catalog(self.spark, self.sf_dir, target_dir)

