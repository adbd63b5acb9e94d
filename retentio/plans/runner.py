"""Batch run of registered queries with per-query error isolation.

The loop runs on the driver over query *names* only; each query is a Spark job
writing its result as CSV (nothing is written for an empty result).
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from retentio.plans.catalog import Catalog
from retentio.plans.registry import REGISTRY
from retentio.sources.sinks import write_result_csv


@dataclass
class RunResult:
    name: str
    status: str          # "written" | "empty" | "error"
    seconds: float
    error: str | None = None
    columns: list[str] = field(default_factory=list)
    preview: list = field(default_factory=list)     # first rows, when asked for


def run_all(spark: SparkSession, sf_dir: str, out_dir: str, names: Iterable[str] | None = None,
            catalog: Catalog | None = None, preview: int = 0) -> list[RunResult]:
    cat = catalog or Catalog(spark, sf_dir)
    results = []
    for name in (list(names) if names is not None else list(REGISTRY)):
        t0 = time.time()
        try:
            df = REGISTRY[name](cat)
            wrote, rows = write_result_csv(df, f"{out_dir.rstrip('/')}/{name}", preview)
            results.append(RunResult(name, "written" if wrote else "empty", time.time() - t0,
                                     columns=df.columns, preview=rows))
        except Exception as e:  # noqa: BLE001 - one failing query must not stop the batch
            results.append(RunResult(name, "error", time.time() - t0, f"{type(e).__name__}: {e}"[:500]))
    return results
