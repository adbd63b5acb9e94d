"""retentio — subscription and experiment analytics as Spark DataFrame operators.

Every operator is a pure function ``DataFrame -> DataFrame`` (or builds a
``Column``); nothing iterates over rows on the driver. Sub-packages:

* ``sources``   — table readers, the test-data adapters, CSV load path, sinks, load checks
* ``functions`` — row-level column expressions (stages, buckets, bins, bands, rounding, erfc)
* ``operators`` — the analytical operators (reports, measures, dashboard, cohorts,
                  data quality, workbook tables, experiment analysis, churn drivers)
* ``plans``     — catalog of inputs, query registry, DuckDB oracle SQL, batch runner
* ``streaming`` — incremental (exactly-once) table load on Structured Streaming
"""

__version__ = "0.1.0"
