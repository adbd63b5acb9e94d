"""SparkSession construction and shared-folder helpers.

The library never hard-codes cluster sizing: ``shuffle_partitions`` is only set
when the caller asks for it (tests and the local benchmark). On a cluster the
deployment's own settings win, and AQE coalesces / splits shuffle partitions at
run time.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of this library wants. AQE re-plans joins at run time
# (a join side that turns out small after a shuffle becomes a broadcast, with the
# size checked by Spark) and splits skewed shuffle partitions.
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "retentio",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (or a checkpoint folder already set on the
    context). Only when the session has none (local runs, tests) a fresh local
    folder is registered with ``setCheckpointDir``, so a cluster never ends up
    writing to a machine-local temporary folder. The setting itself is never
    changed at run time (Spark rejects that for core settings).
    """
    sc = spark.sparkContext
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # noqa: BLE001 - not visible as a session setting
            conf_dir = None
    if not conf_dir:
        conf_dir = sc.getCheckpointDir()
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="retentio-")
        sc.setCheckpointDir(conf_dir)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder (never reused, never cleared)."""
    base = shared_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(os.path.dirname(path.removeprefix("file:")), exist_ok=True)
    return path
