"""Per-query jobs, stages, tasks, shuffle bytes and executor time from Spark's
event log (written to a fresh scratch folder), for every registered query over
the loaded tables. Writes STAGES.md.

usage: python scripts/stage_report.py [sf_dir] [out.md]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from retentio.plans.catalog import Catalog  # noqa: E402
from retentio.plans.registry import REGISTRY  # noqa: E402
from retentio.session import get_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out_md = sys.argv[2] if len(sys.argv) > 2 else os.path.join(ROOT, "STAGES.md")
    scratch = tempfile.mkdtemp(prefix="stages-")
    log_dir = os.path.join(scratch, "eventlog")
    os.makedirs(log_dir)
    spark = get_session("local[8]", shuffle_partitions=8,
                        extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                    "spark.eventLog.compress": "false",
                                    "spark.checkpoint.dir": os.path.join(scratch, "shared")})
    sc = spark.sparkContext
    cat = Catalog(spark, sf_dir).load(os.path.join(scratch, "loaded"))
    for name, fn in REGISTRY.items():
        sc.setJobGroup(name, name)
        fn(cat).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("done", "done")
    spark.stop()

    job_query, stage_job = {}, {}
    stats = defaultdict(lambda: {"jobs": 0, "stages": set(), "tasks": 0, "shuffle_write": 0,
                                 "shuffle_read": 0, "input": 0, "run_ms": 0})
    for path in sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)
                       if os.path.isfile(p)):
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    if group in REGISTRY:
                        job_query[ev["Job ID"]] = group
                        stats[group]["jobs"] += 1
                        for sid in ev.get("Stage IDs", []):
                            stage_job[sid] = ev["Job ID"]
                elif kind == "SparkListenerTaskEnd":
                    q = job_query.get(stage_job.get(ev.get("Stage ID")))
                    if q is None:
                        continue
                    s = stats[q]
                    s["tasks"] += 1
                    s["stages"].add(ev["Stage ID"])
                    m = ev.get("Task Metrics") or {}
                    s["shuffle_write"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    r = m.get("Shuffle Read Metrics") or {}
                    s["shuffle_read"] += r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)
                    s["input"] += (m.get("Input Metrics") or {}).get("Bytes Read", 0)
                    s["run_ms"] += m.get("Executor Run Time", 0)

    lines = ["# Stages, tasks and shuffle volume per query", "",
             f"From Spark's event log, one run of every registered query over the loaded tables of "
             f"`{sf_dir}` (local[8], 8 shuffle partitions, AQE on), generated by `scripts/stage_report.py`.",
             "Stages skipped because their shuffle output was reused are not counted.", "",
             "| query | jobs | stages | tasks | input bytes | shuffle write bytes | executor ms |",
             "| --- | --- | --- | --- | --- | --- | --- |"]
    for name in REGISTRY:
        s = stats.get(name)
        if not s:
            continue
        lines.append(f"| {name} | {s['jobs']} | {len(s['stages'])} | {s['tasks']} | {s['input']} | "
                     f"{s['shuffle_write']} | {s['run_ms']} |")
    with open(out_md, "w") as f:
        f.write("\n".join(lines) + "\n")
    print(f"wrote {out_md}")


if __name__ == "__main__":
    main()
