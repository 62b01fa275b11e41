"""Run one catalogue query with Spark's event log on and summarize it.

usage: python tools/stage_times.py <query> [sf_dir]

Prints per-stage wall time / task count / shuffle bytes and the final
(adaptive) physical plan, read from the event log in a fresh scratch folder.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    logdir = tempfile.mkdtemp(prefix="evlog-")
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logdir)
             .config("spark.eventLog.compress", "false")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from shelfgap.session import build_session
    build_session()
    from shelfgap.plans.catalog import QUERIES
    QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    t0 = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    print(f"wall {time.time() - t0:.2f}s")
    spark.stop()
    stages, plans = {}, []
    for path in glob.glob(os.path.join(logdir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        for line in open(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                stages[info["Stage ID"]] = info
            elif kind == "org.apache.spark.sql.execution.ui.SparkListenerSQLAdaptiveExecutionUpdate":
                plans.append(ev["physicalPlanDescription"])
    rows = sorted(stages.values(), key=lambda s: s["Stage ID"])
    tail = rows[len(rows) // 2:]
    for s in tail:
        dur = (s.get("Completion Time", 0) - s.get("Submission Time", 0)) / 1000
        acc = {a["Name"]: a.get("Value") for a in s.get("Accumulables", [])}
        run = int(acc.get("internal.metrics.executorRunTime", 0) or 0) / 1000
        print(f"stage {s['Stage ID']:4d} {dur:6.2f}s cpu={run:6.2f}s tasks={s['Number of Tasks']:3d} "
              f"rows_out={acc.get('internal.metrics.shuffle.write.recordsWritten', 0)} "
              f"shuffle_write={acc.get('internal.metrics.shuffle.write.bytesWritten', 0)} "
              f"{s['Stage Name'][:40]}")
    if plans and os.environ.get("SHOW_PLAN"):
        print(plans[-1][:20000])


if __name__ == "__main__":
    main()
