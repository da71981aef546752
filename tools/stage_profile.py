"""Per-stage times of registered queries, read from Spark's event log.

    python tools/stage_profile.py [sf_dir] name [name ...]

Runs each query once to warm up and once measured, with the event log
written to a fresh scratch folder, then prints every stage of the measured
run: wall time, task count, input rows, shuffle bytes written and read.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from wardflow import catalog  # noqa: E402
from wardflow.session import configure  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="wardflow-events-")
    spark = (SparkSession.builder.master("local[8]").appName("wardflow-profile")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    queries = catalog.queries()
    marks = {}
    for name in args:
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.sparkContext.setJobGroup(name, name)
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        marks[name] = True
    spark.stop()

    stages, job_group = [], {}
    paths = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]
    for path in sorted(paths):
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        job_group[sid] = group
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    acc = {a["Name"]: a.get("Value") for a in info.get("Accumulables", [])}
                    stages.append((info["Stage ID"], info["Stage Name"][:60], info["Number of Tasks"],
                                   info.get("Completion Time", 0) - info.get("Submission Time", 0),
                                   acc.get("internal.metrics.input.recordsRead", 0),
                                   acc.get("internal.metrics.shuffle.write.bytesWritten", 0),
                                   acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0)
                                   + acc.get("internal.metrics.shuffle.read.localBytesRead", 0)))
    for name in marks:
        rows = [s for s in sorted(stages) if job_group.get(s[0]) == name]
        print(f"== {name}: {len(rows)} stages, {sum(r[3] for r in rows)} ms of stage time")
        for sid, sname, tasks, ms, inp, sw, sr in rows:
            print(f"  stage {sid:4d} {ms:6d} ms tasks={tasks:4d} in={inp:>9} shuffle_w={sw:>9} "
                  f"shuffle_r={sr:>9}  {sname}")


if __name__ == "__main__":
    main()
