"""Per-query stage counts and stage time from Spark's event log.

Usage: python tests/stage_times.py [sf_dir] [name ...]
The event log goes to a fresh folder under /tmp (no UI, no server); each
query's jobs carry the query name as job description.
"""

from __future__ import annotations

import collections
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:]
    log_dir = tempfile.mkdtemp(prefix="run-eventlog-")
    from pyspark.sql import SparkSession

    import __spark_entry__ as E
    from foldwise import session as S
    builder = (SparkSession.builder.master("local[8]").appName("foldwise-stages")
               .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{log_dir}")
               .config("spark.eventLog.compress", "false"))
    for k, v in {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                 "spark.sql.autoBroadcastJoinThreshold": "-1",
                 "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB"}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    S.checkpoint_dir(spark)
    qs = E.queries()
    E.entry(spark).collect()
    for name in names or sorted(qs):
        spark.sparkContext.setJobDescription(name)
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobDescription(None)
    spark.stop()

    stage_query, stats = {}, collections.defaultdict(lambda: [0, 0, 0.0, 0.0])
    for path in sorted(glob.glob(f"{log_dir}/**/*", recursive=True)):
        if os.path.isdir(path) or path.endswith(".crc") or "appstatus" in os.path.basename(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        stage_query[sid] = desc
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    q = stage_query.get(info["Stage ID"])
                    if not q or "Completion Time" not in info:
                        continue
                    sec = (info["Completion Time"] - info["Submission Time"]) / 1000
                    st = stats[q]
                    st[0] += 1
                    st[1] += info.get("Number of Tasks", 0)
                    st[2] += sec
                    st[3] = max(st[3], sec)
    print("| query | stages | tasks | stage seconds | longest stage |")
    print("|---|---|---|---|---|")
    for q, (n, tasks, tot, mx) in sorted(stats.items(), key=lambda kv: -kv[1][2]):
        print(f"| {q} | {n} | {tasks} | {tot:.2f} | {mx:.2f} |")
    print(f"\nevent log: {log_dir}", file=sys.stderr)


if __name__ == "__main__":
    main()
