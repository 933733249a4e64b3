"""Executed-plan shape of every registered query (after AQE), as a Markdown table.

Usage: python tests/plan_summary.py [sf_dir] > PLANS.md
Counts come from the final adaptive plan of the query's last action; work
done while a query is built (materialised tables, writes) is listed under
"built with".
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shape(df):
    df.collect()  # an action on df itself, so its own adaptive plan is final
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Final Plan" in plan:  # adaptive plans print the final and the initial plan
        plan = plan.split("Final Plan", 1)[1].split("Initial Plan", 1)[0]
    lines = plan.split("\n")
    ex = [l for l in lines if re.search(r"\bExchange\b", l) and "Broadcast" not in l and "Reused" not in l]
    single = [l for l in ex if "SinglePartition" in l]
    return {
        "shuffles": len(ex),
        "reused": sum("ReusedExchange" in l for l in lines),
        "broadcasts": sum("BroadcastExchange" in l for l in lines),
        "scans": sum(bool(re.search(r"FileScan|Scan parquet|Scan ExistingRDD|Scan binaryFile", l)) for l in lines),
        "python": sum(bool(re.search(r"MapInArrow|MapInPandas|ArrowEvalPython|PythonMapInArrow", l)) for l in lines),
        "single": len(single),
        "rdd": "ExistingRDD" in plan or "LogicalRDD" in plan or "/tables/" in plan,
        "text_read": ",text:" in plan or "<text:" in plan,
    }


def main():
    import __spark_entry__ as E
    from foldwise.session import build_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    print("| query | shuffles | reused | broadcasts | scans | python steps | single-partition | reads materialised table | reads text |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in sorted(E.queries().items()):
        s = shape(fn(spark, sf_dir))
        print(f"| {name} | {s['shuffles']} | {s['reused']} | {s['broadcasts']} | {s['scans']} | {s['python']} | "
              f"{s['single']} | {'yes' if s['rdd'] else ''} | {'yes' if s['text_read'] else ''} |", flush=True)


if __name__ == "__main__":
    main()
