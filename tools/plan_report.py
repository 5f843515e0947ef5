"""Summarise the physical plan of every registered query (PLANS.md).

Counts are taken from the plan Spark prints before execution (AQE may still
turn a sort-merge join into a broadcast join at runtime, from measured
sizes). Queries that run jobs while being defined (streams, loads) are
listed without a plan.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EAGER = {"stream_insert_ignore", "stream_window_counts", "stream_apply_changes", "stream_standings",
         "load_then_query", "pistol_rounds_final", "team_pool_final", "assign_match_ids", "column_anchors", "colour_position"}


def summarise(plan: str) -> dict:
    scans = re.findall(r"Scan parquet[^\n]*\n(?:[^\n]*\n)*?Location: [^\[]*\[file:[^\]]*/(\w+)\.parquet\]"
                       r"(?:[^\n]*\n)*?(?:PushedFilters: \[(.*?)\]\n)?ReadSchema: struct<([^>]*)>", plan)
    return {
        "exchanges": len(re.findall(r"^\(\d+\) Exchange", plan, re.M)),
        "smj": len(re.findall(r"^\(\d+\) SortMergeJoin", plan, re.M)),
        "bhj": len(re.findall(r"^\(\d+\) BroadcastHashJoin", plan, re.M)),
        "windows": len(re.findall(r"^\(\d+\) Window", plan, re.M)),
        "generate": len(re.findall(r"^\(\d+\) Generate", plan, re.M)),
        "topk": "TakeOrderedAndProject" in plan,
        "scans": [(t, len(cols.split(",")), f) for t, f, cols in scans],
    }


def main(sf_dir: str, out: str) -> None:
    from roundhouse.plans.catalog import queries
    from roundhouse.session import get_spark
    spark = get_spark("local[8]", 16)
    lines = ["# Physical plans of the registered queries", "",
             f"Generated by `tools/plan_report.py` on `{sf_dir}`. Counts from the plan before",
             "execution (AQE re-plans joins at runtime from measured sizes: small sides become",
             "broadcasts). Scans: table(columns read; filters pushed to Parquet).", "",
             "| query | exchanges | sort-merge / broadcast joins | windows | generate | top-k | scans |",
             "| --- | --- | --- | --- | --- | --- | --- |"]
    for name, fn in queries().items():
        if name in EAGER:
            lines.append(f"| {name} | runs jobs while defined (stream, load or written intermediate) | | | | | |")
            continue
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, sf_dir).explain("formatted")
        s = summarise(buf.getvalue())
        scans = "; ".join(f"{t}({n}{'; ' + f if f else ''})" for t, n, f in s["scans"])
        lines.append(f"| {name} | {s['exchanges']} | {s['smj']} / {s['bhj']} | {s['windows']} | "
                     f"{s['generate']} | {'yes' if s['topk'] else ''} | {scans} |")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main(os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("PLAN_OUT", "PLANS.md"))
