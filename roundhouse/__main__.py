"""Command line: ``python -m roundhouse <command> ...``

  questions --data DIR --out DIR [--names a,b]   run registered questions, one CSV folder each
  questions --final DIR --out DIR [--names a,b]  run the named questions on loaded final tables
  report    --data|--final DIR --out DIR [--format csv]  the report's named sheets + row counts
  load      --data DIR --out DIR [--version N] [--csv DIR]
                                                 ETL into versioned final tables

``--event``, ``--player-event``, ``--year``, ``--matches-year``, ``--team`` and ``--min-maps``
set what the named questions and the report are about.

``--data`` is a folder of the input Parquet tables, ``--final`` one that ``load`` wrote. On a cluster submit it with
``spark-submit -m roundhouse ...`` or run it from a driver with the cluster's
session settings; ``--master`` is only for local runs.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="roundhouse")
    ap.add_argument("command", choices=["questions", "report", "load"])
    source = ap.add_mutually_exclusive_group(required=True)
    source.add_argument("--data")
    source.add_argument("--final", help="folder of loaded final tables (questions, report)")
    from .plans.named import Choice
    for f in fields(Choice):
        ap.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    ap.add_argument("--out", required=True)
    ap.add_argument("--names", default="")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--version", type=int, default=0)
    ap.add_argument("--csv", default="", help="folder of the four source CSV files (load)")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)

    from .session import get_spark
    spark = get_spark(a.master)
    spark.conf.set("spark.sql.session.timeZone", "UTC")

    choice = Choice(**{f.name: getattr(a, f.name) for f in fields(Choice)})
    names = [n for n in a.names.split(",") if n]
    if a.command == "load" and not a.data:
        ap.error("load reads --data")
    if a.command == "questions" and a.final:
        from .plans.load import FinalTables
        from .plans.named import named_questions
        from .sources.sinks import write_report
        asked = named_questions(FinalTables(spark, a.final), choice)
        sheets = {n: asked[n]() for n in names or asked}
        print(json.dumps(write_report(sheets, a.out, fmt=a.format, skip_empty=False), indent=1))
    elif a.command == "questions":
        from .plans.catalog import queries
        from .plans.sql import save_results
        print(json.dumps(save_results(spark, a.data, names or sorted(queries()), a.out), indent=1))
    elif a.command == "report":
        from .plans.catalog import Tables, report_sheets
        from .plans.load import FinalTables
        from .sources.sinks import write_report
        tables = FinalTables(spark, a.final) if a.final else Tables(spark, a.data)
        sheets = report_sheets(tables, choice.event, choice.player_event, choice.min_maps)
        counts: dict[str, int] = {}
        # a workbook keeps empty sheets (only chart output is skipped when empty)
        written = write_report(sheets, a.out, fmt=a.format, skip_empty=False, counts=counts)
        print(json.dumps({"written": written, "rows": counts | {"__total__": sum(counts.values())}}, indent=1))
    else:
        from .plans.load import load_final_tables, staging_from_csv
        staged = staging_from_csv(spark, a.csv) if a.csv else None
        load_final_tables(spark, a.data, a.out, a.version, staged=staged)
        print(json.dumps({"loaded": a.out, "version": a.version}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
