"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (the whole plan
executes, nothing is collected), best of ``BENCH_REPEAT`` runs (default 2).
One JSON line is printed:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    # best of two runs per query: the first run of a plan also pays code
    # generation and file-system caches; the minimum is the steadier number
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))

    from roundhouse.session import get_spark
    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    log_dir = None
    if os.environ.get("BENCH_PROFILE", "1") != "0":
        # Spark's event log in a scratch folder of this local run: stage and task
        # metrics per query without the web UI
        import tempfile
        log_dir = tempfile.mkdtemp(prefix="run-eventlog-", dir=os.environ.get("TMPDIR", "/tmp"))
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="roundhouse-bench",
                      extra=extra)
    from roundhouse.plans.catalog import queries

    qs = queries()
    names = only or list(qs)
    # warm-up: JVM, Parquet footers and code generation of one typical plan
    qs["winrate_on_map_groups"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in names:
        best = None
        for rep in range(repeat):
            spark.sparkContext.setJobDescription(f"{name}#{rep}")
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
        print(f"# {name}: {best:.3f}s", file=sys.stderr, flush=True)

    spark.sparkContext.setJobDescription(None)
    final = {}
    if os.environ.get("BENCH_FINAL", "1") != "0" and not only:
        final = bench_final_tables(spark, sf_dir)

    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "repeat": repeat,
    }
    if final:
        out["final_tables"] = final
        out["final_tables_value"] = round(sum(v for k, v in final.items() if k != "etl_load"), 3)
    spark.stop()
    if log_dir:
        out["profile"] = profile_from_event_log(log_dir)
    print(json.dumps(out))


def _log_lines(path: str):
    """Lines of one event-log file (Spark 4 writes zstd-compressed rolling files)."""
    import io
    if path.endswith(".zstd"):
        import zstandard
        with open(path, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    elif not path.endswith((".lz4", ".snappy", ".lzf")):
        with open(path, encoding="utf-8") as f:
            yield from f


def profile_from_event_log(log_dir: str) -> dict[str, dict]:
    """Per query (first run): stages, tasks, rows read from files, rows and MB shuffled."""
    import glob
    job_query: dict[int, str] = {}
    stage_query: dict[int, str] = {}
    prof: dict[str, dict] = {}
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "events_*"), recursive=True)):
        for line in _log_lines(path):
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description") or ""
                    if desc.endswith("#0"):
                        q = desc[:-2]
                        job_query[ev["Job ID"]] = q
                        for sid in ev.get("Stage IDs", []):
                            stage_query[sid] = q
                elif kind == "SparkListenerTaskEnd":
                    q = stage_query.get(ev.get("Stage ID"))
                    m = ev.get("Task Metrics") or {}
                    if q is None or not m:
                        continue
                    p = prof.setdefault(q, {"stages": set(), "tasks": 0, "input_rows": 0,
                                            "shuffle_rows": 0, "shuffle_mb": 0.0})
                    p["stages"].add(ev["Stage ID"])
                    p["tasks"] += 1
                    p["input_rows"] += (m.get("Input Metrics") or {}).get("Records Read", 0)
                    sw = m.get("Shuffle Write Metrics") or {}
                    p["shuffle_rows"] += sw.get("Shuffle Records Written", 0)
                    p["shuffle_mb"] += sw.get("Shuffle Bytes Written", 0) / 2**20
    return {q: {"stages": len(p["stages"]), "tasks": p["tasks"], "input_rows": p["input_rows"],
                "shuffle_rows": p["shuffle_rows"], "shuffle_mb": round(p["shuffle_mb"], 2)}
            for q, p in sorted(prof.items())}


def bench_final_tables(spark, sf_dir: str) -> dict[str, float]:
    """The production path: ETL into stored final tables once (results also
    pre-joined with their match), then the questions on them."""
    import uuid

    from roundhouse.plans.load import FinalTables, load_final_tables
    from roundhouse.plans.named import named_questions
    from roundhouse.session import scratch_path

    folder = scratch_path(spark, "bench-final", uuid.uuid4().hex)
    t0 = time.perf_counter()
    load_final_tables(spark, sf_dir, folder, 0)
    res = {"etl_load": round(time.perf_counter() - t0, 3)}
    f = FinalTables(spark, folder)
    runs = named_questions(f)
    for name, build in runs.items():
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        res[name] = round(time.perf_counter() - t0, 3)
        print(f"# final/{name}: {res[name]:.3f}s", file=sys.stderr, flush=True)
    return res


if __name__ == "__main__":
    main()
