"""Staging -> final tables as written Parquet (the reference's ETL order).

A final table is a folder of versions ``version=<n>``; a load writes only
the rows that are new against all earlier versions (insert-if-absent), so
a load costs the size of its input plus a key-only scan of the table, not a
rewrite. Version folders are written in overwrite mode and a load reads only
the versions before its own, so re-running a load is idempotent. Inside a
version the rows are partitioned by ``event_id``: per-event questions read
one partition (partition pruning).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_best_of
from ..operators.etl import insert_ignore
from ..session import materialize
from ..sources.tables import CountedSource, TableSource
from . import adapters as A

# the reference's load order and keys; None = no known constraint (append).
# economy keeps its staged rows: the pistol-round question counts them
FINAL_TABLES = [
    ("events", ["event_id"]),
    ("matches", ["match_id"]),
    ("results", None),
    ("picks", ["match_id"]),
    ("players_raw", None),
    ("economy", None),
]
# derived at load time: results joined once with their match (teams, date)
WIDE = "results_wide"
WAITING = "results_waiting"  # results whose match has not been loaded yet


def read_final(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """All versions of a final table (None before the first load)."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.option("basePath", f"{folder}/{table}").parquet(f"{folder}/{table}/version=*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


# rows sorted by date inside each event partition: Parquet row-group min/max
# statistics then let year filters skip most row groups
SORT_BY = {"matches": ["match_date", "match_id"], WIDE: ["match_date", "match_id"]}


class Staged(NamedTuple):
    """A staged table as the narrow rows that are dealt to its writers (match_id, event_id and what
    else its columns are made of) and ``finish``, which makes the columns of them row by row, there.

    ``finish(rows, keep)`` passes the columns named in ``keep`` through. ``keyed``: the smallest
    row of a key makes the smallest row of the table, so keys may be decided on ``rows``.
    """

    rows: DataFrame
    finish: Callable[..., DataFrame]
    keyed: bool = False

    def frame(self) -> DataFrame:
        return self.finish(self.rows)


def _staged(new: DataFrame | Staged) -> Staged:
    if isinstance(new, Staged):
        return new
    columns = new.columns
    return Staged(new, lambda rows, keep=(): rows.select(*columns, *keep), True)


def _fresh(new: DataFrame | Staged, folder: str, table: str, keys: list[str] | None, version: int) -> Staged:
    """The rows of ``new`` that the table does not hold yet before ``version``."""
    staged = _staged(new)
    if not keys:
        return staged
    if not staged.keyed:
        staged = _staged(staged.frame())
    fresh = insert_ignore(staged.rows, None, keys)
    current = read_final(staged.rows.sparkSession, folder, table)
    if current is not None:
        fresh = fresh.join(_grown(current.filter(F.col("version") < version).select(*keys)), keys, "left_anti")
    return staged._replace(rows=fresh)


def _grown(df: DataFrame) -> DataFrame:
    """Rows of a loaded table as a side of a join: never broadcast. Its files are packed so well that Spark
    takes millions of rows for a few MB and would build them in the driver's memory."""
    return df.hint("merge")


def load_increment(new: DataFrame | Staged, folder: str, table: str, keys: list[str] | None,
                   version: int) -> None:
    """Write the rows of ``new`` that the table does not hold yet as ``version``."""
    fresh = _fresh(new, folder, table, keys, version)
    _write(fresh.finish(_by_event(fresh.rows)), SORT_BY.get(table, keys), f"{folder}/{table}/version={version}")


def _by_event(df: DataFrame) -> DataFrame:
    """REBALANCE(event_id) groups each event's rows into few tasks (few files per event
    instead of one per task and event) and lets AQE split an event holding a large share
    of the rows over several tasks."""
    return df.hint("rebalance", "event_id") if "event_id" in df.columns else df


def _write(df: DataFrame, order: list[str] | None, path: str) -> None:
    """Write rows dealt by event, partitioned by event and sorted inside each file."""
    if order:
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if "event_id" in df.columns:
        writer = writer.partitionBy("event_id")
    writer.parquet(path)


def staged_tables(src: TableSource) -> dict[str, DataFrame | Staged]:
    """The staging tables (as the CSV loads would fill them) in final-table shape."""
    economy = A.economy(src)
    return {
        # the events of results rows, whatever their map
        "events": A.results(src, with_map=False).select("event_id").distinct()
                   .withColumn("event_name", F.lit(None).cast("string")),
        "matches": economy.select(
            "match_id", "event_id", F.col("date").alias("match_date"), "team_1", "team_2",
            clean_best_of("best_of").alias("best_of")),
        "results": Staged(A.result_lines(src, detail=True), lambda rows, keep=(): A.result_columns(rows, True, keep)),
        "picks": Staged(A.pick_lines(src), A.pick_columns, True),
        "players_raw": Staged(A.player_lines(src), lambda rows: A.player_columns(rows, src, True)
                              .withColumnRenamed("date", "match_date")),
        "economy": Staged(A.match_lines(src), lambda rows: A.economy_columns(rows, src)),
    }


def staging_frames(src: TableSource) -> dict[str, DataFrame]:
    """``staged_tables`` with all of their columns."""
    return {name: _staged(staged).frame() for name, staged in staged_tables(src).items()}


# fixed values: the four source files and their encodings
CSV_SOURCES = {
    "economy": ("economy.csv", "ISO-8859-1"),
    "picks": ("picks.csv", "UTF-8"),
    "players": ("players.csv", "ISO-8859-1"),
    "results": ("results.csv", "UTF-8"),
}


def staging_from_csv(spark: SparkSession, folder: str, quarantine: str | None = None,
                     max_bad_share: float = 0.01) -> dict[str, DataFrame]:
    """The four source CSV files (header line, columns by position) in final-table shape.

    A line that does not fit ends the load, unless ``quarantine`` names a folder: then such
    lines are written there, one table (file, line, reason) per source, and the load goes on
    as long as no source has more than ``max_bad_share`` of them.
    """
    from .. import schemas
    from ..sources.files import read_csv_quarantined, read_csv_table
    read = {}
    for name, (fname, enc) in CSV_SOURCES.items():
        schema = getattr(schemas, f"{name.upper()}_STAGE")
        if quarantine is None:
            read[name] = read_csv_table(spark, f"{folder}/{fname}", schema, enc)
        else:
            read[name], bad = read_csv_quarantined(spark, f"{folder}/{fname}", schema, enc, max_bad_share)
            bad.write.mode("overwrite").parquet(f"{quarantine}/{name}")
    results = read["results"]
    return {
        "events": results.select("event_id").distinct()
                         .withColumn("event_name", F.lit(None).cast("string")),
        "matches": read["economy"].select(
            "match_id", "event_id", F.col("date").alias("match_date"), "team_1", "team_2",
            clean_best_of("best_of").alias("best_of")),
        "results": results,
        "picks": read["picks"],
        "players_raw": read["players"].withColumnRenamed("date", "match_date"),
        "economy": read["economy"],
    }


def load_final_tables(spark: SparkSession, sf_dir: str | None, folder: str, version: int = 0,
                      tables: list[str] | None = None,
                      staged: dict[str, DataFrame | Staged] | None = None,
                      declared_keys: dict[str, list[str]] | None = None) -> None:
    """Run the ETL steps in the reference's order into ``folder``.

    The staging frames come from the test tables of ``sf_dir`` unless given
    (e.g. ``staging_from_csv``). ``declared_keys`` gives a key to a table that has
    none by default (results, players_raw, economy), so that input loaded again
    adds nothing.
    """
    staged = staged or staged_tables(CountedSource(spark, sf_dir))
    for name, keys in FINAL_TABLES:
        if tables is None or name in tables:
            keys = (declared_keys or {}).get(name, keys)
            if name == "results" and read_final(spark, folder, "matches") is not None:
                load_results(spark, staged[name], folder, keys, version)
            else:
                load_increment(staged[name], folder, name, keys, version)


# what results_wide takes from matches
MATCH_COLUMNS = ["team_1", "team_2", "match_date"]


def load_results(spark: SparkSession, new: DataFrame | Staged, folder: str, keys: list[str] | None,
                 version: int) -> None:
    """results, results_wide and results_waiting of ``version``: the new rows meet their match
    before they are dealt by event, so they are dealt once for all three tables. What
    is dealt is written once below the shared checkpoint folder and read by each.
    """
    fresh = _fresh(new, folder, "results", keys, version)
    dealt = _dealt_with_match(spark, fresh.rows, folder, version)
    _write(fresh.finish(dealt), None, f"{folder}/results/version={version}")
    load_wide_results(spark, folder, version, fresh.finish(dealt, (*MATCH_COLUMNS, "_found")))


def _dealt_with_match(spark: SparkSession, rows: DataFrame, folder: str, version: int) -> DataFrame:
    """``rows`` with their match's columns and ``_found``, dealt by event and written."""
    known = read_final(spark, folder, "matches").filter(F.col("version") <= version)
    known = _grown(known.select("match_id", *MATCH_COLUMNS, F.lit(True).alias("_found")))
    joined = rows.join(known, "match_id", "left")
    return materialize(_by_event(joined), "results-dealt")


def load_wide_results(spark: SparkSession, folder: str, version: int, fresh: DataFrame | None = None) -> None:
    """results_wide for ``version``: the pairs of result and match rows of which at
    least one arrived in this version, so a match that comes after its results
    completes them and no pair is written twice. Questions over it need no
    join and no shuffle by match id; it is partitioned by event like the
    other tables.

    Results whose match is still missing are kept aside (results_waiting, whole in
    each version): a load reads its own results, those waiting and the keys of matches,
    not the results loaded before. Match ids are unique in matches, so a result that
    has its match gets no other one. ``fresh``: the version's results with their match, as
    dealt by event, if the caller has them.
    """
    results, matches = read_final(spark, folder, "results"), read_final(spark, folder, "matches")
    if results is None or matches is None:
        return
    if fresh is None:
        fresh = _dealt_with_match(spark, results.filter(F.col("version") == version).drop("version"), folder, version)
    if "event_id" in results.columns:  # of the type that the partitions of results are read as
        fresh = fresh.withColumn("event_id", F.col("event_id").cast(results.schema["event_id"].dataType))
    wide = fresh.filter("_found").drop("_found")
    still = fresh.filter("_found IS NULL").drop("_found", *MATCH_COLUMNS)
    before = read_final(spark, folder, WAITING)
    if before is None:  # results loaded before any match was there, or by an earlier form of this load
        waiting = results.filter(F.col("version") < version).drop("version")
        earlier = _grown(matches.filter(F.col("version") < version).select("match_id"))
        waiting = waiting.join(earlier, "match_id", "left_anti")
    else:
        newest = before.filter(F.col("version") < version).select(F.max("version")).scalar()
        waiting = before.filter(F.col("version") == newest).drop("version")
    if not waiting.isEmpty():
        arrived = _grown(matches.filter(F.col("version") == version).select("match_id", *MATCH_COLUMNS))
        wide = wide.unionByName(_by_event(waiting.join(arrived, "match_id")))
        still = still.unionByName(waiting.join(arrived, "match_id", "left_anti"))
    _write(wide, SORT_BY[WIDE], f"{folder}/{WIDE}/version={version}")
    still.write.mode("overwrite").parquet(f"{folder}/{WAITING}/version={version}")


class FinalTables:
    """Reference-shaped tables read back from a loaded folder (same interface as catalog.Tables)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _t(self, name: str) -> DataFrame:
        df = read_final(self.spark, self.folder, name)
        if df is None:
            raise FileNotFoundError(f"{self.folder}/{name}")
        return df.drop("version")

    m = property(lambda self: self._t("matches"))
    r = property(lambda self: self._t("results"))
    rc = r
    rw = property(lambda self: self._t(WIDE))
    p = property(lambda self: self._t("players_raw"))
    ev = property(lambda self: self._t("events"))
    ps = property(lambda self: self.p.withColumnRenamed("match_date", "date"))
    e = property(lambda self: self._t("economy"))
    picks = property(lambda self: self._t("picks"))
