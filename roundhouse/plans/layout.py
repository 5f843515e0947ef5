"""Final tables laid out by match: joins on match_id without a shuffle.

``cluster_by_match`` writes a snapshot of the loaded results, matches and players as
bucketed tables with the same number of buckets; ``MatchTables`` attaches the newest
snapshot to a session. Joins and aggregates on match_id (alone or with more
columns) then read matching buckets side by side: no Exchange on either side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..streaming.tables import Folder
from .load import FinalTables, read_final

TABLES = ("results", "matches", "players_raw")
KEY = "match_id"
PLACE = "by_match"
FILES_PER_TASK = 32  # up to so many buckets, a scan task writes a part of each: its split holds 4 MiB of one


def buckets_for(input_bytes: int, target_bytes: int = 256 << 20) -> int:
    """Buckets that each hold about ``target_bytes`` of the largest table (a power of two, so that
    layouts of other sizes still join without a shuffle of both sides)."""
    return 1 << max(0, -(-input_bytes // target_bytes) - 1).bit_length()


def cluster_by_match(spark: SparkSession, folder: str, buckets: int) -> int:
    """Writes a new snapshot of the loaded tables; returns its number.

    The marker of the snapshot comes last and names the number of buckets; a run that
    breaks off leaves the snapshot before it in use. Older snapshots stay until they
    are removed (readers may hold them).

    Few buckets are written where the rows are read, a file per task and bucket, without
    a shuffle; many (they grow with the tables) would leave small files, so rows are dealt first.
    """
    place = Folder(spark, f"{folder}/{PLACE}")
    number = max((s for s, _ in _snapshots(place)), default=-1) + 1
    for name in TABLES:
        df = read_final(spark, folder, name)
        if df is None:
            raise FileNotFoundError(f"{folder}/{name}")
        view = f"layout_{uuid.uuid4().hex}"
        df = df.drop("version")
        dealt = df if buckets <= FILES_PER_TASK else df.repartition(buckets, KEY)
        (dealt.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, KEY).sortBy(KEY)
         .option("path", f"{folder}/{PLACE}/snapshot={number}/{name}").saveAsTable(view))
        spark.sql(f"DROP TABLE {view}")  # the catalogue entry only: the files stay at their path
    place.mark(f"snapshot={number}.buckets={buckets}")
    return number


def _snapshots(place: Folder) -> list[tuple[int, int]]:
    """(number, buckets) of every committed snapshot, ascending."""
    marks = [m.split(".") for m in place.names("_commits/snapshot=*")]
    return sorted((int(a.split("=")[1]), int(b.split("=")[1])) for a, b in marks)


class MatchTables(FinalTables):
    """Loaded tables with results, matches and players from the newest snapshot by match.

    A join on match_id and more columns keeps the buckets only if Spark may co-locate
    by a part of the join key, so that setting is switched on for the session.
    """

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        found = _snapshots(Folder(spark, f"{folder}/{PLACE}"))
        if not found:
            raise FileNotFoundError(f"{folder}/{PLACE} has no snapshot")
        self.number, self.buckets = found[-1]
        self._names: dict[str, str] = {}
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def _t(self, name: str) -> DataFrame:
        if name not in TABLES:
            return super()._t(name)
        if name not in self._names:
            path = f"{self.folder}/{PLACE}/snapshot={self.number}/{name}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                                for f in self.spark.read.parquet(path).schema.fields)
            view = f"layout_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {view} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
                           f"INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self._names[name] = view
        return self.spark.table(self._names[name])
