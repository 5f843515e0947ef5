"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins at runtime (broadcast only
# when the measured side is below spark.sql.autoBroadcastJoinThreshold),
# coalesces small shuffle partitions and splits skewed ones.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def sizing_for(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Partition settings for an input of ``input_bytes`` on ``total_cores`` cores.

    Scans split files into ~``target_partition_bytes`` tasks; shuffles start
    with enough partitions that each holds about that much (at least two per
    core) and AQE coalesces the ones that turn out small, so a partition fits
    an executor's memory at any scale without tuning per query. For 100 TB on
    8,000 cores: 256 MiB scan splits, 400k initial shuffle partitions, 128 MiB
    advisory size after coalescing.
    """
    shuffle = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(max(64 << 20, target_partition_bytes // 2)),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "roundhouse", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    ``master`` is only set for local runs; on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # Spark Connect
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared file system folder and is used
    as is. Only when it is unset and the master is local (tests) a scratch
    folder is made; any other master without it is an error. The
    RDD checkpoint folder is set too where the session has a SparkContext
    (not under Spark Connect, where only the written tables are used).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if master and not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        configured = tempfile.mkdtemp(prefix="roundhouse-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # a session that refuses the setting: use the folder as is
            pass
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context on the client
        return configured
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, *parts)


def materialize(df, name: str = "table"):
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but computes the plan only once
    (an RDD checkpoint of an uncached plan computes it twice). Later jobs read
    the written files, and a lost executor re-reads them instead of
    recomputing the plan.
    """
    import uuid
    path = scratch_path(df.sparkSession, "tables", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
