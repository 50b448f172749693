"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins at runtime: it turns a sort-merge
# join into a broadcast only after measuring the shuffled side (the size check for
# every join whose small side is not provably bounded), coalesces tiny partitions and
# splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "livepricing", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("LIVEPRICING_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, cores: int, target_partition_mb: int = 256) -> dict[str, str]:
    """Sizing for a cluster run, from the bytes the job scans and the total executor cores.

    Shuffles start with enough partitions for ~``target_partition_mb`` each (at least two
    waves of the cores) and AQE coalesces small ones to the same advisory size, so a reduce
    task fits comfortably in executor memory without spilling; input splits use the same
    size; partitions over 5x the median and the advisory size are split by AQE's skew join.
    At 100 TB of input and 1000 executors x 8 cores this gives ~400k initial shuffle
    partitions coalesced at run time."""
    target = target_partition_mb * 1024 * 1024
    initial = max(2 * cores, -(-input_bytes // target))
    return {
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target),
        # a broadcast is only ever chosen after AQE has measured the side at run time
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, a join side is broadcast only where ``F.broadcast`` says so or adaptive execution has
    measured it, by the threshold that held before. Spark's estimate before a run is the size of
    the compressed files: 10 MB of sequential keys may be hundreds of MB in the driver's memory."""
    static, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    was = {k: spark.conf.get(k, None) for k in (static, measured)}
    spark.conf.set(measured, was[measured] or spark.conf.get(static))
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written state.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared file system).
    Only when it is unset (local tests) do we pick a fresh scratch folder.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # local tests only: nothing configured, so use a fresh scratch folder
        configured = tempfile.mkdtemp(prefix="livepricing-ckpt-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a (small) intermediate once as Parquet in the shared checkpoint folder and read
    it back: one job, lineage cut, survives executor loss. ``checkpoint(eager=True)`` would
    compute the plan twice (once to count, once to save)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
