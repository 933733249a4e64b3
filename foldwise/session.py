"""Session construction and the shared folder for written tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_OWN_CHECKPOINT_DIR = None


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "foldwise") -> SparkSession:
    """A session tuned for these jobs; on a cluster pass no master.

    An already active session is returned as it is (its settings are the
    caller's). Sizing follows the master the session really runs on: local
    mode uses one shuffle partition per core; a cluster starts shuffles wide
    and lets AQE coalesce them.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # broadcast only what has been measured: no broadcast from plan-time
        # estimates (an explode is not counted in them); AQE converts a join to
        # broadcast after the side's shuffle output is known to be small
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # checkpoint files of DataFrames that are no longer referenced are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("FOLDWISE_DRIVER_MEMORY", "16g")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local"):
        cores = shuffle_partitions or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
        spark.conf.set("spark.sql.shuffle.partitions", str(cores))
    else:
        # cluster sizing: start every shuffle wide and let AQE coalesce to the
        # advisory size, so partitions fit executor memory whatever the scale
        for k, v in {
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum":
                os.environ.get("FOLDWISE_SHUFFLE_PARTITIONS", "8192"),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
            "spark.sql.files.maxPartitionBytes": "256MB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        }.items():
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (required);
    a local session without one gets a fresh temporary folder (tests).
    """
    global _OWN_CHECKPOINT_DIR
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(materialised tables and checkpoints are written there)")
        if _OWN_CHECKPOINT_DIR is None:
            _OWN_CHECKPOINT_DIR = tempfile.mkdtemp(prefix="foldwise-ckpt-")
        conf_dir = _OWN_CHECKPOINT_DIR
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when each write is done; else they
    stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df, name: str = "materialized"):
    """Cut lineage: write ``df`` once as a Parquet table in the shared folder
    and read it back. A table that several branches read is computed once,
    a lost executor does not recompute its lineage, and the copy is
    compressed and columnar (later reads prune columns). The table is deleted
    when the driver's process ends."""
    path = shared_path(df.sparkSession, name)
    _WRITTEN.append((df.sparkSession, path))
    with short_lived_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_WRITTEN: list[tuple[SparkSession, str]] = []


def delete_table(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _delete_written() -> None:
    """Written tables last as long as the driver's session; results that read
    them are lazy. A session that was stopped before leaves them behind."""
    for spark, path in _WRITTEN:
        try:
            if spark._jsc.sc().isStopped():
                continue
            delete_table(spark, path)
        except Exception:  # the JVM is gone already: nothing can be deleted any more
            return

