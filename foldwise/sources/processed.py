"""Partitioned Parquet catalogue of processed tables.

Layout: ``<root>/<table>/data_version=<v>/seed=<s>[/fold=<k>]``. Reads filter
on the partition columns, so a (version, seed[, fold]) read lists and opens
only its own directories (``PartitionFilters`` in the plan). Overwrites are
dynamic: rewriting one seed replaces that seed's partitions only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUNDLE_TABLES = ("train", "test", "sample_submission", "sample_oof")


def write_table(df: DataFrame, root: str, table: str, partition_cols=("data_version", "seed"),
                mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_cols).parquet(f"{root.rstrip('/')}/{table}"))


def read_table(spark: SparkSession, root: str, table: str, data_version: str | None = None,
               seed: int | None = None, fold: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root.rstrip('/')}/{table}")
    if data_version is not None:
        df = df.where(F.col("data_version") == F.lit(data_version))
    if seed is not None:
        df = df.where(F.col("seed") == F.lit(int(seed)))
    if fold is not None:
        df = df.where(F.col("fold") == F.lit(int(fold)))
    return df


def train(spark, root, data_version, seed):
    return read_table(spark, root, "train", data_version, seed)


def _seedless(spark, root, table, data_version, seed):
    """A table that is the same for every seed is stored once per version; a
    read by seed gives those rows with the seed asked for."""
    return read_table(spark, root, table, data_version).withColumn("seed", F.lit(int(seed)))


def test(spark, root, data_version, seed):
    return _seedless(spark, root, "test", data_version, seed)


def sample_submission(spark, root, data_version, seed):
    return _seedless(spark, root, "sample_submission", data_version, seed)


def sample_oof(spark, root, data_version, seed):
    return _seedless(spark, root, "sample_oof", data_version, seed)


def pseudo(spark, root, seed, fold, data_version: str = "pseudo_1"):
    """Pseudo-labelled table of (seed, fold); the version is fixed by the job."""
    return read_table(spark, root, "pseudo", data_version, seed, fold)


METRIC_KEY = ("run", "seed", "fold", "step", "metric")


def append_metrics(log: DataFrame, root: str) -> None:
    """Add metric rows (run, seed, [fold, step,] metric, value) to the run log.
    A row replaces the logged one of the same key (nulls are equal), all other
    rows of its run stay; other runs' partitions are not touched."""
    from foldwise.session import materialize
    spark = log.sparkSession
    for c in ("fold", "step"):
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast("int"))
    fresh = materialize(log.select(*METRIC_KEY, "value"), "metrics")
    merged = fresh
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/metrics")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        old = read_metrics(spark, root).select(*METRIC_KEY, "value").join(fresh.select("run").distinct(), "run", "left_semi")
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in METRIC_KEY]
        kept = old.alias("o").join(fresh.alias("f"), reduce(and_, same), "left_anti")
        merged = materialize(kept.unionByName(fresh), "metrics")  # read before its partitions are replaced
    write_table(merged, root, "metrics", partition_cols=("run",), mode="overwrite")


def append_params(spark: SparkSession, rows, root: str) -> None:
    """Append a run's (run, key, value) hyper-parameter rows beside the metrics."""
    df = spark.createDataFrame(list(rows), "run STRING, key STRING, value STRING")
    write_table(df, root, "params", partition_cols=("run",), mode="overwrite")


def read_metrics(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root.rstrip('/')}/metrics")
    return df if run is None else df.where(F.col("run") == F.lit(run))
