"""Global positions without a single-partition window.

Two tools:

* ``exclusive_offsets`` turns a table of counts keyed by an ordered,
  hierarchical key into exclusive running totals. Each level is a window
  partitioned by the key prefix above it, so a window never holds more rows
  than the distinct values of one level (a key domain, not the data size).
* ``positions`` numbers rows in a total order inside groups that may be
  arbitrarily large: range-partition on the order, number rows inside each
  range partition, and add per-partition offsets from a table with one row
  per (range partition, group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import materialize

_MID_BITS = 33  # monotonically_increasing_id: partition index << 33 | row index


def exclusive_offsets(counts: DataFrame, group_cols: Sequence[str], levels: Sequence[Sequence[str]],
                      count_col: str = "n", out_col: str = "offset") -> DataFrame:
    """Exclusive running total of ``count_col`` in lexicographic key order.

    ``counts`` has exactly one row per ``group_cols + all level columns``.
    Key columns must be non-null (encode nulls before calling).
    Returns ``counts`` plus ``out_col``.
    """
    group_cols = list(group_cols)
    prefix: list[str] = []
    parts = []
    n_levels = len(levels)
    out = None
    for i, level in enumerate(levels):
        level = list(level)
        keys = prefix + level
        w = (Window.partitionBy(*group_cols, *prefix) if (group_cols or prefix) else Window)
        w = w.orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
        if i == n_levels - 1:
            # the finest level is the count table itself: keep all its columns
            out = counts.withColumn(f"_off{i}", F.coalesce(F.sum(count_col).over(w), F.lit(0)).cast("bigint"))
        else:
            t = counts.groupBy(*group_cols, *keys).agg(F.sum(count_col).alias("_lvl_n"))
            t = t.select(*group_cols, *keys, F.coalesce(F.sum("_lvl_n").over(w), F.lit(0)).cast("bigint").alias(f"_off{i}"))
            parts.append((keys, t))
        prefix = keys
    if parts:
        # combine the coarser (small) level tables first, then join them once
        # on the keys the finest level's window already partitions by, so the
        # large finest table is not shuffled again for these joins
        last_keys, combined = parts[-1]
        for keys, t in reversed(parts[:-1]):
            combined = combined.join(t, [*group_cols, *keys])
        out = out.join(combined, [*group_cols, *last_keys])
    total = sum((F.col(f"_off{i}") for i in range(n_levels)), F.lit(0).cast("bigint"))
    return out.withColumn(out_col, total).drop(*[f"_off{i}" for i in range(n_levels)])


def positions(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence, name: str = "pos",
              n_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside ``partition_cols`` by ``order_cols``.

    Give a total order (end ``order_cols`` with a unique id) for a
    reproducible result. Partition columns must be non-null. The numbered
    rows are written once to the shared folder so the per-partition counts
    and the rows agree even if a task is re-run.
    """
    spark = df.sparkSession
    partition_cols = list(partition_cols)
    keys = [*partition_cols, *order_cols]
    # without an explicit count the range exchange follows the shuffle
    # partition setting and AQE may coalesce it; ids are read after that
    ranged = df.repartitionByRange(n_partitions, *keys) if n_partitions else df.repartitionByRange(*keys)
    staged = (ranged
                .sortWithinPartitions(*keys)
                .withColumn("_mid", F.monotonically_increasing_id()))
    staged = materialize(staged, "positions")  # ids are stored, so counts and rows agree
    pid = F.shiftright(F.col("_mid"), _MID_BITS)
    stats = staged.groupBy(pid.alias("_pid"), *partition_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = (Window.partitionBy(*partition_cols) if partition_cols else Window)
    w = w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.select("_pid", *partition_cols, "_first",
                         F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = staged.withColumn("_pid", pid).join(stats, ["_pid", *partition_cols])
    return (out.withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("bigint"))
               .drop("_pid", "_mid", "_first", "_off"))
