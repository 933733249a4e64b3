"""Hold-out splits, subsets, heads, seeded shuffles and batches.

Spark has no row order, so every head, shuffle and batch names its order
key; seeded orders are ``md5(seed:purpose:id)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import seeded_key
from foldwise.operators.ranking import positions


def holdout(folded: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, valid) for fold ``fold``: train keeps every row not in it (nulls too)."""
    k = F.lit(int(fold))
    train = folded.where(~F.col(fold_col).eqNullSafe(k))
    valid = folded.where(F.col(fold_col) == k)
    return train, valid


def fold_subset(df: DataFrame, folds: Sequence[int], fold_col: str = "fold") -> DataFrame:
    return df.where(F.col(fold_col).isin([int(f) for f in folds]))


def head(df: DataFrame, n: int | None, order_cols: Sequence) -> DataFrame:
    """First ``n`` rows in an explicit order (``None`` keeps all rows).

    Planned as a top-k: each task keeps its own first n, so at most
    n x tasks rows reach the final merge.
    """
    if n is None:
        return df
    return df.orderBy(*order_cols).limit(int(n))


def head_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, n: int | None,
                   rank_col: str = "_rank") -> DataFrame:
    """First ``n`` rows of each group; the optimizer adds a per-task group limit."""
    if n is None:
        return df
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= int(n)).drop(rank_col)


def seeded_order(df: DataFrame, seed, purpose, id_col: str = "text_id",
                 group_cols: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """0-based rank in the seeded shuffle ``md5(seed:purpose:id)`` inside groups.

    ``seed`` and ``purpose`` are literals or Columns (e.g. an epoch column).
    """
    x = df.withColumn("_skey", seeded_key(seed, purpose, F.col(id_col)))
    return positions(x, list(group_cols), ["_skey", id_col], name=name).drop("_skey")


#: leading hex digits of the hash that one round of the selection looks at
RADIX_DIGITS = 4
#: rows of the border group that may be ranked among themselves
BORDER_ROWS = 10_000


def split_hash(seed: int, id_col: str = "text_id") -> Column:
    """``md5(seed:split:id)``; a null id counts as the empty text."""
    return seeded_key(F.lit(int(seed)), F.lit("split"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def hash_threshold(df: DataFrame, seed: int, fraction: float = 0.2, id_col: str = "text_id",
                   digits: int = RADIX_DIGITS, border_rows: int = BORDER_ROWS) -> str | None:
    """The hash of the last of the ceil(fraction * N) rows first in the
    ``split_hash`` order, by radix selection; None if there is no such row.

    Rows are counted by the leading digits of their hash; the groups before the
    one that holds the last wanted row are in, and only that border group is
    counted again by further digits, until it holds few rows, which are then
    counted one by one. Each round is a narrow aggregate (at most
    ``16**digits`` rows reach the driver); rows are neither sorted nor
    shuffled. The input is read once per round: pass a scan or a written table.
    """
    hashes = df.select(split_hash(seed, id_col).alias("_skey"))

    def border(counts: list, wanted: int, before: int) -> tuple[str, int, int]:
        for value, n in sorted(counts):
            if before + n >= wanted:
                return value, n, before
            before += n
        raise AssertionError("fewer rows than counted before")

    prefix, before, wanted = "", 0, None
    while len(prefix) < 32:
        inside = hashes.where(F.col("_skey").startswith(prefix)) if prefix else hashes
        counts = [tuple(r) for r in inside.groupBy(F.substring("_skey", 1, len(prefix) + digits)).count().collect()]
        if wanted is None:
            wanted = int(np.ceil(sum(n for _, n in counts) * float(fraction) - 1e-9))
            if wanted <= 0:
                return None
        prefix, n, before = border(counts, wanted, before)
        if n <= border_rows:
            few = hashes.where(F.col("_skey").startswith(prefix)).groupBy("_skey").count().collect()
            return border([tuple(r) for r in few], wanted, before)[0]
    return prefix


def hash_split(df: DataFrame, seed: int, test_fraction: float = 0.2, id_col: str = "text_id",
               split_col: str = "split", digits: int = RADIX_DIGITS, border_rows: int = BORDER_ROWS) -> DataFrame:
    """Seeded train/valid split; valid = the ceil(fraction * N) rows first in
    the ``md5(seed:split:id)`` order. The split is a comparison of each row's
    hash with ``hash_threshold``. Rows with equal ids have equal hashes; if
    they lie on the border, all of them are valid."""
    last = hash_threshold(df, seed, test_fraction, id_col, digits, border_rows)
    valid = F.lit(False) if last is None else split_hash(seed, id_col) <= F.lit(last)
    return df.withColumn(split_col, F.when(valid, F.lit("valid")).otherwise(F.lit("train")))


def random_split(df: DataFrame, seed: int, test_fraction: float = 0.2, id_col: str = "text_id",
                 group_cols: Sequence[str] = (), split_col: str = "split") -> DataFrame:
    """Seeded train/valid split; valid = the ceil(fraction * N) rows first in
    the ``md5(seed:split:id)`` order, N per group (``hash_split`` for one group)."""
    if not group_cols:
        return hash_split(df, seed, test_fraction, id_col, split_col)
    x = df.withColumn("_skey", seeded_key(F.lit(int(seed)), F.lit("split"), F.col(id_col)))
    ranked = positions(x, list(group_cols), ["_skey", id_col], name="_pos")
    sizes = ranked.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    n_valid = F.ceil(F.col("_n") * F.lit(float(test_fraction)) - F.lit(1e-9))
    valid = F.when(F.col("_pos") < n_valid, F.lit("valid")).otherwise(F.lit("train"))
    return ranked.join(sizes, list(group_cols)).withColumn(split_col, valid).drop("_skey", "_pos", "_n")


def batches(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, batch_size: int,
            batch_col: str = "batch_id", pos_col: str = "pos") -> DataFrame:
    """Consecutive groups of ``batch_size`` rows in the given order, per group."""
    ranked = positions(df, list(group_cols), list(order_cols), name=pos_col)
    return ranked.withColumn(batch_col, F.floor(F.col(pos_col) / F.lit(int(batch_size))).cast("bigint"))
