"""Keyed joins that replace positional alignment, and their checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: parts over which rows with a null key are spread
NULL_SALTS = 64


def anti_join_null_safe(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; a null key matches a null.

    Plain ``left_anti`` keeps a null key even when the right side has one, and
    ``NOT IN`` empties the result; null-safe equality gives membership
    semantics. One equality join reads the left side once: a null key becomes
    a salt between 0 and ``NULL_SALTS``, so null rows do not meet in one task,
    and a null on the right stands for every salt.
    """
    rk = right_key or key
    r = right.select(F.col(rk).alias("_rk"))
    salts = F.when(F.col("_rk").isNull(), F.sequence(F.lit(0), F.lit(NULL_SALTS - 1))).otherwise(F.array(F.lit(-1)))
    r = r.distinct().select("_rk", F.explode(salts).alias("_rs"))
    l_salt = F.when(F.col(key).isNull(), F.floor(F.rand(1) * NULL_SALTS).cast("int")).otherwise(F.lit(-1))
    x = left.withColumn("_ls", l_salt)
    same = x["_ls"].eqNullSafe(r["_rs"]) & x[key].eqNullSafe(r["_rk"])
    return x.join(r, same, "left_anti").drop("_ls")


#: bits of an id filter: about ten per id, but never more than this (8 MB)
BITS_PER_ID = 10
MAX_FILTER_BITS = 1 << 26
PROBES = 4


class IdFilter:
    """A Bloom filter of the non-null ids of a table: rules ids out for sure,
    lets about one in a hundred others pass (more if the ids are so many that
    the filter's bound leaves fewer bits for each).

    Built by Spark: the bits of all ids are gathered per 64-bit word with
    partial aggregation, and only the words reach the driver (their number is
    bounded). It travels as one binary constant of the plan and is tested with
    column functions.
    """

    def __init__(self, ids: DataFrame, key: str, max_bits: int = MAX_FILTER_BITS):
        known = ids.select(F.col(key).cast("string").alias("_id")).where(F.col("_id").isNotNull())
        n = known.count()
        self.bits = 64 * max(1, min(max_bits, n * BITS_PER_ID) // 64)
        at = known.select(F.explode(F.array(*self._places(F.col("_id")))).alias("at"))
        one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
        words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
        held = np.zeros(self.bits // 64, dtype="<i8")
        held[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self.ids, self.body = n, held.tobytes()

    def _places(self, value: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(value, F.lit(i)), F.lit(self.bits)) for i in range(PROBES)]

    def may_hold(self, value: Column) -> Column:
        """False only if the value is surely none of the ids; null for null."""
        body, hit = F.lit(self.body), F.lit(True)
        for place in self._places(value.cast("string")):
            byte = F.conv(F.hex(F.substring(body, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            hit = hit & (F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return F.when(value.isNotNull(), hit)


def anti_join_prefiltered(left: DataFrame, right: DataFrame, key: str, max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``anti_join_null_safe`` for a wide ``left``: rows that an ``IdFilter`` of
    the right ids rules out stay without a shuffle; only rows that may be
    members, and those without a key, meet the exact join. Both branches scan
    ``left`` with their own condition."""
    held = IdFilter(right, key, max_bits)
    possible = F.coalesce(held.may_hold(F.col(key)), F.lit(True))
    exact = anti_join_null_safe(left.where(possible), right, key)
    return left.where(~possible).unionByName(exact)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """Raise if a key occurs twice (positional alignment assumed it never does)."""
    bad = duplicate_keys(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"{what}: duplicate key {bad[0].asDict()}")


def seed_fold_grid(spark, seeds: Sequence[int], folds: Sequence[int]) -> DataFrame:
    """(seed, fold) pairs as a tiny table (size fixed by the run config)."""
    rows = [(int(s), int(k)) for s in seeds for k in folds]
    return spark.createDataFrame(rows, "seed INT, fold INT")
