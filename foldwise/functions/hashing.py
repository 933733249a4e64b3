"""Seeded, partition-independent random keys.

There is no RNG state anywhere: every random choice is a function of
``md5(seed ':' purpose ':' id)``, so a result never depends on partitioning,
row order or the number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def seeded_key(seed, *parts) -> Column:
    """Hex md5 of ``seed:part1:part2...``; ordering by it is a seeded shuffle."""
    pieces = [_as_col(seed).cast("string")]
    for p in parts:
        pieces += [F.lit(":"), _as_col(p).cast("string")]
    return F.md5(F.concat(*pieces))


def hex_prefix_int(hex_col: Column, n_chars: int = 8) -> Column:
    """Leading ``n_chars`` hex digits of an md5 as a BIGINT (monotone in it)."""
    return F.conv(F.substring(hex_col, 1, n_chars), 16, 10).cast("bigint")
