"""Connected components of an edge table, by alternating star contractions.

Every round replaces edges by edges to smaller neighbours: "large stars" hang
a node's larger neighbours on the least one, "small stars" its smaller ones.
The edge set shrinks to one star per component in a number of rounds that grows
with the logarithm of the longest path. Each round is written out, so no round
depends on the files of an earlier one being recomputed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, component) of every node that is not the least of its component.

    ``edges`` has long columns ``u`` and ``v``; direction, repetition and
    loops do not matter. Nodes without a row are their own component. ``keep``
    writes a table and reads it back.
    """
    e = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u <> v").distinct(), "components")
    state = _fingerprint(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .distinct(), "components-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least).distinct())
        e = keep(small, "components-small")
        before, state = state, _fingerprint(e)
        if before == state:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
