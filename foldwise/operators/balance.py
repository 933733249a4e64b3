"""Balance repair: swaps between folds until no swap improves the label balance.

``assign_folds`` spreads every label like a systematic sample; what is left is
chance. The repair looks at counts only: rows per (seed, fold, label vector)
and their sums per (fold, target, value). A swap moves rows of one label
vector from fold f to g and as many rows of another vector back, so fold sizes
stay as they are. The best swap of two folds follows from the difference of
their label counts, and how many rows to swap at once from a parabola; swaps
go on until none lowers the sum of squared deviations. The plan's size depends
on the label vectors, not on the rows.

Rows move by rank: of the rows of a vector in a fold, the first ones in the
seeded hash order go. Ranks come from offsets of hash sub-buckets, only for
vectors that give rows away, so a vector may hold any share of all rows.
Counts and order do not depend on the partitioning, so neither does the result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.config import N_FOLDS, TARGETS
from foldwise.operators.folds import assign_folds, label_key, seeded_row_hash
from foldwise.operators.ranking import exclusive_offsets
from foldwise.session import materialize

#: label vectors whose counts may come to the driver; with more, bin the targets
MAX_VECTORS = 500_000
#: candidates of each side whose swaps are compared exactly
CANDIDATES = 48
#: swaps of a plan, at most (each may move many rows)
MAX_SWAPS = 20_000


def plan_counts(codes: np.ndarray, counts: np.ndarray, max_swaps: int = MAX_SWAPS) -> np.ndarray:
    """Rows per (vector, fold) after the swaps.

    ``codes[v, t]`` is the place of vector v's value of target t among all
    (target, value) labels, ``counts[v, f]`` its rows in fold f.
    """
    counts = counts.astype(np.int64).copy()
    n_folds, n_labels = counts.shape[1], int(codes.max()) + 1 if codes.size else 0
    if not n_labels or n_folds < 2:
        return counts
    off = np.zeros((n_folds, n_labels))
    for t in range(codes.shape[1]):
        np.add.at(off.T, codes[:, t], counts)
    off -= off.mean(axis=0)
    pairs, idle, turn = [(f, g) for f in range(n_folds) for g in range(f + 1, n_folds)], 0, 0
    for _ in range(max_swaps):
        f, g = pairs[turn % len(pairs)]
        turn += 1
        found = _best_swap(codes, counts, off, f, g)
        if found is None:
            idle += 1
            if idle == len(pairs):
                break
            continue
        idle = 0
        u, v, q = found
        for vector, sign in ((u, -q), (v, q)):
            counts[vector, f] += sign
            counts[vector, g] -= sign
            off[f, codes[vector]] += sign
            off[g, codes[vector]] -= sign
    return counts


def _best_swap(codes, counts, off, f, g):
    """(vector of f, vector of g, rows) of the swap that lowers the squared
    deviations most; None if none does."""
    s = off[f] - off[g]
    score = s[codes].sum(axis=1)
    mine, yours = np.flatnonzero(counts[:, f]), np.flatnonzero(counts[:, g])
    if not len(mine) or not len(yours):
        return None
    mine = mine[np.argsort(-score[mine], kind="stable")[:CANDIDATES]]
    yours = yours[np.argsort(score[yours], kind="stable")[:CANDIDATES]]
    differ = 2.0 * (codes[mine][:, None, :] != codes[yours][None, :, :]).sum(axis=2)
    pull = score[mine][:, None] - score[yours][None, :]
    rows = np.minimum(counts[mine, f][:, None], counts[yours, g][None, :])
    best_rows = np.clip(np.rint(pull / np.maximum(2 * differ, 1)), 1, rows)
    gain = np.where(differ > 0, best_rows * pull - best_rows ** 2 * differ, 0.0)
    at = int(np.argmax(gain))
    if gain.flat[at] <= 1e-9:
        return None
    i, j = divmod(at, len(yours))
    return mine[i], yours[j], int(best_rows[i, j])


def moves_of(before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(vector, fold, first rank, rank after the last, new fold) of the rows
    that move: what a fold has too many goes to the folds that have too few."""
    out = []
    for v in np.flatnonzero((before != after).any(axis=1)):
        need = [(g, int(after[v, g] - before[v, g])) for g in range(before.shape[1]) if after[v, g] > before[v, g]]
        for f in range(before.shape[1]):
            at, extra = 0, int(before[v, f] - after[v, f])
            while extra > 0:
                g, n = need.pop()
                q = min(n, extra)
                out.append((int(v), f, at, at + q, g))
                at, extra = at + q, extra - q
                if n > q:
                    need.append((g, n - q))
    return out


def repair_balance(folded: DataFrame, targets: Sequence[str] = TARGETS, n_folds: int = N_FOLDS, id_col: str = "text_id",
                   seed_col: str = "seed", fold_col: str = "fold", bucket_hex_digits: int = 3,
                   max_swaps: int = MAX_SWAPS) -> DataFrame:
    """The folded rows with some of them in other folds; fold sizes stay.

    Read more than once: pass a written table of narrow rows and join texts
    afterwards. Rows that are equal in all columns may stand for each other.
    """
    spark, targets = folded.sparkSession, list(targets)
    keys = [f"_k{i}" for i in range(len(targets))]
    x = folded.withColumns({k: label_key(t) for k, t in zip(keys, targets)})
    per = x.groupBy(seed_col, *keys, fold_col).agg(F.count(F.lit(1)).alias("n"))
    vectors = per.select(*keys).distinct().limit(MAX_VECTORS + 1).count()
    if vectors > MAX_VECTORS:
        raise ValueError(f"more than {MAX_VECTORS} label vectors: bin the targets first")
    table = per.toPandas()
    rows = []
    for seed, g in table.groupby(seed_col):
        g = g.sort_values(keys)
        named = g[keys].drop_duplicates().reset_index(drop=True)
        at = named.merge(g, on=keys, how="left").set_index(keys)
        place = {tuple(r): i for i, r in enumerate(named.itertuples(index=False, name=None))}
        before = np.zeros((len(named), n_folds), dtype=np.int64)
        before[[place[k if isinstance(k, tuple) else (k,)] for k in at.index], at[fold_col].to_numpy()] = at["n"].to_numpy()
        codes, base = np.zeros((len(named), len(keys)), dtype=np.int64), 0
        for t, k in enumerate(keys):
            values, codes[:, t] = np.unique(named[k].to_numpy(), return_inverse=True)
            codes[:, t] += base
            base += len(values)
        after = plan_counts(codes, before, max_swaps)
        rows += [(int(seed), *map(float, named.iloc[v]), f, lo, hi, to) for v, f, lo, hi, to in moves_of(before, after)]
    if not rows:
        return folded
    schema = ", ".join([f"{seed_col} INT", *[f"{k} DOUBLE" for k in keys], f"{fold_col} INT", "lo LONG", "hi LONG", "to INT"])
    group = [seed_col, *keys, fold_col]
    moves = spark.createDataFrame(rows, schema).groupBy(*group).agg(F.collect_list(F.struct("lo", "hi", "to")).alias("_moves"))
    x = x.join(moves, group, "left")
    still = x.where(F.col("_moves").isNull())
    giving = x.where(F.col("_moves").isNotNull()).withColumn("_h", seeded_row_hash(folded, seed_col, id_col))
    giving = giving.withColumn("_b", F.substring("_h", 1, bucket_hex_digits))
    offsets = exclusive_offsets(giving.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("n")), group, [["_b"]],
                                out_col="_off").drop("n")
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", id_col)) - 1
    giving = giving.withColumn("_rn", rank).join(offsets, [*group, "_b"])
    r = F.col("_off") + F.col("_rn")
    to = F.filter("_moves", lambda m: (m["lo"] <= r) & (r < m["hi"]))
    giving = giving.withColumn(fold_col, F.coalesce(F.try_element_at(to, F.lit(1))["to"], F.col(fold_col)))
    return still.select(*folded.columns).unionByName(giving.select(*folded.columns))


def assign_balanced_folds(df: DataFrame, seeds: Sequence[int] = (42,), n_folds: int = N_FOLDS,
                          targets: Sequence[str] = TARGETS, id_col: str = "text_id", **options) -> DataFrame:
    """``assign_folds`` of narrow rows with its balance repaired."""
    folded = materialize(assign_folds(df, seeds, n_folds, targets, id_col, **options), "folds")
    return repair_balance(folded, targets, n_folds, id_col)
