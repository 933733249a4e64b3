"""Balance repair against iterative stratification, written here from its publication."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.config import TARGETS
from foldwise.operators.balance import assign_balanced_folds, moves_of, plan_counts, repair_balance
from foldwise.operators.folds import assign_folds, fold_balance


def scores(n, seed):
    """Correlated scores on the grid 1.0 to 5.0."""
    rng = np.random.default_rng(seed)
    common = rng.normal(size=(n, 1))
    raw = 3.1 + 0.55 * common + 0.4 * rng.normal(size=(n, len(TARGETS)))
    return np.clip(np.round(raw * 2) / 2, 1.0, 5.0)


def frame(spark, Y, parts=3):
    rows = [(f"t{i}", *map(float, y)) for i, y in enumerate(Y)]
    return spark.createDataFrame(rows, "text_id string, " + ", ".join(f"{t} double" for t in TARGETS)).repartition(parts)


def iterative_stratification(Y, k, rng):
    """Rarest remaining label first; each of its rows goes to the fold that
    wants the label most, then to the one that wants rows most."""
    L = np.hstack([(Y[:, t:t + 1] == np.unique(Y[:, t])) for t in range(Y.shape[1])])
    want_rows, want = np.full(k, len(Y) / k), np.tile(L.sum(axis=0) / k, (k, 1))
    folds, left = np.full(len(Y), -1), np.ones(len(Y), dtype=bool)
    while left.any():
        n = np.where((m := L[left].sum(axis=0)) > 0, m, np.inf)
        label = int(np.argmin(n))
        for i in np.flatnonzero(left & L[:, label]):
            best = np.flatnonzero(want[:, label] == want[:, label].max())
            best = best[want_rows[best] == want_rows[best].max()]
            f = rng.choice(best)
            folds[i], left[i] = f, False
            want[f] -= L[i]
            want_rows[f] -= 1
    return folds


def deviation(Y, folds, k):
    out = []
    for t in range(Y.shape[1]):
        for v in np.unique(Y[:, t]):
            held = np.bincount(folds[Y[:, t] == v], minlength=k)
            out += list(np.abs(held - held.sum() / k))
    return np.mean(out), np.max(out)


def collected(df, n):
    out = {}
    for r in df.collect():
        out.setdefault(r["seed"], np.full(n, -1))[int(r["text_id"][1:])] = r["fold"]
    return out


def test_balance_is_that_of_iterative_stratification(spark):
    Y = scores(4000, 1)
    got = collected(assign_balanced_folds(frame(spark, Y), (42, 43)), len(Y))
    plain = collected(assign_folds(frame(spark, Y), (42, 43)), len(Y))
    other = np.mean([deviation(Y, iterative_stratification(Y, 5, np.random.default_rng(s)), 5) for s in range(2)], axis=0)
    mine = np.mean([deviation(Y, got[s], 5) for s in (42, 43)], axis=0)
    assert mine[0] <= 1.3 * other[0] and mine[1] <= 1.3 * other[1]
    assert mine[0] < np.mean([deviation(Y, plain[s], 5)[0] for s in (42, 43)])
    for s in (42, 43):
        sizes = np.bincount(got[s], minlength=5)
        assert sizes.sum() == 4000 and sizes.max() - sizes.min() <= 1
    pairs = np.random.default_rng(0).integers(0, 4000, size=(40_000, 2))
    same = got[42][pairs[:, 0]] == got[42][pairs[:, 1]]
    assert 0.17 < (got[43][pairs[:, 0]] == got[43][pairs[:, 1]])[same].mean() < 0.23


def test_result_does_not_depend_on_partitions(spark):
    Y = scores(600, 2)
    a = collected(assign_balanced_folds(frame(spark, Y, 1)), 600)
    b = collected(assign_balanced_folds(frame(spark, Y, 6), bucket_hex_digits=1), 600)
    assert (a[42] == b[42]).all()


def test_a_hot_vector_gives_rows_by_rank(spark):
    """Half of all rows share a label vector; null labels and ids stay."""
    Y = scores(500, 3)
    Y[:250] = Y[0]
    df = frame(spark, Y).withColumn("text_id", F.when(F.col("text_id").isin("t1", "t2"), None).otherwise(F.col("text_id")))
    df = df.withColumn(TARGETS[1], F.when(F.col("text_id") == "t300", None).otherwise(F.col(TARGETS[1])))
    low = {f"t{i}" for i in np.argsort(Y[:, 0], kind="stable")[:250]} - {"t1", "t2"}
    skew = df.withColumns({"seed": F.lit(42), "fold": F.when(F.col("text_id").isin(low), F.lit(0)).otherwise(F.lit(1))})
    sizes = {r["fold"]: r["count"] for r in skew.groupBy("fold").count().collect()}
    out = repair_balance(skew, n_folds=2)
    assert out.count() == 500 and out.columns == skew.columns
    assert {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()} == sizes
    assert out.where("text_id is null").count() == 2

    def cost(x):
        held = {(r["target"], r["value"], r["fold"]): r["n_rows"] for r in fold_balance(x).collect()}
        return sum((held.get((t, v, 0), 0) - held.get((t, v, 1), 0)) ** 2 for t, v in {k[:2] for k in held})

    assert cost(out) < cost(skew) / 20


@pytest.mark.parametrize("seed", range(5))
def test_plan_keeps_rows_and_sizes_and_no_single_swap_improves_it(seed):
    rng = np.random.default_rng(seed)
    V, T, k = 12, 2, 3
    codes = np.unique(np.stack([rng.integers(0, 4, V), 4 + rng.integers(0, 3, V)], axis=1), axis=0)
    counts = rng.integers(0, 9, (len(codes), k))
    after = plan_counts(codes, counts)
    assert (after >= 0).all() and (after.sum(axis=0) == counts.sum(axis=0)).all() and (after.sum(axis=1) == counts.sum(axis=1)).all()

    def cost(c):
        off = np.stack([(c * (codes[:, t] == v)[:, None]).sum(axis=0) for t in range(T) for v in np.unique(codes[:, t])])
        return ((off - off.mean(axis=1, keepdims=True)) ** 2).sum()

    assert cost(after) <= cost(counts)
    for u in range(len(codes)):
        for v in range(len(codes)):
            for f in range(k):
                for g in range(k):
                    if f != g and after[u, f] and after[v, g]:
                        c = after.copy()
                        c[u, f] -= 1; c[u, g] += 1; c[v, g] -= 1; c[v, f] += 1
                        assert cost(c) >= cost(after) - 1e-9
    moved = counts.copy()
    for v, f, lo, hi, to in moves_of(counts, after):
        moved[v, f] -= hi - lo
        moved[v, to] += hi - lo
    assert (moved == after).all()
