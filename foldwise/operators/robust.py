"""Fold models for the loss a run names, by iteratively reweighted least squares.

For each (seed, fold) model and target the fit minimises

    sum over train rows of  weight_t * loss(y - z b)  +  lambda / 2 * |b without intercept|^2

A loss enters by its weight ``slope(r) / r``. One iteration is one pass over
the rows: every task adds up the weighted Gram matrices of its rows, with
weights from the residuals of the last coefficients, and the small systems are
solved on the driver (their size is set by features, targets and models, not
by rows). A row counts for every model of its seed but its own fold's. The
coefficients go back to the tasks with the next pass, the rows are read from
one written table, so no lineage grows with the iterations.

Every iteration is a *step*: the coefficients of all steps are kept, and
``score_steps`` scores all steps of all folds on their held-out rows in one
pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.config import RunConfig
from foldwise.operators.ridge import CHUNK, apply_model, design, fixed_lists, matrix, sum_partials


@dataclass(frozen=True)
class RowLoss:
    """A loss of one residual: its value and ``slope(r) / r``."""

    value: Callable[[np.ndarray], np.ndarray]
    weight: Callable[[np.ndarray], np.ndarray]


def _beyond(r: np.ndarray) -> np.ndarray:
    return 1.0 / np.maximum(np.abs(r), 1e-300)


def row_loss(kind: str, beta: float = 1.0, eps: float = 1e-9) -> RowLoss:
    """The losses of ``operators.metrics`` for fitting.

    The quadratic branch of ``weighted_smooth_l1``, ``(0.5 n)^2 / beta``, makes
    the loss jump at beta, so it has no minimiser that its slopes lead to. Its
    values are logged as they are; the fit takes the usual branch,
    ``0.5 n^2 / beta``, which joins the linear one smoothly.
    """
    if kind == "squared":
        return RowLoss(lambda r: 0.5 * r * r, np.ones_like)
    if kind == "rmse_loss":
        return RowLoss(lambda r: np.sqrt(r * r + eps), lambda r: 1.0 / np.sqrt(r * r + eps))
    if kind == "smooth_l1":
        if beta <= 0:
            return RowLoss(np.abs, _beyond)
        return RowLoss(lambda r: np.where(np.abs(r) < beta, 0.5 * r * r / beta, np.abs(r) - 0.5 * beta),
                       lambda r: np.where(np.abs(r) < beta, 1.0 / beta, _beyond(r)))
    if kind == "weighted_smooth_l1":
        if beta < 1e-5:
            return RowLoss(np.abs, _beyond)
        return RowLoss(lambda r: np.where(np.abs(r) < beta, 0.25 * r * r / beta, np.abs(r) - 0.5 * beta),
                       lambda r: np.where(np.abs(r) < beta, 1.0 / beta, _beyond(r)))
    raise ValueError(f"unknown loss {kind!r}")


def target_weights(cfg: RunConfig) -> np.ndarray:
    """Only the weighted loss weighs the targets."""
    return np.array(cfg.smooth_l1_weights if cfg.loss == "weighted_smooth_l1" else [1.0] * len(cfg.targets))


_KEYS = ("seed", "fold", "target")


def _labelled(folded: DataFrame, cfg: RunConfig) -> DataFrame:
    """Rows with every label, as in the squared fit."""
    every = None
    for t in cfg.targets:
        every = F.col(t).isNotNull() if every is None else every & F.col(t).isNotNull()
    return folded.where(every).select("seed", "fold", "features", *cfg.targets)


def _groups(rb: pa.RecordBatch, targets: Sequence[str]):
    """(seed, fold, design matrix, labels) of each (seed, fold) in a batch."""
    Z = design(matrix(rb, "features"))
    Y = np.column_stack([rb.column(rb.schema.get_field_index(t)).to_numpy(zero_copy_only=False).astype(np.float64)
                         for t in targets])
    keys = rb.select(["seed", "fold"]).to_pandas()
    for (s, f), at in keys.groupby(["seed", "fold"], sort=False).indices.items():
        yield int(s), int(f), Z[at], Y[at]


def weighted_partials(folded: DataFrame, coefs: dict, cfg: RunConfig) -> DataFrame:
    """Packed sums per (model, target) of each task: upper triangle of
    ``Z' A Z``, then ``Z' A y``, the loss and the rows, in chunks."""
    loss, weights, targets = row_loss(cfg.loss, cfg.smooth_l1_beta), target_weights(cfg), list(cfg.targets)
    d1 = cfg.n_features + 1
    upper = np.triu_indices(d1)

    def run(batches):
        sums: dict = {}
        for rb in batches:
            if not rb.num_rows:
                continue
            for s, f, Z, Y in _groups(rb, targets):
                for (s2, k), B in coefs.items():
                    if s2 != s or k == f:
                        continue
                    R = Y - Z @ B
                    A = loss.weight(R) * weights
                    said = (loss.value(R) * weights).sum(axis=0)
                    for t in range(len(targets)):
                        WZ = Z * A[:, t:t + 1]
                        own = np.concatenate([(WZ.T @ Z)[upper], WZ.T @ Y[:, t], [said[t], float(len(Y))]])
                        key = s, k, t
                        sums[key] = sums[key] + own if key in sums else own
        for (s, k, t), own in sums.items():
            n = -(-len(own) // CHUNK)
            padded = np.zeros(n * CHUNK)
            padded[:len(own)] = own
            cols = [pa.array(np.full(n, v, dtype=np.int32)) for v in (s, k, t)]
            cols += [pa.array(np.arange(n, dtype=np.int32)), fixed_lists(padded.reshape(n, CHUNK), np.float64)]
            yield pa.RecordBatch.from_arrays(cols, names=[*_KEYS, "chunk", "vals"])

    return folded.mapInArrow(run, "seed int, fold int, target int, chunk int, vals array<double>")


def _collected(partials: DataFrame, d1: int) -> dict:
    """{(seed, fold, target): (Z'AZ, Z'Ay, loss, rows)}."""
    out, upper = {}, np.triu_indices(d1)
    table = sum_partials(partials, _KEYS).toPandas()
    for key, g in table.groupby(list(_KEYS)):
        own = np.concatenate([np.asarray(v, dtype=np.float64) for v in g.sort_values("chunk")["vals"]])
        G = np.zeros((d1, d1))
        G[upper] = own[:len(upper[0])]
        rest = own[len(upper[0]):]
        out[tuple(int(k) for k in key)] = G + np.triu(G, 1).T, rest[:d1], rest[d1], rest[d1 + 1]
    return out


def fit_steps(folded: DataFrame, cfg: RunConfig, start: dict, tolerance: float | None = None,
              priors: dict | None = None) -> list[tuple[dict, dict]]:
    """[(coefficients of every model, train loss of every model)] per step.

    ``start`` holds the first coefficients (the squared fit). A step's pass
    gives its train loss and the next coefficients; the last step is the one
    whose successor moves no coefficient by more than ``tolerance``, or step
    number ``cfg.max_steps``. The train loss is the mean over rows and targets
    of the weighted element losses, without the penalty. ``priors`` pulls each
    model towards given coefficients with ``cfg.prior_lambda``.
    """
    tolerance = cfg.tolerance if tolerance is None else tolerance
    rows, d1, n = _labelled(folded, cfg), cfg.n_features + 1, len(cfg.targets)
    P = np.eye(d1) * cfg.ridge_lambda
    P[0, 0] = 0.0
    steps, coefs = [], {k: np.array(B, dtype=np.float64) for k, B in start.items()}
    for _ in range(cfg.max_steps):
        sums = _collected(weighted_partials(rows, coefs, cfg), d1)
        following, losses, moved = {}, {}, 0.0
        for key, B in coefs.items():
            new, lost, seen = B.copy(), 0.0, 0.0
            for t in range(n):
                if (*key, t) not in sums:  # no labelled row outside the fold
                    continue
                G, b, said, count = sums[(*key, t)]
                A = G + P
                if priors is not None:
                    A, b = A + np.eye(d1) * cfg.prior_lambda, b + cfg.prior_lambda * priors[key][:, t]
                new[:, t] = np.linalg.solve(A + np.eye(d1) * 1e-12, b)
                lost, seen = lost + said, seen + count
            following[key], losses[key] = new, lost / seen if seen else float("nan")
            moved = max(moved, float(np.abs(new - B).max()))
        steps.append((coefs, losses))
        if moved <= tolerance:
            break
        coefs = following
    return steps


_SCORES = "seed int, fold int, step int, target int, n long, squares double, loss double"


def score_steps(folded: DataFrame, steps: Sequence[dict], cfg: RunConfig) -> DataFrame:
    """(seed, fold, step, val_mcrmse, val_loss, targets): every step of every
    model on the rows of its own fold, all steps in one pass over the rows.

    Each task sums squared errors and losses per (seed, fold, step, target), so
    what is shuffled does not grow with the rows. A missing label counts for
    no target's score.
    """
    loss, weights, targets = row_loss(cfg.loss, cfg.smooth_l1_beta), target_weights(cfg), list(cfg.targets)
    names = ["seed", "fold", "step", "target", "n", "squares", "loss"]
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        sums: dict = {}
        for rb in batches:
            if not rb.num_rows:
                continue
            for s, f, Z, Y in _groups(rb, targets):
                known = ~np.isnan(Y)
                for step, coefs in enumerate(steps):
                    if (s, f) not in coefs:
                        continue
                    R = np.where(known, Y - apply_model(coefs[s, f], Z), 0.0)
                    own = np.stack([known.sum(axis=0), (R * R).sum(axis=0),
                                    (np.where(known, loss.value(R), 0.0) * weights).sum(axis=0)])
                    key = s, f, step
                    sums[key] = sums[key] + own if key in sums else own
        rows = [(*key, t, int(v[0, t]), v[1, t], v[2, t]) for key, v in sums.items() for t in range(len(targets))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)

    parts = folded.select("seed", "fold", "features", *targets).mapInArrow(run, _SCORES)
    per = parts.groupBy("seed", "fold", "step").agg(
        *[F.sqrt(F.sum(F.when(F.col("target") == t, F.col("squares"))) /
                 F.sum(F.when(F.col("target") == t, F.col("n")))).alias(name) for t, name in enumerate(targets)],
        (F.sum("loss") / F.sum("n")).alias("val_loss"))
    mean = sum((F.col(t) for t in targets), F.lit(0.0)) / F.lit(float(len(targets)))
    return per.select("seed", "fold", "step", mean.alias("val_mcrmse"), "val_loss", *targets)
