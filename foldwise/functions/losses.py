"""Per-element loss and error expressions; reductions are plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_error(pred: Column, label: Column) -> Column:
    d = pred - label
    return d * d


def smooth_l1(pred: Column, label: Column, beta: float = 1.0) -> Column:
    """Usual smooth L1: 0.5 d^2 / beta below beta, d - 0.5 beta above."""
    d = F.abs(pred - label)
    if beta <= 0:
        return d
    return F.when(d < F.lit(beta), F.lit(0.5) * d * d / F.lit(beta)).otherwise(d - F.lit(0.5 * beta))


def weighted_smooth_l1_element(pred: Column, label: Column, beta: float, canonical: bool = False) -> Column:
    """Element of the weighted smooth-L1 loss (weights applied by the caller).

    The scored task defines the quadratic branch as ``(0.5 n)^2 / beta``;
    ``canonical=True`` gives the usual ``0.5 n^2 / beta``. A beta below 1e-5
    means plain absolute error.
    """
    n = F.abs(pred - label)
    if beta < 1e-5:
        return n
    half = F.lit(0.5) * n
    quad = (F.lit(0.5) * n * n / F.lit(beta)) if canonical else (half * half / F.lit(beta))
    return F.when(n < F.lit(beta), quad).otherwise(n - F.lit(0.5 * beta))


def rmse_loss_element(pred: Column, label: Column, eps: float = 1e-9) -> Column:
    """sqrt((pred - label)^2 + eps) per element (close to absolute error)."""
    d = pred - label
    return F.sqrt(d * d + F.lit(eps))
