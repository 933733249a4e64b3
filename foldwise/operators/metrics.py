"""Scores and losses as aggregates over label/prediction tables joined by key.

A *scored* table has one row per (key, ...) with label columns ``y_<t>`` and
prediction columns ``p_<t>``; ``align`` builds it with a keyed join, replacing
positional alignment. Every metric is one multi-expression ``agg`` (one scan,
partial aggregation before the shuffle), grouped by whatever dimension the
caller names (seed, fold, step, ...).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.config import BATCH_SIZE, EPOCHS, SMOOTH_L1_WEIGHTS, TARGETS
from foldwise.functions.losses import rmse_loss_element, smooth_l1, squared_error, weighted_smooth_l1_element


def y(t: str) -> str:
    return f"y_{t}"


def p(t: str) -> str:
    return f"p_{t}"


def align(labels: DataFrame, preds: DataFrame, keys: Sequence[str], targets: Sequence[str] = TARGETS,
          how: str = "left", carry: Sequence[str] = ()) -> DataFrame:
    """Join labels and predictions by key into a scored table; ``carry`` keeps
    extra prediction-side columns (e.g. the validation step). Every label row
    stays, so a score can tell that a prediction is missing."""
    keys = list(keys)
    lab = labels.select(*keys, *[F.col(t).cast("double").alias(y(t)) for t in targets])
    pre = preds.select(*keys, *carry, *[F.col(t).cast("double").alias(p(t)) for t in targets])
    return lab.join(pre, keys, how)


def mcrmse(scored: DataFrame, group_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS) -> DataFrame:
    """Per group: RMSE of each target (named by the target) and their mean
    ``mcrmse``. A labelled row without a prediction fails the job: the check is
    part of the same aggregation."""
    def rmse(t):
        missing = F.count(F.when(F.col(y(t)).isNotNull() & F.col(p(t)).isNull(), 1))
        score = F.sqrt(F.avg(squared_error(F.col(p(t)), F.col(y(t)))))
        said = F.concat(missing.cast("string"), F.lit(f" labelled rows have no prediction of {t}"))
        return F.when(missing > 0, F.raise_error(said).cast("double")).otherwise(score)

    aggs = [rmse(t).alias(t) for t in targets]
    out = scored.groupBy(*group_cols).agg(*aggs)
    mean = sum((F.col(t) for t in targets), F.lit(0.0)) / F.lit(float(len(targets)))
    return out.select(*group_cols, mean.alias("mcrmse"), *targets)


def column_rmse_long(scores: DataFrame, group_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS) -> DataFrame:
    """The per-target columns of an ``mcrmse`` result as (group..., target, rmse) rows."""
    return scores.select(*group_cols, *targets).unpivot(list(group_cols), list(targets), "target", "rmse")


def seed_mean(scores: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Mean over seeds of the score and of each column score (not pooled)."""
    return scores.agg(F.avg("mcrmse").alias("mcrmse"), *[F.avg(t).alias(t) for t in targets])


def _long_errors(scored: DataFrame, group_cols: Sequence[str], targets: Sequence[str], weights=None) -> DataFrame:
    items = []
    for i, t in enumerate(targets):
        fields = [F.col(p(t)).alias("p"), F.col(y(t)).alias("y")]
        if weights is not None:
            fields.append(F.lit(float(weights[i])).alias("w"))
        items.append(F.struct(*fields))
    return scored.select(*group_cols, F.explode(F.array(*items)).alias("e")).select(*group_cols, "e.*")


def smooth_l1_mean(scored: DataFrame, group_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS,
                   beta: float = 1.0, name: str = "smooth_l1") -> DataFrame:
    """Mean smooth-L1 over all (row, target) elements of each group."""
    long = _long_errors(scored, group_cols, targets)
    return long.groupBy(*group_cols).agg(F.avg(smooth_l1(F.col("p"), F.col("y"), beta)).alias(name))


def weighted_smooth_l1_sum(scored: DataFrame, group_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS,
                           beta: float = 1.0, weights: Sequence[float] = SMOOTH_L1_WEIGHTS, canonical: bool = False,
                           name: str = "weighted_smooth_l1") -> DataFrame:
    """Sum over rows and targets of weight_t * element loss (sum reduction)."""
    terms = [F.lit(float(w)) * weighted_smooth_l1_element(F.col(p(t)), F.col(y(t)), beta, canonical)
             for t, w in zip(targets, weights)]
    row_loss = sum(terms[1:], terms[0])
    return scored.groupBy(*group_cols).agg(F.sum(row_loss).alias(name))


def rmse_loss(scored: DataFrame, group_cols: Sequence[str] = (), targets: Sequence[str] = TARGETS,
              eps: float = 1e-9) -> DataFrame:
    """Element-wise sqrt(d^2 + eps), reduced by mean and by sum."""
    long = _long_errors(scored, group_cols, targets)
    e = rmse_loss_element(F.col("p"), F.col("y"), eps)
    return long.groupBy(*group_cols).agg(F.avg(e).alias("rmse_loss_mean"), F.sum(e).alias("rmse_loss_sum"))


def loss(scored: DataFrame, kind: str, group_cols: Sequence[str] = (), **params) -> DataFrame:
    """Loss chosen by name: ``smooth_l1``, ``weighted_smooth_l1`` or ``rmse_loss``."""
    if kind == "smooth_l1":
        return smooth_l1_mean(scored, group_cols, **params)
    if kind == "weighted_smooth_l1":
        return weighted_smooth_l1_sum(scored, group_cols, **params)
    if kind == "rmse_loss":
        return rmse_loss(scored, group_cols, **params)
    raise ValueError(f"unknown loss {kind!r}")


def step_counts(folded: DataFrame, seed_col: str = "seed", fold_col: str = "fold", n_folds: int = 5,
                batch_size: int = BATCH_SIZE, epochs: int = EPOCHS) -> DataFrame:
    """Training steps per (seed, fold): ceil(train rows / batch) * epochs.

    Train rows of fold k = all rows of the seed minus the rows of fold k, from
    one aggregate per (seed, fold).
    """
    per = folded.groupBy(seed_col, fold_col).agg(F.count(F.lit(1)).alias("n_valid"))
    tot = per.groupBy(seed_col).agg(F.sum("n_valid").alias("_total"))
    out = per.join(tot, seed_col).withColumn("n_train", F.col("_total") - F.col("n_valid"))
    steps = (F.ceil(F.col("n_train") / F.lit(batch_size)) * F.lit(epochs)).cast("bigint")
    return out.select(seed_col, fold_col, "n_train", "n_valid", steps.alias("n_steps"))


def best_step(log: DataFrame, group_cols: Sequence[str] = ("seed", "fold"), step_col: str = "step",
              value_col: str = "val_mcrmse") -> DataFrame:
    """Step with the smallest monitored value per group; ties go to the earliest step."""
    order = F.struct(F.col(value_col), F.col(step_col))
    return log.groupBy(*group_cols).agg(
        F.min_by(F.col(step_col), order).alias("best_step"),
        F.min(value_col).alias("best_value"))


def fold_ensemble(preds: DataFrame, key: str = "text_id", model_col: str = "fold",
                  targets: Sequence[str] = TARGETS) -> DataFrame:
    """Element-wise mean over fold models, with the number of models seen."""
    return preds.groupBy(key).agg(*[F.avg(t).alias(t) for t in targets],
                                  F.count(F.lit(1)).alias("n_models"))


def checked_ensemble(ensembled: DataFrame, n_models: int, key: str = "text_id",
                     targets: Sequence[str] = TARGETS) -> DataFrame:
    """The ensemble without its model count; a row whose mean is not of exactly
    ``n_models`` predictions fails the job that reads it."""
    said = F.concat(F.lit(f"incomplete ensemble: {n_models} models expected, "), F.col("n_models").cast("string"))
    right = F.col("n_models") == F.lit(n_models)
    return ensembled.select(key, *[F.when(right, F.col(t)).otherwise(F.raise_error(said).cast("double")).alias(t)
                                   for t in targets])


def assert_complete(ensembled: DataFrame, n_models: int) -> None:
    """Raise if some key did not get exactly ``n_models`` predictions (action)."""
    bad = ensembled.where(F.col("n_models") != F.lit(n_models)).limit(1).collect()
    if bad:
        raise ValueError(f"incomplete ensemble: {bad[0].asDict()}")


def metrics_long(scores: DataFrame, id_cols: Sequence[str], metric_cols: Sequence[str],
                 prefix: str = "", suffix: str = "") -> DataFrame:
    """Unpivot a wide metric row into (id..., metric, value) log rows."""
    renamed = scores.select(*id_cols, *[F.col(c).alias(f"{prefix}{c}{suffix}") for c in metric_cols])
    return renamed.unpivot(list(id_cols), [f"{prefix}{c}{suffix}" for c in metric_cols], "metric", "value")
