"""Fold models that need no text features: the fold-mean predictor.

Model k of a seed predicts, for every target, the mean label over the rows
*not* in fold k. It is fitted from one aggregate per (seed, fold): the train
statistics of fold k are the seed totals minus fold k's own, so no fold
rereads the data. It gives the out-of-fold path an exact SQL oracle and is a
baseline for the ridge models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.config import N_FOLDS, SEEDS, TARGETS
from foldwise.operators.joins import seed_fold_grid


def fold_stats(folded: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Per (seed, fold): rows, and per target the labels that are not null and
    their sum (partial aggregation, tiny output)."""
    return folded.groupBy("seed", "fold").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(t).cast("double")).alias(f"_s_{t}") for t in targets],
        *[F.count(t).alias(f"_c_{t}") for t in targets])


def fold_mean_models(spark: SparkSession, folded: DataFrame, seeds: Sequence[int] = SEEDS,
                     n_folds: int = N_FOLDS, targets: Sequence[str] = TARGETS) -> DataFrame:
    """(seed, fold, n_train, target means over the other folds). A null label
    counts in no mean; a target without labels in the other folds is null."""
    per = fold_stats(folded, targets)
    tot = per.groupBy("seed").agg(F.sum("_n").alias("_tn"), *[F.sum(f"_s_{t}").alias(f"_ts_{t}") for t in targets],
                                  *[F.sum(f"_c_{t}").alias(f"_tc_{t}") for t in targets])
    grid = seed_fold_grid(spark, seeds, range(n_folds))
    g = grid.join(tot, "seed").join(per, ["seed", "fold"], "left")
    n_train = F.col("_tn") - F.coalesce(F.col("_n"), F.lit(0))
    def mean(t):
        n = F.col(f"_tc_{t}") - F.coalesce(F.col(f"_c_{t}"), F.lit(0))
        return F.when(n > 0, (F.col(f"_ts_{t}") - F.coalesce(F.col(f"_s_{t}"), F.lit(0.0))) / n)

    means = [mean(t).alias(t) for t in targets]
    return g.select("seed", "fold", n_train.alias("n_train"), *means)


def predict_constant(rows: DataFrame, models: DataFrame, keys: Sequence[str] = ("seed", "fold"),
                     targets: Sequence[str] = TARGETS) -> DataFrame:
    """Attach each row's model output by key (models: one row per key, a
    (seed x fold) table, so the join is a broadcast of a size fixed by the run)."""
    m = models.select(*keys, *targets)
    return rows.drop(*[t for t in targets if t in rows.columns]).join(F.broadcast(m), list(keys))


def score_constant(folded: DataFrame, models: DataFrame, keys: Sequence[str] = ("seed", "fold"),
                   targets: Sequence[str] = TARGETS) -> DataFrame:
    """Scored table (y_t, p_t) of constant fold models without re-joining rows:
    labels are already on the folded rows, predictions come from a broadcast
    of the (seed x fold) model table."""
    m = models.select(*keys, *[F.col(t).alias(f"p_{t}") for t in targets])
    rows = folded.select(*keys, "text_id", *[F.col(t).cast("double").alias(f"y_{t}") for t in targets])
    return rows.join(F.broadcast(m), list(keys))
