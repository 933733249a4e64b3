"""foldwise: Spark jobs for supervised text-scoring experiment data.

Dataset variants, multilabel-stratified folds, per-fold fit/predict,
out-of-fold tables, column-wise RMSE scoring, fold ensembles, pseudo
labels and token-embedding pooling, all expressed as DataFrame jobs.
"""

from foldwise.config import TARGETS, SEEDS, N_FOLDS, RunConfig

__all__ = ["TARGETS", "SEEDS", "N_FOLDS", "RunConfig"]
