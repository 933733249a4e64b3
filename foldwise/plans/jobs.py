"""End-to-end jobs composed from operators.

* ``build_dataset_bundle``  -- dataset variant + folds for all seeds, one write.
* ``make_submission``       -- template ids left-joined with ensembled predictions.
* ``score_log``             -- per-seed scores and seed means as metric rows.
* ``pseudo_label_tables``   -- corpus minus train, labelled by each fold model.
* ``run_experiment``        -- folds -> fit per (seed, fold) -> OOF -> scores -> log.
* ``inference``             -- fold ensemble on the test set -> submission.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.config import N_FOLDS, SEEDS, TARGETS, RunConfig
from foldwise.operators import metrics as M
from foldwise.operators.datasets import sample_oof, with_variant
from foldwise.operators.folds import assign_folds
from foldwise.operators.joins import anti_join_prefiltered
from foldwise.sources.csv import write_csv
from foldwise.sources.processed import write_table


def build_dataset_bundle(train: DataFrame, test: DataFrame, template: DataFrame, root: str,
                         data_version: str = "vanilla", seeds: Sequence[int] = SEEDS,
                         n_folds: int = N_FOLDS) -> None:
    """Write train (per seed and fold), test, sample_submission and sample_oof.

    Train is folded for every seed in one job (the text travels through the
    fold shuffle once) and written partitioned by (data_version, seed, fold).
    Tables that do not depend on the seed are written once per version
    instead of once per seed. Overwrite is dynamic: rewriting a version only
    replaces its own partitions.
    """
    v = F.lit(data_version)
    folded = assign_folds(with_variant(train, data_version, "train"), seeds, n_folds)
    write_table(folded.withColumn("data_version", v), root, "train", ("data_version", "seed", "fold"))
    write_table(with_variant(test, data_version, "test").withColumn("data_version", v), root, "test", ("data_version",))
    write_table(template.withColumn("data_version", v), root, "sample_submission", ("data_version",))
    write_table(sample_oof(train).withColumn("data_version", v), root, "sample_oof", ("data_version",))


def make_submission(template: DataFrame, preds: DataFrame, path: str, key: str = "text_id",
                    targets: Sequence[str] = TARGETS) -> DataFrame:
    """Template ids (its own target columns are replaced by name) + predictions -> CSV."""
    sub = template.select(key).join(preds.select(key, *targets), key, "left")
    write_csv(sub, path)
    return sub


def score_log(scores: DataFrame, run: str, targets: Sequence[str] = TARGETS) -> DataFrame:
    """(run, seed, metric, value): per-seed OOF score and column scores, then
    the seed means with seed NULL. Column scores use the target names."""
    s = scores.withColumnRenamed("mcrmse", "oof_score")
    names = ["oof_score", *targets]
    per_seed = M.metrics_long(s, ["seed"], names)
    means = s.agg(*[F.avg(c).alias(c) for c in names]).withColumn("seed", F.lit(None).cast("int"))
    mean_rows = M.metrics_long(means, ["seed"], names, suffix="_seed_mean")
    return per_seed.unionByName(mean_rows).select(F.lit(run).alias("run"), "seed", "metric", "value")


def params_log(cfg: RunConfig) -> list[tuple[str, str, str]]:
    """(run, key, value) rows of a run's hyper-parameters."""
    return [(cfg.run_name, k, v) for k, v in sorted(cfg.as_params().items())]


def pseudo_base(train: DataFrame, corpus: DataFrame) -> DataFrame:
    """Corpus rows whose id is not a train id (null-safe); computed once for all seeds.
    Texts that a filter of the train ids rules out are not shuffled."""
    return anti_join_prefiltered(corpus, train.select("text_id"), "text_id")


def pseudo_label_tables(spark: SparkSession, train: DataFrame, corpus: DataFrame, model: str = "fold_mean",
                        seeds: Sequence[int] = SEEDS, n_folds: int = N_FOLDS, cfg: RunConfig | None = None,
                        targets: Sequence[str] = TARGETS) -> DataFrame:
    """(seed, fold, text_id, targets): pseudo labels of fold k come from model k only.

    Model k never saw fold k's labels, and the pseudo table of fold k is only
    used to pretrain fold k, so no fold-k label leaks into its own model.
    The table is narrow (ids + targets); texts stay in the pseudo base.
    """
    base = pseudo_base(train, corpus)
    if model == "fold_mean":
        from foldwise.session import materialize
        folded = materialize(assign_folds(train.select("text_id", *targets), seeds, n_folds, targets))
        from foldwise.operators.models import fold_mean_models, predict_constant
        models = fold_mean_models(spark, folded, seeds, n_folds, targets)
        rows = base.select("text_id")
        rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
        rows = rows.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(n_folds)])))
        return predict_constant(rows, models).select("seed", "fold", "text_id", *targets)
    if model == "ridge":
        from foldwise.operators import ridge
        cfg = cfg or RunConfig(seeds=tuple(seeds), n_folds=n_folds)
        coefs = ridge.fit_fold_models(spark, _featurized_folds(spark, train, cfg), cfg)
        return ridge.predict_every_fold(spark, ridge.featurize(base, cfg.n_features), coefs, cfg)
    raise ValueError(f"unknown model {model!r}")


def _featurized_folds(spark: SparkSession, train: DataFrame, cfg: RunConfig) -> DataFrame:
    """Features once, then folds for all seeds; materialised in the shared folder
    (fit and OOF prediction both read it; lineage is cut after the shuffle).

    Every row keeps its place in every seed, also without an id: features and
    folds meet by a row number written with the features. An id that occurs
    twice fails the job."""
    from foldwise.operators import ridge
    from foldwise.operators.joins import assert_unique
    from foldwise.session import materialize
    targets = list(cfg.targets)
    x = with_variant(train, cfg.data_version, "train").select("text_id", "full_text", *targets)
    feats = materialize(ridge.featurize(x, cfg.n_features, row_col="_row"), "features")
    assert_unique(feats.where(F.col("text_id").isNotNull()), ["text_id"], "train")
    # folds from the narrow columns; the fold operator reads its input more than once
    folds = assign_folds(feats.select("_row", "text_id", *targets), cfg.seeds, cfg.n_folds, targets)
    if cfg.debug:
        # reduced run: the first debug_rows ids of every fold (models of the
        # trained folds still learn from all other folds' reduced rows)
        from foldwise.operators.splits import head_per_group
        folds = head_per_group(folds, ["seed", "fold"], ["text_id", "_row"], cfg.debug_rows)
    return materialize(folds.join(feats.select("_row", "features"), "_row").drop("_row"), "featurized-folds")


def fit_run(spark: SparkSession, folded: DataFrame, cfg: RunConfig, priors: dict | None = None,
            grams: dict | None = None) -> tuple[dict, DataFrame]:
    """Fit every (seed, fold) model with the loss the run names and score it
    step by step on its own fold.

    Returns (coefficients, step log): the squared fit has one step; any other
    loss starts from it and has one step per iteration, of which each model
    keeps the one with the smallest validation score, the earliest of equals.
    The log has rows (run, seed, fold, step, metric, value) with the metrics
    train_loss, val_loss, val_mcrmse and val_<target>.
    """
    from foldwise.operators import ridge, robust
    start = ridge.fit_fold_models(spark, folded, cfg, priors, grams)
    steps, losses = [start], []
    if cfg.loss != "squared":
        fitted = robust.fit_steps(folded, cfg, start, priors=priors)
        steps, losses = [c for c, _ in fitted], [said for _, said in fitted]
    trained = folded.where(F.col("fold").isin(list(cfg.train_folds)))
    scores = robust.score_steps(trained, steps, cfg)
    chosen = steps[-1]
    if len(steps) > 1:
        from foldwise.session import materialize
        scores = materialize(scores, "step-scores")  # one row per seed, fold and step
        best = M.best_step(scores.select("seed", "fold", "step", "val_mcrmse")).collect()
        chosen = chosen | {(r["seed"], r["fold"]): steps[r["best_step"]][r["seed"], r["fold"]] for r in best}
    return chosen, step_log(spark, scores, losses, cfg)


def step_log(spark: SparkSession, scores: DataFrame, losses: Sequence[dict], cfg: RunConfig) -> DataFrame:
    """(run, seed, fold, step, metric, value) of a run's steps."""
    targets, keys = list(cfg.targets), ["seed", "fold", "step"]
    named = scores.select(*keys, "val_mcrmse", "val_loss", *[F.col(t).alias(f"val_{t}") for t in targets])
    log = named.unpivot(keys, ["val_mcrmse", "val_loss", *[f"val_{t}" for t in targets]], "metric", "value")
    rows = [(s, k, step, "train_loss", float(v)) for step, per in enumerate(losses) for (s, k), v in sorted(per.items())]
    if rows:
        log = log.unionByName(spark.createDataFrame(rows, "seed INT, fold INT, step INT, metric STRING, value DOUBLE"))
    return log.select(F.lit(cfg.run_name).alias("run"), *keys, "metric", "value")


def run_experiment(spark: SparkSession, train: DataFrame, cfg: RunConfig = RunConfig(),
                   priors: dict | None = None):
    """Fit every (seed, fold) model, assemble OOF, score per seed, log.

    Returns (coefficients dict, OOF DataFrame, per-seed scores, metric log).
    The log holds the steps of every fold (seed, fold, step) and the OOF scores
    per seed and their means (fold and step null).
    """
    folded = _featurized_folds(spark, train, cfg)
    coefs, steps = fit_run(spark, folded, cfg, priors)
    return (coefs, *_evaluate(folded, coefs, cfg, cfg.run_name, steps))


def _evaluate(folded: DataFrame, coefs: dict, cfg: RunConfig, run: str, steps: DataFrame):
    """OOF of the trained folds, per-seed scores and the metric log."""
    from foldwise.operators import ridge
    targets = list(cfg.targets)
    trained = folded.where(F.col("fold").isin(list(cfg.train_folds)))
    oof = ridge.predict_own_fold(trained, coefs, targets, labels=True)
    scored = oof.select("seed", *[F.col(f"y_{t}") for t in targets], *[F.col(t).alias(f"p_{t}") for t in targets])
    scores = M.mcrmse(scored, ["seed"], targets)
    empty = F.lit(None).cast("int")
    log = score_log(scores, run, targets).select("run", "seed", empty.alias("fold"), empty.alias("step"), "metric", "value")
    return oof.drop(*[f"y_{t}" for t in targets]), scores, steps.withColumn("run", F.lit(run)).unionByName(log)


def inference(spark: SparkSession, test: DataFrame, coefs: dict, template: DataFrame, path: str | None = None,
              cfg: RunConfig = RunConfig(), seed: int | None = None) -> DataFrame:
    """Fold ensemble on the test set: the mean over the fold models of ``seed``
    (all seeds when None), taken per row inside the task. The job fails if a
    model of a trained fold is missing, or if a row's mean is not of them all."""
    from foldwise.operators import ridge
    seeds = sorted({k[0] for k in coefs}) if seed is None else [seed]
    missing = [(s, k) for s in seeds for k in cfg.train_folds if (s, k) not in coefs]
    if missing or not seeds:
        raise ValueError(f"incomplete ensemble: no model of (seed, fold) {missing}")
    use = {(s, k): coefs[s, k] for s in seeds for k in cfg.train_folds}
    feats = ridge.featurize(with_variant(test, cfg.data_version, "test").select("text_id", "full_text"), cfg.n_features)
    ens = M.checked_ensemble(ridge.predict_ensemble(feats, use, cfg.targets), len(use), "text_id", cfg.targets)
    if path is not None:
        return make_submission(template, ens, path, targets=cfg.targets)
    return template.select("text_id").join(ens, "text_id", "left")


def pretrain_paths(spark: SparkSession, base: DataFrame, teachers: dict, grams: dict, cfg: RunConfig):
    """Priors and fine-tuned squared fits of every (seed, fold), with the path
    of penalties behind each choice.

    ``base`` are pseudo rows (text_id, features) that model (seed, fold) of
    ``teachers`` labels itself. Per seed, 80 % of them train and 20 % validate
    (``hash_threshold``). The labels are linear in the features, so the Gram
    matrices of the features of all rows and of each seed's validation rows
    serve all models. Every penalty's prior is judged on the validation rows,
    every weight of the prior on the fold's own labelled rows (as a checkpoint
    is picked by its validation score); neither needs a further pass.

    Returns (priors, fine-tuned coefficients, [(seed, fold, stage, weight, error, chosen)]).
    """
    from foldwise.operators import paths, ridge
    from foldwise.operators.splits import hash_threshold, split_hash
    d1, n, targets = cfg.n_features + 1, len(cfg.targets), list(cfg.targets)
    seeds = [F.lit(-1)]
    for seed in cfg.seeds:
        last = hash_threshold(base, seed)
        if last is not None:
            seeds.append(F.when(split_hash(seed, "text_id") <= F.lit(last), F.lit(int(seed))))
    rows = base.select(F.explode(F.array_compact(F.array(*seeds))).alias("seed"), F.lit(0).alias("fold"), "features")
    sums = ridge.collect_grams(ridge.gram_tables(rows, []), d1)
    whole = sums.get((-1, 0), np.zeros((d1, d1)))
    totals: dict = {}
    for (s, _), G in grams.items():
        totals[s] = totals.get(s, 0) + G
    priors, tuned, log = {}, {}, []
    for (s, k), teacher in sorted(teachers.items()):
        valid = sums.get((s, 0), np.zeros((d1, d1)))
        path = paths.ridge_path(paths.with_labels(whole - valid, teacher), n, cfg.penalties)
        errors = [paths.held_out_score(paths.with_labels(valid, teacher), B) for B in path]
        at = paths.best(errors)
        priors[s, k] = path[at]
        log += [(s, k, "pretrain", float(w), e, i == at) for i, (w, e) in enumerate(zip(cfg.penalties, errors))]
        own = grams.get((s, k), np.zeros((d1 + n, d1 + n)))
        path = paths.prior_path(totals.get(s, np.zeros((d1 + n, d1 + n))) - own, n, cfg.ridge_lambda, priors[s, k],
                                cfg.prior_weights)
        errors = [paths.held_out_score(own, B) for B in path]
        at = paths.best(errors)
        tuned[s, k] = path[at]
        log += [(s, k, "finetune", float(w), e, i == at) for i, (w, e) in enumerate(zip(cfg.prior_weights, errors))]
    return priors, tuned, log


PATH_SCHEMA = "seed INT, fold INT, stage STRING, weight DOUBLE, error DOUBLE, chosen BOOLEAN"


def pretrain_finetune(spark: SparkSession, train: DataFrame, corpus: DataFrame, cfg: RunConfig = RunConfig()):
    """Pseudo-label pretraining, then fine-tuning on the train folds.

    1. Pseudo rows: corpus minus train, labelled by each fold's ridge model.
    2. Pretrain: ridge on 80 % of the pseudo rows -> prior B0(seed, fold), with
       the penalty that does best on the other 20 %.
    3. Fine-tune: ridge on the train folds pulled towards B0 (the linear
       analogue of starting from the pretrained weights), with the weight that
       does best on the fold's own rows. Returns the same tuple as
       ``run_experiment``; the log also holds both paths, with the penalty or
       weight in the metric's name.
    """
    coefs, folded, path, _ = _pretrained(spark, train, corpus, cfg)
    run = cfg.run_name + "_pseudo_pretrain"
    rows = [(run, s, k, None, f"{stage}_{w:g}", float(e)) for s, k, stage, w, e, _ in path]
    steps = spark.createDataFrame(rows, "run STRING, seed INT, fold INT, step INT, metric STRING, value DOUBLE")
    return (coefs, *_evaluate(folded, coefs, cfg, run, steps))


def pretrain_path(spark: SparkSession, train: DataFrame, corpus: DataFrame, cfg: RunConfig = RunConfig()) -> DataFrame:
    """(seed, fold, stage, weight, error, chosen): validation error of every
    penalty of the pretraining fit and of every weight of its prior."""
    return spark.createDataFrame(_pretrained(spark, train, corpus, cfg)[2], PATH_SCHEMA)


def _pretrained(spark: SparkSession, train: DataFrame, corpus: DataFrame, cfg: RunConfig):
    from foldwise.operators import ridge
    from foldwise.session import materialize
    folded = _featurized_folds(spark, train, cfg)
    grams = ridge.fold_grams(folded, cfg)  # one scan; all solves below reuse it
    teachers = ridge.fit_fold_models(spark, folded, cfg, grams=grams)
    base = materialize(ridge.featurize(pseudo_base(train, corpus).select("text_id", "full_text"), cfg.n_features))
    priors, tuned, path = pretrain_paths(spark, base, teachers, grams, cfg)
    return tuned, folded, path, priors


def write_pseudo_tables(spark: SparkSession, train: DataFrame, corpus: DataFrame, root: str, model: str = "fold_mean",
                        seeds: Sequence[int] = SEEDS, n_folds: int = N_FOLDS, cfg: RunConfig | None = None,
                        data_version: str = "pseudo_1") -> None:
    """Pseudo base (texts, null targets) once per version, and the pseudo
    labels of every (seed, fold) as narrow rows partitioned by seed and fold."""
    v = F.lit(data_version)
    base = pseudo_base(train, corpus).select("text_id", "full_text",
                                             *[F.lit(None).cast("double").alias(t) for t in TARGETS])
    write_table(base.withColumn("data_version", v), root, "pseudo_base", ("data_version",))
    labels = pseudo_label_tables(spark, train, corpus, model, seeds, n_folds, cfg)
    write_table(labels.withColumn("data_version", v), root, "pseudo", ("data_version", "seed", "fold"))


def read_pseudo(spark: SparkSession, root: str, seed: int, fold: int, data_version: str = "pseudo_1",
                targets: Sequence[str] = TARGETS) -> DataFrame:
    """Pseudo table of (seed, fold) with texts: pruned label partitions joined
    to the base texts by id."""
    from foldwise.sources.processed import pseudo, read_table
    labels = pseudo(spark, root, seed, fold, data_version).select("text_id", *targets)
    texts = read_table(spark, root, "pseudo_base", data_version).select("text_id", "full_text")
    return labels.join(texts, "text_id").select("text_id", "full_text", *targets)
