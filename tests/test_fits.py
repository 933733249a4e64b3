"""Fits of every loss, steps, penalty paths, splits and rows without id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.config import TARGETS, RunConfig
from foldwise.operators import metrics as M
from foldwise.operators import paths, ridge, robust, splits
from foldwise.plans import fixtures as FX
from foldwise.plans import jobs
from foldwise.sources import processed
from tests.conftest import SF001

SQUARED = RunConfig(run_name="t", n_features=4, ridge_lambda=0.5, seeds=(42,), loss="squared")


@pytest.fixture(scope="module")
def train(spark):
    """Essays whose scores have outliers, so that the losses differ."""
    x = FX.essays(spark, SF001).select("text_id", "full_text", "doc_id", *TARGETS)
    far = F.when(F.col("doc_id") % 7 == 0, F.lit(6.0)).otherwise(F.lit(0.0))
    return x.withColumns({t: F.col(t) + far for t in TARGETS}).drop("doc_id")


@pytest.fixture(scope="module")
def folded(spark, train):
    return jobs._featurized_folds(spark, train, SQUARED)


def numbers(folded, seed, fold, own=False):
    rows = folded.where((F.col("seed") == seed) & ((F.col("fold") == fold) if own else (F.col("fold") != fold)))
    pdf = rows.select("features", *TARGETS).toPandas()
    X = np.stack(pdf.features.to_numpy()).astype(np.float64)
    return np.hstack([np.ones((len(X), 1)), X]), pdf[TARGETS].to_numpy()


def slope(kind, r, beta):
    """Derivative of the element loss, written out anew."""
    if kind == "squared":
        return r
    if kind == "rmse_loss":
        return r / np.sqrt(r * r + 1e-9)
    return np.clip(r / beta, -1, 1)


def minimise(kind, Z, y, beta, weight, lam):
    """Plain gradient descent with momentum on the convex objective."""
    P = np.array([0.0] + [lam] * (Z.shape[1] - 1))
    b = np.linalg.solve(Z.T @ Z + np.diag(P + 1e-9), Z.T @ y)
    bound = {"squared": 1.0, "smooth_l1": 1 / beta, "weighted_smooth_l1": 1 / beta, "rmse_loss": 1 / np.sqrt(1e-9)}[kind]
    step = 1.0 / (weight * bound * np.linalg.eigvalsh(Z.T @ Z)[-1] + lam)
    v, old = b.copy(), b.copy()
    for k in range(60_000):
        b = v - step * (-weight * Z.T @ slope(kind, y - Z @ v, beta) + P * v)
        v = b + k / (k + 3) * (b - old)
        if np.dot(v - b, b - old) < 0:
            v = b
        old = b
    return b


@pytest.mark.parametrize("kind", ["squared", "smooth_l1", "weighted_smooth_l1"])
def test_fit_equals_a_plain_minimiser(spark, folded, kind):
    cfg = RunConfig(run_name="t", n_features=4, ridge_lambda=0.5, seeds=(42,), loss=kind, smooth_l1_beta=0.7,
                    max_steps=60, tolerance=1e-7)
    start = ridge.fit_fold_models(spark, folded, cfg)
    steps = robust.fit_steps(folded, cfg, start)
    B = steps[-1][0]
    assert len(steps) == 1 if kind == "squared" else len(steps) > 3
    weights = robust.target_weights(cfg)
    Z, Y = numbers(folded, 42, 1)
    for t in (0, 2):
        want = minimise(kind, Z, Y[:, t], 0.7, weights[t], 0.5)
        assert np.allclose(B[42, 1][:, t], want, atol=2e-5)


def test_absolute_like_loss_is_stationary(spark, folded):
    cfg = RunConfig(run_name="t", n_features=4, ridge_lambda=0.5, seeds=(42,), loss="rmse_loss", max_steps=12)
    steps = robust.fit_steps(folded, cfg, ridge.fit_fold_models(spark, folded, cfg))
    Z, Y = numbers(folded, 42, 0)
    said = [loss[42, 0] for _, loss in steps]
    R = Y - Z @ steps[-1][0][42, 0]
    assert said[-1] == pytest.approx(np.sqrt(R * R + 1e-9).mean(), rel=1e-9)
    penalty = [0.25 * (B[42, 0][1:] ** 2).sum() / Y.size for B, _ in steps]
    whole = [a + b for a, b in zip(said, penalty)]
    assert all(x >= y - 1e-12 for x, y in zip(whole, whole[1:])) and whole[-1] < whole[0]


def test_losses_give_different_models(spark, train):
    out = {}
    for kind in ("squared", "smooth_l1", "weighted_smooth_l1", "rmse_loss"):
        cfg = RunConfig(run_name=kind, n_features=4, seeds=(42,), loss=kind, max_steps=8)
        out[kind] = jobs.run_experiment(spark, train, cfg)[0][42, 0]
    kinds = list(out)
    assert all(np.abs(out[a] - out[b]).max() > 1e-3 for i, a in enumerate(kinds) for b in kinds[i + 1:])


def test_steps_are_scored_on_their_own_fold(spark, folded):
    cfg = RunConfig(run_name="t", n_features=4, seeds=(42,), loss="smooth_l1", max_steps=3)
    steps = [c for c, _ in robust.fit_steps(folded, cfg, ridge.fit_fold_models(spark, folded, cfg))]
    got = {(r["fold"], r["step"]): r for r in robust.score_steps(folded, steps, cfg).collect()}
    assert set(got) == {(k, s) for k in range(5) for s in range(3)}
    for (k, s), r in got.items():
        Z, Y = numbers(folded, 42, k, own=True)
        R = Y - Z @ steps[s][42, k]
        rmse = np.sqrt((R * R).mean(axis=0))
        assert r["val_mcrmse"] == pytest.approx(rmse.mean()) and r[TARGETS[3]] == pytest.approx(rmse[3])
        value = np.where(np.abs(R) < 1, R * R / 2, np.abs(R) - 0.5)
        assert r["val_loss"] == pytest.approx(value.mean())


def test_run_log_has_folds_and_steps_and_upserts(spark, train, tmpdir_fresh):
    cfg = RunConfig(run_name="r1", n_features=4, seeds=(42, 43), loss="smooth_l1", max_steps=3)
    coefs, _, scores, log = jobs.run_experiment(spark, train, cfg)
    rows = log.collect()
    per = {(r["seed"], r["fold"], r["step"]) for r in rows if r["metric"] == "val_mcrmse"}
    assert per == {(s, k, n) for s in (42, 43) for k in range(5) for n in range(3)}
    assert sum(r["metric"] == "train_loss" for r in rows) == 30
    assert sum(r["metric"] == "oof_score" and r["fold"] is None for r in rows) == 2
    processed.append_metrics(log, tmpdir_fresh)
    one = log.where("seed = 43 and fold = 2 and step = 1 and metric = 'val_mcrmse'").withColumn("value", F.lit(9.0))
    processed.append_metrics(one, tmpdir_fresh)
    processed.append_metrics(one.withColumn("run", F.lit("r2")), tmpdir_fresh)
    back = processed.read_metrics(spark, tmpdir_fresh, "r1")
    assert back.count() == len(rows)
    assert back.where("value = 9.0").count() == 1 and processed.read_metrics(spark, tmpdir_fresh).count() == len(rows) + 1
    best = M.best_step(back.where("metric = 'val_mcrmse' and fold is not null").withColumnRenamed("value", "val_mcrmse"))
    assert best.count() == 10


def test_rows_without_id_stay_and_ids_are_unique(spark, train):
    rows = train.limit(20).withColumn("text_id", F.when(F.col("text_id").endswith("1"), None).otherwise(F.col("text_id")))
    lost = rows.where("text_id is null").count()
    assert lost > 0
    for seeds in ((42,), (42, 43, 44)):
        cfg = RunConfig(run_name="n", n_features=4, seeds=seeds, loss="squared")
        f = jobs._featurized_folds(spark, rows, cfg)
        assert f.count() == 20 * len(seeds) and f.where("text_id is null").count() == lost * len(seeds)
        _, oof, scores, _ = jobs.run_experiment(spark, rows, cfg)
        assert oof.count() == 20 * len(seeds) and scores.count() == len(seeds)
    twice = rows.unionByName(rows.where("text_id is not null").limit(1).withColumns({t: F.lit(1.0) for t in TARGETS}))
    with pytest.raises(ValueError, match="duplicate key"):
        jobs._featurized_folds(spark, twice, SQUARED)


def test_rows_without_id_are_spread_over_the_folds(spark):
    df = spark.range(500).select(F.lit(None).cast("string").alias("text_id"), F.col("id").alias("row"),
                                 *[F.lit(3.0).alias(t) for t in TARGETS])
    from foldwise.operators.folds import assign_folds
    a = {r["row"]: r["fold"] for r in assign_folds(df, [42]).collect()}
    b = {r["row"]: r["fold"] for r in assign_folds(df.repartition(5), [42]).collect()}
    assert a == b and sorted(np.bincount(list(a.values()))) == [100] * 5


def direct(Z, Y, lam, prior=None, weight=0.0):
    P = np.diag([0.0] + [lam] * (Z.shape[1] - 1))
    if prior is None:
        return np.linalg.solve(Z.T @ Z + P, Z.T @ Y)
    return np.linalg.solve(Z.T @ Z + P + weight * np.eye(Z.shape[1]), Z.T @ Y + weight * prior)


def gram(Z, Y):
    W = np.hstack([Z, Y])
    return W.T @ W


def test_paths_equal_refits():
    rng = np.random.default_rng(1)
    Z = np.hstack([np.ones((80, 1)), rng.normal(size=(80, 5))])
    Y, V, W = rng.normal(size=(80, 3)), np.hstack([np.ones((30, 1)), rng.normal(size=(30, 5))]), rng.normal(size=(30, 3))
    lams = (0.01, 1.0, 50.0)
    for lam, B in zip(lams, paths.ridge_path(gram(Z, Y), 3, lams)):
        assert np.allclose(B, direct(Z, Y, lam), atol=1e-9)
        assert np.allclose(paths.held_out_mse(gram(V, W), B), ((W - V @ B) ** 2).mean(axis=0))
    prior = rng.normal(size=(6, 3))
    for w, B in zip(lams, paths.prior_path(gram(Z, Y), 3, 0.7, prior, lams)):
        assert np.allclose(B, direct(Z, Y, 0.7, prior, w), atol=1e-9)
    assert np.allclose(paths.with_labels(Z.T @ Z, prior), gram(Z, Z @ prior))
    assert np.isnan(paths.held_out_score(np.zeros((9, 9)), prior)) and paths.best([np.nan, 2.0, 1.0, 1.0]) == 2
    assert paths.best([np.nan, np.nan]) == 0 and not paths.ridge_path(np.zeros((9, 9)), 3, (1.0,))[0].any()


def test_pretraining_path_equals_brute_force_refit(spark, train):
    """Every error of the path against fits on the split rows themselves."""
    cfg = RunConfig(run_name="p", n_features=4, ridge_lambda=0.5, seeds=(42, 43), loss="squared",
                    penalties=(0.1, 20.0), prior_weights=(1.0, 300.0))
    corpus = FX.corpus(spark, SF001).select("text_id", "full_text")
    labelled = train.where(F.crc32("text_id") % 3 != 0)
    got = {tuple(r)[:4]: (r["error"], r["chosen"]) for r in jobs.pretrain_path(spark, labelled, corpus, cfg).collect()}
    folded = jobs._featurized_folds(spark, labelled, cfg)
    base = ridge.featurize(jobs.pseudo_base(labelled, corpus), 4)
    for s, k in ((42, 0), (43, 3)):
        Z, Y = numbers(folded, s, k)
        teacher = direct(Z, Y, 0.5)
        split = splits.hash_split(base, s).select("split", "features").toPandas()
        X = np.stack(split.features.to_numpy()).astype(np.float64)
        X, valid = np.hstack([np.ones((len(X), 1)), X]), (split.split == "valid").to_numpy()
        assert valid.sum() == -(-len(valid) // 5)
        fits = [direct(X[~valid], X[~valid] @ teacher, lam) for lam in cfg.penalties]
        errors = [np.sqrt(((X[valid] @ (B - teacher)) ** 2).mean(axis=0)).mean() for B in fits]
        assert [got[s, k, "pretrain", w][0] for w in cfg.penalties] == pytest.approx(errors, abs=1e-7)
        prior = fits[int(np.argmin(errors))]
        V, W = numbers(folded, s, k, own=True)
        errors = [np.sqrt(((W - V @ direct(Z, Y, 0.5, prior, w)) ** 2).mean(axis=0)).mean() for w in cfg.prior_weights]
        assert [got[s, k, "finetune", w][0] for w in cfg.prior_weights] == pytest.approx(errors, abs=1e-7)
        assert [got[s, k, "finetune", w][1] for w in cfg.prior_weights] == [i == int(np.argmin(errors)) for i in range(2)]


@pytest.mark.parametrize("n", [0, 1, 4, 11, 300])
@pytest.mark.parametrize("digits,border", [(1, 1), (1, 40), (4, 10_000)])
def test_hash_split_takes_the_same_rows_as_a_sort(spark, n, digits, border):
    df = spark.range(n).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("text_id"))
    got = {r["text_id"] for r in splits.hash_split(df, 42, 0.2, digits=digits, border_rows=border).where("split = 'valid'").collect()}
    import hashlib
    order = sorted((f"x{i}" for i in range(n)), key=lambda x: hashlib.md5(f"42:split:{x}".encode()).hexdigest())
    assert got == set(order[:-(-n // 5)])


def test_hash_split_keeps_equal_ids_together_and_needs_no_shuffle_of_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [(None, 2)] * 50, "text_id string, v int")
    out = splits.hash_split(df, 7)
    assert out.groupBy("text_id", "split").count().count() == 2 and out.count() == 100
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_ensemble_is_the_mean_of_its_models_and_checked(spark, train):
    feats = ridge.featurize(train.select("text_id", "full_text"), 4)
    rng = np.random.default_rng(0)
    models = {(42, k): rng.normal(size=(5, 6)) for k in range(3)} | {(42, 3): lambda X: np.tile(X.sum(axis=1)[:, None], (1, 6))}
    got = {r["text_id"]: r for r in ridge.predict_ensemble(feats, models).collect()}
    every = ridge.predict_every_fold(spark, feats, models).groupBy("text_id").agg(F.avg("syntax").alias("syntax")).collect()
    assert all(got[r["text_id"]]["syntax"] == pytest.approx(r["syntax"]) for r in every)
    assert {r["n_models"] for r in got.values()} == {4}
    with pytest.raises(Exception, match="incomplete ensemble"):
        M.checked_ensemble(ridge.predict_ensemble(feats, models), 5).collect()
    with pytest.raises(ValueError, match="incomplete ensemble"):
        jobs.inference(spark, train, {(42, 0): models[42, 0]}, train, cfg=SQUARED, seed=42)


def test_features_are_counted_in_runs_of_bounded_size(spark, monkeypatch):
    import pyarrow as pa

    from foldwise.operators import ridge

    lists = pa.array([[0] * 5, None, [], [1, 2], [0] * 9, [3], [], [2] * 4], type=pa.list_(pa.int32()))
    runs = list(ridge.runs_of_rows(lists, 6))
    assert runs == [(0, 3), (3, 4), (4, 5), (5, 8)]
    assert list(ridge.runs_of_rows(lists.slice(3), 6)) == [(0, 1), (1, 2), (2, 5)]
    whole = ridge.bucket_counts(lists, 4)
    assert np.array_equal(np.vstack([ridge.bucket_counts(lists.slice(a, b - a), 4) for a, b in runs]), whole)
    # no call sees a whole batch of many words
    rows = [(i, f"w{i % 7} " * (i % 50)) for i in range(300)] + [(None, None)]
    df = spark.createDataFrame(rows, "id long, full_text string").coalesce(1)
    want = sorted(ridge.featurize(df, 4, row_col="row").collect(), key=lambda r: r["row"])
    seen = ridge.runs_of_rows
    monkeypatch.setattr(ridge, "runs_of_rows", lambda lists, most: seen(lists, 100))
    got = sorted(ridge.featurize(df, 4, row_col="row").collect(), key=lambda r: r["row"])
    assert got == want and len({r["row"] for r in got}) == 301
