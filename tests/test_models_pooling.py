"""Ridge fold models vs a direct numpy solve, leakage invariants, pooling vs numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.config import TARGETS, RunConfig
from foldwise.operators import pooling, ridge
from foldwise.operators.folds import assign_folds
from foldwise.operators.models import fold_mean_models, predict_constant
from foldwise.plans import fixtures as FX
from foldwise.plans.jobs import pseudo_label_tables, run_experiment
from tests.conftest import SF001, SF01

CFG = RunConfig(run_name="t", n_features=16, ridge_lambda=0.5, seeds=(42, 43))


def _train(spark):
    return FX.essays(spark, SF001).select("text_id", "full_text", *TARGETS)


def test_ridge_equals_direct_solve(spark):
    train = _train(spark)
    folded = assign_folds(ridge.featurize(train, CFG.n_features), CFG.seeds)
    coefs = ridge.fit_fold_models(spark, folded, CFG)
    pdf = folded.select("seed", "fold", "features", *TARGETS).toPandas()
    for (s, k), B in coefs.items():
        tr = pdf[(pdf.seed == s) & (pdf.fold != k)]
        Z = np.hstack([np.ones((len(tr), 1)), np.stack(tr.features.to_numpy()).astype(np.float64)])
        Y = tr[TARGETS].to_numpy()
        P = np.eye(Z.shape[1]) * CFG.ridge_lambda
        P[0, 0] = 0
        direct = np.linalg.solve(Z.T @ Z + P, Z.T @ Y)
        assert np.allclose(B, direct, atol=1e-8)


def test_hashed_features_count_words(spark):
    df = spark.createDataFrame([("a", "a a, b!"), ("b", ""), ("c", None), ("d", "B")], "text_id string, full_text string")
    X = {r.text_id: np.array(r.features) for r in ridge.featurize(df, 8).collect()}
    assert all(len(v) == 8 for v in X.values())
    assert np.isclose(np.expm1(X["a"]).sum(), 3)
    assert X["b"].sum() == 0 and X["c"].sum() == 0
    assert np.allclose(X["d"], ridge.featurize(spark.createDataFrame([("x", "b")], "text_id string, full_text string"), 8)
                       .collect()[0].features)  # lower-cased


def _bump(folded, seed, fold, delta):
    hit = (F.col("seed") == seed) & (F.col("fold") == fold)
    return folded.withColumns({t: F.when(hit, F.col(t) + delta).otherwise(F.col(t)) for t in TARGETS})


def test_leakage_fold_labels_do_not_change_own_oof(spark):
    # folds are fixed first (they depend on labels), then fold-0 labels change
    folded = assign_folds(ridge.featurize(_train(spark), CFG.n_features), CFG.seeds).cache()
    bumped = _bump(folded, 42, 0, 1.0)
    a = ridge.predict_own_fold(folded, ridge.fit_fold_models(spark, folded, CFG)).toPandas()
    b = ridge.predict_own_fold(bumped, ridge.fit_fold_models(spark, bumped, CFG)).toPandas()
    m = a.merge(b, on=["seed", "text_id", "fold"], suffixes=("", "_b"))
    own = m[(m.seed == 42) & (m.fold == 0)]
    assert len(own) > 0 and np.allclose(own[TARGETS].to_numpy(), own[[t + "_b" for t in TARGETS]].to_numpy())
    other = m[(m.seed == 42) & (m.fold != 0)]
    assert not np.allclose(other[TARGETS].to_numpy(), other[[t + "_b" for t in TARGETS]].to_numpy())
    seed43 = m[m.seed == 43]
    assert np.allclose(seed43[TARGETS].to_numpy(), seed43[[t + "_b" for t in TARGETS]].to_numpy())


def test_experiment_run_outputs(spark):
    _, oof, scores, log = run_experiment(spark, _train(spark), CFG)
    pdf = oof.toPandas()
    assert not pdf.duplicated(["seed", "text_id"]).any()
    assert len(pdf) == 2 * _train(spark).count() and pdf[TARGETS].notna().all().all()
    assert scores.count() == 2 and log.where("fold is null").count() == 2 * 7 + 7
    assert "grammar" in {r.metric for r in log.collect()}


def test_pseudo_labels_of_fold_k_ignore_fold_k_labels(spark):
    train = FX.labelled_essays(spark, SF01).select("text_id", "full_text", *TARGETS)
    folded = assign_folds(train, [42]).cache()
    a = {r.fold: r for r in fold_mean_models(spark, folded, seeds=[42]).collect()}
    b = {r.fold: r for r in fold_mean_models(spark, _bump(folded, 42, 2, 2.0), seeds=[42]).collect()}
    assert a[2] == b[2] and a[0] != b[0]
    corpus = FX.corpus(spark, SF01).select("text_id", "full_text")
    p = pseudo_label_tables(spark, train, corpus, model="fold_mean", seeds=[42]).toPandas()
    assert set(p.text_id).isdisjoint(r.text_id for r in train.select("text_id").collect())
    assert len(p) == 5 * (corpus.count() - train.count())


def test_fold_mean_model_is_mean_of_other_folds(spark):
    folded = assign_folds(FX.essays(spark, SF001, with_text=False), [42])
    models = {(r.seed, r.fold): r for r in fold_mean_models(spark, folded, seeds=[42]).collect()}
    pdf = folded.toPandas()
    for k in range(5):
        assert models[(42, k)]["cohesion"] == pytest.approx(pdf[pdf.fold != k].cohesion.mean())
    rows = predict_constant(folded.select("seed", "fold", "text_id"), fold_mean_models(spark, folded, seeds=[42]))
    assert rows.count() == len(pdf)


def _tokens(spark):
    return FX.token_embeddings(spark, SF01)


def test_pooling_matches_numpy(spark):
    tk = _tokens(spark).toPandas()
    mean = pooling.to_vectors(pooling.mean_pool(_tokens(spark))).toPandas().set_index("doc")
    gem = pooling.to_vectors(pooling.gem_cls_pool(_tokens(spark))).toPandas().set_index("doc")
    for doc, g in tk.groupby("doc"):
        g = g.sort_values("pos")
        E = np.stack(g.embedding.to_numpy()).astype(np.float64)
        m = g["mask"].to_numpy().astype(np.float64)[:, None]
        exp_mean = (E * m).sum(0) / max(m.sum(), 1e-9)
        assert np.allclose(mean.loc[doc].vector, exp_mean)
        m2 = m.copy(); m2[0] = 0
        exp_gem = ((np.clip(E, 1e-6, None) * m2) ** 3).sum(0) / max(m2.sum(), 1e-6)
        exp = np.concatenate([E[0], exp_gem ** (1 / 3)])
        assert np.allclose(gem.loc[doc].vector, exp)


def test_pool_dispatch_and_slot_heads(spark):
    sl = pooling.pool(_tokens(spark), "reg_token")
    assert sorted({r.slot for r in sl.select("slot").distinct().collect()}) == list(range(6))
    w = FX.head_weights(spark, 64)
    out = pooling.slot_heads(sl, w, 3.0).toPandas()
    assert len(out) == 10 and list(out.columns) == ["doc", *TARGETS]
    with pytest.raises(ValueError):
        pooling.pool(_tokens(spark), "max")


def test_config_coupling_and_debug():
    with pytest.raises(ValueError):
        RunConfig(data_version="reg_token", pooling="mean")
    with pytest.raises(ValueError):
        RunConfig(data_version="vanilla", pooling="reg_token")
    RunConfig(data_version="reg_token", pooling="reg_token")
    d = RunConfig(debug=True)
    assert d.train_folds == (0, 1) and d.val_check_interval == 300 // 8
    assert RunConfig(batch_size=1).val_check_interval == 500
    assert RunConfig().as_params()["seeds"] == "42,43,44"


def test_params_log_records_every_setting():
    from foldwise.plans.jobs import params_log
    rows = params_log(RunConfig(run_name="r1", model_name="large", loss="weighted_smooth_l1"))
    d = {k: v for _, k, v in rows}
    assert all(r[0] == "r1" for r in rows)
    assert d["model_name"] == "large" and d["loss"] == "weighted_smooth_l1" and d["smooth_l1_weights"].startswith("0.21")
    assert d["val_check_interval"] == "125" and len(rows) >= 20


def test_debug_run_uses_reduced_rows_and_trained_folds_only(spark):
    cfg = RunConfig(run_name="dbg", n_features=16, seeds=(42,), debug=True, debug_rows=40)
    coefs, oof, scores, _ = run_experiment(spark, _train(spark), cfg)
    pdf = oof.toPandas()
    assert set(pdf.fold) == {0, 1} and len(pdf) == 2 * 40
    assert set(coefs) == {(42, k) for k in range(5)}  # every fold model exists; folds 2-4 train them
    assert scores.count() == 1


def test_pluggable_fold_model_callable(spark):
    feats = ridge.featurize(_train(spark).select("text_id", "full_text"), 8)
    models = {(42, k): (lambda X, k=k: np.tile(X.sum(axis=1, keepdims=True) * 0 + k, (1, 6))) for k in range(5)}
    out = ridge.predict_every_fold(spark, feats, models).toPandas()
    assert len(out) == 5 * feats.count()
    assert (out.cohesion == out.fold).all()


def test_prior_pulls_coefficients_towards_it(spark):
    folded = assign_folds(ridge.featurize(_train(spark).select("text_id", "full_text", *TARGETS), CFG.n_features), CFG.seeds)
    grams = ridge.fold_grams(folded, CFG)
    plain = ridge.fit_fold_models(spark, folded, CFG, grams=grams)
    prior = {k: np.zeros_like(v) for k, v in plain.items()}
    strong = RunConfig(run_name="t", n_features=16, ridge_lambda=0.5, seeds=(42, 43), prior_lambda=1e6)
    pulled = ridge.fit_fold_models(spark, folded, strong, prior, grams=grams)
    k = (42, 0)
    assert np.abs(pulled[k]).sum() < 1e-2 * np.abs(plain[k]).sum()


def test_every_fold_model_exists_even_without_rows(spark):
    folded = assign_folds(ridge.featurize(_train(spark).select("text_id", "full_text", *TARGETS), CFG.n_features), CFG.seeds)
    coefs = ridge.fit_fold_models(spark, folded.where("fold <> 3"), CFG)
    assert set(coefs) == {(s, k) for s in CFG.seeds for k in range(5)}


def test_pooling_awkward_rows(spark):
    """Null masks and vectors, a document without position 0, one of one token."""
    rows = [("a", 0, 1, [1.0, 2.0]), ("a", 1, None, [9.0, 9.0]), ("a", 2, 1, [3.0, 4.0]), ("a", 3, 1, None),
            ("b", 1, 1, [2.0, 2.0]), ("c", 0, 1, [5.0, 6.0]), (None, 0, 0, [7.0, 7.0])]
    df = spark.createDataFrame(rows, "doc string, pos int, mask int, embedding array<float>").repartition(3)
    mean = {r["doc"]: r["vector"] for r in pooling.mean_vectors(df).collect()}
    assert mean == {"a": [2.0, 3.0], "b": [2.0, 2.0], "c": [5.0, 6.0], None: [0.0, 0.0]}
    gem = {}
    for r in pooling.gem_cls_pool(df).collect():
        gem.setdefault(r["doc"], {})[r["dim"]] = round(r["value"], 6)
    assert gem["a"] == {0: 1.0, 1: 2.0, 2: 3.0, 3: 4.0} and gem["b"] == {2: 2.0, 3: 2.0}
    assert gem["c"] == {0: 5.0, 1: 6.0, 2: 0.0, 3: 0.0}
    assert pooling.mean_pool(df.limit(0)).count() == 0


def test_pooling_shuffles_one_row_per_document_and_batch(spark):
    from foldwise.session import materialize
    tk = materialize(_tokens(spark))
    for out in (pooling.mean_pool(tk), pooling.linear_head(pooling.mean_vectors(tk), FX.head_weights(spark, 64), 3.0),
                pooling.slot_heads(pooling.slot_vectors(tk), FX.head_weights(spark, 64), 3.0)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        keyed = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        assert all("dim" not in line and "slot" not in line for line in keyed)
        assert len(keyed) == 1 and "hashpartitioning(doc" in keyed[0]
