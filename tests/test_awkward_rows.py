"""Rows that must neither be lost nor change a number: null ids and labels,
duplicate ids, one-token documents, missing predictions."""

from __future__ import annotations

import pytest

from foldwise.config import TARGETS
from foldwise.operators import metrics as M
from foldwise.operators.folds import MAX_LABEL_VALUES, assign_folds, label_domain
from foldwise.operators.joins import anti_join_null_safe
from foldwise.operators.models import fold_mean_models
from foldwise.operators.pooling import gem_cls_pool
from foldwise.operators.tokens import tokenize


def _essays(spark, rows):
    fields = ", ".join(f"{t} double" for t in TARGETS)
    return spark.createDataFrame([(i, f"text {i}", *[y] * 6) for i, y in rows], f"text_id string, full_text string, {fields}")


def test_fold_mean_counts_labels_that_are_there(spark):
    rows = [(42, 0, "a", 1.0), (42, 0, "b", 3.0), (42, 1, "c", None), (42, 1, "d", 4.0)]
    folded = spark.createDataFrame([(s, k, i, *[y] * 6) for s, k, i, y in rows],
                                   "seed int, fold int, text_id string, " + ", ".join(f"{t} double" for t in TARGETS))
    got = {r["fold"]: r for r in fold_mean_models(spark, folded, [42], 2).collect()}
    assert got[0]["cohesion"] == 4.0 and got[1]["cohesion"] == 2.0
    assert got[0]["n_train"] == 2


def test_folds_keep_null_ids_for_every_number_of_seeds(spark):
    df = _essays(spark, [(None, 1.0)] + [(f"t{i}", float(i % 5)) for i in range(20)])
    narrow = df.drop("full_text")
    for frame in (df, narrow):
        assert assign_folds(frame, [42]).count() == 21
        assert assign_folds(frame, [42, 43, 44]).count() == 63
    wide = {(r["seed"], r["text_id"]): r["fold"] for r in assign_folds(df, [42, 43]).collect()}
    assert wide == {(r["seed"], r["text_id"]): r["fold"] for r in assign_folds(narrow, [42, 43]).collect()}


def test_folds_fail_on_a_duplicate_id(spark):
    df = _essays(spark, [("x", 1.0), ("x", 1.0), ("y", 2.0)])
    for seeds in ([42], [42, 43]):
        with pytest.raises(Exception, match="duplicate text_id"):
            assign_folds(df, seeds).collect()


def test_one_hot_domain_is_bounded(spark):
    df = _essays(spark, [(f"t{i}", float(i)) for i in range(MAX_LABEL_VALUES // 6 + 2)])
    with pytest.raises(ValueError, match="distinct values"):
        label_domain(df)


def test_gem_of_a_one_token_document_is_zero(spark):
    rows = [("one", 0, 1, [0.5, -1.0]), ("two", 0, 1, [1.0, 2.0]), ("two", 1, 1, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "doc string, pos int, mask int, embedding array<float>")
    got = {(r["doc"], r["dim"]): r["value"] for r in gem_cls_pool(df).collect()}
    assert {k: v for k, v in got.items() if k[0] == "one"} == {("one", 0): 0.5, ("one", 1): -1.0, ("one", 2): 0.0, ("one", 3): 0.0}
    assert got["two", 2] == pytest.approx(3.0) and got["two", 3] == pytest.approx(4.0)


def test_unpadded_tokens_are_not_cut(spark):
    df = spark.createDataFrame([("a", " ".join(["w"] * 3000))], "text_id string, full_text string")
    assert len(tokenize(df, 2048, pad=False).first()["tokens"]) == 3002
    assert len(tokenize(df, 2048).first()["tokens"]) == 2048


def test_a_score_without_predictions_fails(spark):
    labels = _essays(spark, [("a", 1.0), ("b", 2.0), ("c", None)]).drop("full_text")
    preds = labels.where("text_id <> 'b'").fillna(1.0)
    with pytest.raises(Exception, match="have no prediction"):
        M.mcrmse(M.align(labels, preds, ["text_id"])).collect()
    assert M.mcrmse(M.align(labels.where("text_id <> 'b'"), preds, ["text_id"])).first()["mcrmse"] == 0.0


def test_anti_join_keeps_null_keys_unless_the_right_has_one(spark):
    left = spark.createDataFrame([(None, i) for i in range(200)] + [("a", 1), ("b", 2)], "k string, v int")
    right = spark.createDataFrame([("a",)], "k string")
    assert anti_join_null_safe(left, right, "k").count() == 201
    right = right.union(spark.createDataFrame([(None,)], "k string"))
    assert [r["k"] for r in anti_join_null_safe(left, right, "k").collect()] == ["b"]


def test_priors_from_one_gram_equal_fits_on_labelled_copies(spark):
    import numpy as np

    from foldwise.config import RunConfig
    from foldwise.operators import ridge
    rng = np.random.default_rng(0)
    cfg = RunConfig(n_features=3)
    coefs = {(s, k): rng.normal(size=(4, 6)) for s in (42, 43) for k in (0, 1)}
    base = spark.createDataFrame([(f"t{i}", [float(v) for v in rng.normal(size=3)]) for i in range(40)],
                                 "text_id string, features array<float>").repartition(3)
    copies = ridge.predict_every_fold(spark, base, coefs, cfg).join(base, "text_id")
    direct, one = ridge.fit_direct(copies, cfg), ridge.fit_predicted(base, coefs, cfg)
    assert set(direct) == set(one)
    for k in direct:
        assert np.allclose(direct[k], one[k], atol=1e-8)


@pytest.mark.parametrize("version", ["vanilla", "paragraph", "reg_token", "pseudo_1"])
def test_bundles_read_back_by_version_and_seed(spark, tmpdir_fresh, version):
    from foldwise.plans.jobs import build_dataset_bundle
    from foldwise.sources import processed as P
    train = _essays(spark, [(f"t{i}", float(i % 5)) for i in range(25)])
    test, template = train.select("text_id", "full_text").limit(4), train.drop("full_text").limit(4)
    build_dataset_bundle(train, test, template, tmpdir_fresh, version, seeds=(42, 43))
    for seed in (42, 43):
        assert P.train(spark, tmpdir_fresh, version, seed).count() == 25
        assert {r["text_id"] for r in P.test(spark, tmpdir_fresh, version, seed).collect()} == {
            r["text_id"] for r in test.collect()}
        assert P.sample_submission(spark, tmpdir_fresh, version, seed).count() == 4
        assert {r["seed"] for r in P.sample_oof(spark, tmpdir_fresh, version, seed).collect()} == {seed}
