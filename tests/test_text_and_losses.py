"""Golden values computed by hand."""

import math

import pytest
from pyspark.sql import functions as F

from foldwise.config import REG_TOKEN_PREFIX, TARGETS
from foldwise.functions import losses, text
from foldwise.operators import metrics as M


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).collect()[0]["r"]


def test_paragraph_marker_left_to_right(spark):
    assert one(spark, text.paragraph_marked(F.col("x")), "a\n\n\nb") == "a | \nb"
    assert one(spark, text.paragraph_marked(F.col("x")), "a\n\n\n\nb") == "a |  | b"
    assert one(spark, text.paragraph_marked(F.col("x")), "a\nb") == "a\nb"


def test_reg_token_prefix_keeps_blanks(spark):
    out = one(spark, text.reg_token_prefixed(F.col("x")), "Essay.")
    assert out == " cohesion syntax vocabulary phraseology grammar conventions [SEP] Essay."
    assert out.startswith(" ") and REG_TOKEN_PREFIX.endswith(" ")


@pytest.mark.parametrize("path,stem", [
    ("file:/a/b/BB.02.txt", "BB.02"), ("/x/A 0+1%.v2.txt", "A 0+1%.v2"), ("/x/plain.txt", "plain"),
    ("/x/noext", "noext")])
def test_file_stem_strips_only_last_extension(spark, path, stem):
    assert one(spark, text.file_stem(F.col("x")), path) == stem


@pytest.mark.parametrize("name,ok", [("run-1", True), ("Run-ABC-9", True), ("run_1", False), ("run-1\n", False),
                                     ("", False), ("a b", False)])
def test_run_name_full_match(spark, name, ok):
    assert one(spark, text.valid_run_name(F.col("x")), name) is ok


def test_universal_newlines(spark):
    assert one(spark, text.universal_newlines(F.col("x")), "a\r\nb\rc\n") == "a\nb\nc\n"


def _scored(spark, rows):
    cols = ", ".join([f"y_{t} double, p_{t} double" for t in TARGETS])
    data = [tuple(v for t in TARGETS for v in (y, p)) for y, p in rows]
    return spark.createDataFrame(data, cols)


def test_mcrmse_golden(spark):
    # errors 1 and 3 on every target: rmse = sqrt((1 + 9) / 2) = sqrt(5)
    sc = _scored(spark, [(1.0, 2.0), (1.0, 4.0)])
    r = M.mcrmse(sc).collect()[0]
    assert r["mcrmse"] == pytest.approx(math.sqrt(5))
    for t in TARGETS:
        assert r[t] == pytest.approx(math.sqrt(5))


def test_mcrmse_of_labels_is_zero(spark):
    sc = _scored(spark, [(2.5, 2.5), (4.0, 4.0)])
    assert M.mcrmse(sc).collect()[0]["mcrmse"] == 0.0


def test_smooth_l1_both_branches(spark):
    # |d| = 0.5 -> 0.5*0.25 = 0.125 ; |d| = 2 -> 2 - 0.5 = 1.5 ; mean over 12 elements
    sc = _scored(spark, [(1.0, 1.5), (1.0, 3.0)])
    got = M.smooth_l1_mean(sc).collect()[0]["smooth_l1"]
    assert got == pytest.approx((0.125 + 1.5) / 2)


def test_weighted_smooth_l1_quarter_square_and_jump(spark):
    beta = 1.0
    def elem(n, canonical=False):
        df = spark.createDataFrame([(float(n), 0.0)], "p double, y double")
        e = losses.weighted_smooth_l1_element(F.col("p"), F.col("y"), beta, canonical)
        return df.select(e.alias("r")).collect()[0]["r"]
    assert elem(0.5) == pytest.approx(0.0625)          # (0.5 * 0.5)^2 / 1
    assert elem(0.5, canonical=True) == pytest.approx(0.125)
    assert elem(1.0) == pytest.approx(0.5)             # n == beta takes the linear branch
    assert elem(0.999999) == pytest.approx(0.25, abs=1e-5)  # the defined form jumps at beta
    assert elem(2.0) == pytest.approx(1.5)


def test_weighted_smooth_l1_sum_uses_target_weights(spark):
    sc = _scored(spark, [(0.0, 2.0)])  # every element 1.5, weights sum to 1.0
    got = M.weighted_smooth_l1_sum(sc).collect()[0]["weighted_smooth_l1"]
    assert got == pytest.approx(1.5 * sum([0.21, 0.16, 0.10, 0.16, 0.21, 0.16]))


def test_weighted_smooth_l1_tiny_beta_is_abs(spark):
    r = spark.createDataFrame([(3.0, 1.0)], "p double, y double").select(
        losses.weighted_smooth_l1_element(F.col("p"), F.col("y"), 1e-6).alias("r")).collect()[0]["r"]
    assert r == 2.0


def test_rmse_loss_is_elementwise(spark):
    sc = _scored(spark, [(0.0, 3.0), (0.0, -4.0)])
    r = M.rmse_loss(sc).collect()[0]
    assert r["rmse_loss_mean"] == pytest.approx(3.5, rel=1e-9)
    assert r["rmse_loss_sum"] == pytest.approx(3.5 * 12, rel=1e-9)


def test_best_step_ties_go_to_earliest(spark):
    log = spark.createDataFrame([(42, 0, 10, 0.5), (42, 0, 5, 0.5), (42, 0, 7, 0.6), (42, 1, 3, 0.9)],
                                "seed int, fold int, step long, val_mcrmse double")
    got = {(r.seed, r.fold): (r.best_step, r.best_value) for r in M.best_step(log).collect()}
    assert got == {(42, 0): (5, 0.5), (42, 1): (3, 0.9)}


def test_ensemble_of_equal_models_is_the_model(spark):
    rows = [("a", k, *[1.5] * 6) for k in range(5)] + [("b", k, *[2.0 + k] * 6) for k in range(5)]
    df = spark.createDataFrame(rows, "text_id string, fold int, " + ", ".join(f"{t} double" for t in TARGETS))
    got = {r.text_id: r for r in M.fold_ensemble(df).collect()}
    assert got["a"]["cohesion"] == 1.5 and got["a"]["n_models"] == 5
    assert got["b"]["grammar"] == pytest.approx(4.0)
    M.assert_complete(M.fold_ensemble(df), 5)
    with pytest.raises(ValueError):
        M.assert_complete(M.fold_ensemble(df.where("NOT (text_id = 'a' AND fold = 3)")), 5)


def test_step_count(spark):
    df = spark.createDataFrame([(42, k % 5) for k in range(23)], "seed int, fold int")
    got = {r.fold: (r.n_train, r.n_steps) for r in M.step_counts(df).collect()}
    assert got[0] == (18, math.ceil(18 / 4) * 4)
    assert got[3] == (19, 20)


def test_loss_dispatch_by_name(spark):
    sc = _scored(spark, [(1.0, 1.5), (1.0, 3.0)])
    assert M.loss(sc, "smooth_l1").collect()[0]["smooth_l1"] == pytest.approx((0.125 + 1.5) / 2)
    assert M.loss(sc, "weighted_smooth_l1").collect()[0]["weighted_smooth_l1"] > 0
    assert M.loss(sc, "rmse_loss").collect()[0]["rmse_loss_mean"] == pytest.approx(1.25, rel=1e-6)
    with pytest.raises(ValueError):
        M.loss(sc, "mse")
