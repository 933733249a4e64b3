"""Experiment inputs derived from the provided tables (TESTDATA.md).

Every frame here is a projection/filter of a given parquet table, so work
grows with the tables. Formulas are fixed so an independent SQL engine can
rebuild the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.config import TARGETS

# --- fixed values: synthetic score formula per target ----------------------
# score_t = 1.0 + 0.5 * (((doc_id * a + n_chars * b) div c) % 9)
SCORE_COEFFICIENTS = {
    "cohesion": (7, 3, 1),
    "syntax": (11, 5, 2),
    "vocabulary": (13, 7, 3),
    "phraseology": (17, 11, 4),
    "grammar": (19, 13, 5),
    "conventions": (23, 17, 6),
}
# Prediction of fold model k: score_t + 0.1 * ((doc_id * (i_t + 2) + k * 3) % 7 - 3)
TOKEN_MASK_MODULUS = 5    # token mask: vec_id % 5 <> 0
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def score_expr(t: str) -> F.Column:
    a, b, c = SCORE_COEFFICIENTS[t]
    return F.expr(f"CAST(2 + (((doc_id * {a} + n_chars * {b}) div {c}) % 9) AS DOUBLE) / 2")


def text_id_expr() -> F.Column:
    return F.concat(F.lit("d"), F.col("doc_id").cast("string"))


def essays(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """Raw train table: text_id, doc_id, n_chars, full_text, six scores."""
    d = table(spark, sf_dir, "documents")
    cols = [text_id_expr().alias("text_id"), F.col("doc_id"), F.col("n_chars")]
    if with_text:
        cols.append(F.col("text").alias("full_text"))
    cols += [score_expr(t).alias(t) for t in TARGETS]
    return d.select(*cols)


def labelled_essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essays that have a row in ``labels`` (train set of the pseudo-label job)."""
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return essays(spark, sf_dir).join(lab, "doc_id", "left_semi")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External text corpus: every document as (text_id, doc_id, n_chars, full_text)."""
    d = table(spark, sf_dir, "documents")
    return d.select(text_id_expr().alias("text_id"), "doc_id", "n_chars", F.col("text").alias("full_text"))


def test_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw test table: text_id, doc_id, n_chars, full_text -- every document
    (inference runs over the whole table)."""
    d = table(spark, sf_dir, "documents")
    return d.select(text_id_expr().alias("text_id"), "doc_id", "n_chars", F.col("text").alias("full_text"))


def submission_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample submission: test ids with all targets 0.0."""
    return test_texts(spark, sf_dir).select("text_id", *[F.lit(0.0).alias(t) for t in TARGETS])


def fold_prediction_cols(fold_col: str = "fold") -> list:
    """Predictions of fold model ``fold_col`` for rows having doc_id and n_chars."""
    cols = []
    for i, t in enumerate(TARGETS):
        a, b, c = SCORE_COEFFICIENTS[t]
        cols.append(F.expr(
            f"round(CAST(2 + (((doc_id * {a} + n_chars * {b}) div {c}) % 9) AS DOUBLE) / 2"
            f" + CAST(0.1 AS DOUBLE) * CAST(((doc_id * {i + 2} + {fold_col} * 3) % 7) - 3 AS DOUBLE), 6)").alias(t))
    return cols


VALIDATION_STEPS = (125, 250, 375)  # validation passes of the fixture run


def pass_prediction_cols(fold_col: str = "fold", step_col: str = "step") -> list:
    """Predictions of fold model ``fold_col`` at validation pass ``step_col``."""
    cols = []
    for i, t in enumerate(TARGETS):
        a, b, c = SCORE_COEFFICIENTS[t]
        cols.append(F.expr(
            f"round(CAST(2 + (((doc_id * {a} + n_chars * {b}) div {c}) % 9) AS DOUBLE) / 2"
            f" + CAST(0.1 AS DOUBLE) * CAST(((doc_id * {i + 2} + {fold_col} * 3 + {step_col} div 125) % 7) - 3 AS DOUBLE), 6)"
        ).alias(t))
    return cols


def validation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation passes: (seed, fold, step, val_mcrmse) from ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select((F.lit(42) + F.col("user_id") % 3).cast("int").alias("seed"),
                    (F.col("event_id") % 5).cast("int").alias("fold"),
                    F.col("event_id").alias("step"),
                    F.col("value").alias("val_mcrmse"))


def token_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-embedding rows (doc, pos, mask, embedding) from ``embeddings``.

    doc = label; pos = rank of vec_id inside the doc from 0, computed with the
    distributed position helper (a doc may hold a large share of all rows).
    """
    from foldwise.operators.ranking import positions

    emb = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("doc"), "vec_id",
        (F.col("vec_id") % TOKEN_MASK_MODULUS != 0).cast("int").alias("mask"), "embedding")
    return positions(emb, ["doc"], ["vec_id"], name="pos")


def head_weights(spark: SparkSession, dim: int) -> DataFrame:
    """Linear head W[d, t] = ((d * 7 + t * 3) % 11 - 5) / 100 as (dim, target_idx, w)."""
    rows = [(d, t, ((d * 7 + t * 3) % 11 - 5) / 100.0) for d in range(dim) for t in range(len(TARGETS))]
    return spark.createDataFrame(rows, "dim INT, target_idx INT, w DOUBLE")


HEAD_BIAS = 3.0


def embedding_dim(spark: SparkSession, sf_dir: str) -> int:
    """Width of the token embeddings (one aggregate row)."""
    return int(table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0])
