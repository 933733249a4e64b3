"""Dataset variants and derived tables (projections; no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.config import SAMPLE_OOF_VALUE, TARGETS
from foldwise.functions.text import paragraph_marked, reg_token_prefixed


def sample_oof(train: DataFrame, targets: Sequence[str] = TARGETS, id_col: str = "text_id",
               value: float = SAMPLE_OOF_VALUE) -> DataFrame:
    """Id plus every target set to a constant, assigned by column name."""
    return train.select(id_col, *[F.lit(float(value)).alias(t) for t in targets])


def oof_template(folded: DataFrame, targets: Sequence[str] = TARGETS, keys: Sequence[str] = ("seed", "text_id", "fold")) -> DataFrame:
    """Keys of the folded train table with null (not NaN) targets."""
    return folded.select(*keys, *[F.lit(None).cast("double").alias(t) for t in targets])


def with_variant(df: DataFrame, data_version: str, split: str, text_col: str = "full_text") -> DataFrame:
    """Text rewrite of a dataset variant.

    ``paragraph``: blank lines become a marker in train and test.
    ``reg_token``: the target-word prefix goes before the train text only;
    test text is written untouched. ``pseudo_1`` keeps the texts as they are.
    """
    if data_version in ("vanilla", "pseudo_1"):
        return df
    if data_version == "paragraph":
        return df.withColumn(text_col, paragraph_marked(F.col(text_col)))
    if data_version == "reg_token":
        return df.withColumn(text_col, reg_token_prefixed(F.col(text_col))) if split == "train" else df
    raise ValueError(f"unknown data_version {data_version!r}")
