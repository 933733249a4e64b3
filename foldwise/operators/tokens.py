"""Whitespace tokenization with special tokens, truncation, padding and masks,
and per-batch trimming to the longest real sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.config import CLS_TOKEN, PAD_TOKEN, SEP_TOKEN

TOKEN_SPLIT = "[ \n\t]+"


def words(text: Column) -> Column:
    """Non-empty pieces between runs of space, newline and tab."""
    return F.filter(F.split(text, TOKEN_SPLIT), lambda w: w != F.lit(""))


def encode(text: Column, max_len: int, pad: bool = True, cut: bool | None = None) -> tuple[Column, Column]:
    """(tokens, mask): [CLS] + words + [SEP].

    Padded mode cuts at ``max_len`` and pads to it. ``pad=False`` (batch size
    1) neither pads nor cuts; dynamic padding asks for ``cut`` on its own.
    """
    body = words(text)
    if pad if cut is None else cut:
        body = F.slice(body, 1, max_len - 2)
    seq = F.concat(F.array(F.lit(CLS_TOKEN)), body, F.array(F.lit(SEP_TOKEN)))
    n_real = F.size(seq)
    if not pad:
        return seq, F.array_repeat(F.lit(1), n_real)
    n_pad = F.lit(max_len) - n_real
    tokens = F.concat(seq, F.array_repeat(F.lit(PAD_TOKEN), n_pad))
    mask = F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), n_pad))
    return tokens, mask


def tokenize(df: DataFrame, max_len: int, text_col: str = "full_text", pad: bool = True,
             cut: bool | None = None) -> DataFrame:
    """Add ``tokens`` and ``mask`` arrays (see ``encode``)."""
    tokens, mask = encode(F.col(text_col), max_len, pad, cut)
    return df.withColumn("tokens", tokens).withColumn("mask", mask)


def mask_length(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda acc, m: acc + m)


def trim_batches(df: DataFrame, batch_cols=("batch_id",)) -> DataFrame:
    """Cut tokens and mask of every row to its batch's longest real length.

    Batches are small fixed-size groups, so the window per batch is bounded.
    """
    w = Window.partitionBy(*batch_cols)
    trim = F.max(mask_length(F.col("mask"))).over(w)
    return (df.withColumn("trim_len", trim)
              .withColumn("tokens", F.slice("tokens", 1, F.col("trim_len")))
              .withColumn("mask", F.slice("mask", 1, F.col("trim_len"))))


def pad_to_batch_longest(df: DataFrame, batch_cols=("batch_id",)) -> DataFrame:
    """Dynamic padding: unpadded sequences (``tokenize(pad=False, cut=True)``) padded to
    the longest real length of their batch. Equal to padding every row to
    max_len and then trimming the batch, without building max_len arrays."""
    w = Window.partitionBy(*batch_cols)
    n_real = F.size("tokens")
    out = df.withColumn("trim_len", F.max(n_real).over(w))
    n_pad = F.col("trim_len") - n_real
    return (out.withColumn("mask", F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), n_pad)))
               .withColumn("tokens", F.concat(F.col("tokens"), F.array_repeat(F.lit(PAD_TOKEN), n_pad))))
