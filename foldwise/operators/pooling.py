"""Pooling of token embeddings into document vectors, and linear heads.

Token embeddings are rows ``(doc, pos, mask, embedding ARRAY<FLOAT>)``, all of
one width. Sums are vector-valued: every Arrow batch adds up the vectors of
each of its documents (rows ordered by document, one ``reduceat``), so the
shuffle gets one row per (document, batch) and a document of any share of all
rows is reduced in every task first. Heads are literal weight arrays; nothing
is joined or grouped by dimension or slot. Vectors come as
``(doc, vector ARRAY<DOUBLE>)``; ``mean_pool`` and ``gem_cls_pool`` give them
as long ``(doc, dim, value)`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.config import TARGETS


def _lists(X: np.ndarray, held: np.ndarray | None = None) -> pa.ListArray:
    """Rows as lists; rows that are not ``held`` as null."""
    n, d = X.shape
    edges = pa.array(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32) if d else np.zeros(n + 1, dtype=np.int32))
    return pa.ListArray.from_arrays(edges, pa.array(X.ravel()), mask=None if held is None else pa.array(~held))


def _vector_sums(tokens: DataFrame, doc_col: str, term, skip_first: bool) -> DataFrame:
    """(doc, m, sums, first): per document the mask's sum, the masked sum of
    ``term(vector)``, and the vector at position 0. With ``skip_first`` that
    position is in no sum. A null mask counts as 0, a row without a vector not
    at all."""
    rows = tokens.where(F.col("embedding").isNotNull()).select(
        F.col(doc_col).alias("doc"), F.col("pos").cast("long").alias("pos"),
        F.coalesce(F.col("mask").cast("double"), F.lit(0.0)).alias("mask"), F.col("embedding").cast("array<double>"))
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([rows.schema["doc"], T.StructField("m", T.DoubleType()), T.StructField("sums", vector),
                           T.StructField("first", vector)])

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            lists = rb.column(3)
            X = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            names = rb.column(0).dictionary_encode(null_encoding="encode")
            code = names.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            code, X = code[order], X[order]
            pos, mask = rb.column(1).to_numpy()[order], rb.column(2).to_numpy()[order]
            if skip_first:
                mask = np.where(pos == 0, 0.0, mask)
            begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            first, has = np.zeros((len(begin), X.shape[1])), np.zeros(len(begin), dtype=bool)
            at = np.flatnonzero(pos == 0)
            owner = np.searchsorted(begin, at, side="right") - 1
            first[owner], has[owner] = X[at], True
            yield pa.RecordBatch.from_arrays(
                [names.dictionary.take(pa.array(code[begin])), pa.array(np.add.reduceat(mask, begin)),
                 _lists(np.add.reduceat(term(X) * mask[:, None], begin)), _lists(first, has)], names=schema.names)

    def plus(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).otherwise(F.zip_with(a, b, lambda x, y: x + y))

    parts = rows.mapInArrow(run, schema).groupBy("doc").agg(
        F.sum("m").alias("m"), F.collect_list("sums").alias("all"), F.max("first").alias("first"))
    nothing = F.lit(None).cast("array<double>")
    return parts.select(F.col("doc").alias(doc_col), "m", F.aggregate("all", nothing, plus).alias("sums"), "first")


def mean_vectors(tokens: DataFrame, doc_col: str = "doc", eps: float = 1e-9) -> DataFrame:
    """sum(v * m) / max(sum(m), eps) per document."""
    sums = _vector_sums(tokens, doc_col, lambda X: X, skip_first=False)
    total = F.greatest(F.col("m"), F.lit(eps))
    return sums.select(doc_col, F.transform("sums", lambda v: v / total).alias("vector"))


def _gem_parts(tokens: DataFrame, doc_col: str, p: float, eps: float) -> DataFrame:
    sums = _vector_sums(tokens, doc_col, lambda X: np.maximum(X, eps) ** p, skip_first=True)
    total = F.greatest(F.col("m"), F.lit(eps))
    return sums.select(doc_col, "first", F.transform("sums", lambda v: F.pow(v / total, F.lit(1.0 / p))).alias("gem"))


def gem_cls_vectors(tokens: DataFrame, doc_col: str = "doc", p: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """[vector at position 0] ++ GeM over the other positions; null for a
    document without a position 0."""
    return _gem_parts(tokens, doc_col, p, eps).select(doc_col, F.concat("first", "gem").alias("vector"))


def mean_pool(tokens: DataFrame, doc_col: str = "doc", eps: float = 1e-9) -> DataFrame:
    """``mean_vectors`` as (doc, dim, value) rows."""
    return to_long(mean_vectors(tokens, doc_col, eps), doc_col)


def gem_cls_pool(tokens: DataFrame, doc_col: str = "doc", p: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """[vector at position 0] ++ GeM over positions >= 1 with mask, as
    (doc, dim, value) rows.

    GeM_d = (sum(max(v, eps)^p * m) / max(sum(m), eps))^(1/p); position 0 is
    left out of GeM (its mask counts as 0), so a document of one token has a
    GeM part of zeros. Dims 0..D-1 are the first vector (absent if there is
    none), D..2D-1 the GeM part; both come from one scan and one aggregation.
    """
    both = _gem_parts(tokens, doc_col, p, eps)
    halves = F.array(F.struct(F.lit(0).alias("at"), F.col("first").alias("vector")),
                     F.struct(F.size("gem").alias("at"), F.col("gem").alias("vector")))
    x = both.select(doc_col, F.explode(halves).alias("h")).select(doc_col, "h.at", F.posexplode("h.vector").alias("i", "value"))
    return x.select(doc_col, (F.col("at") + F.col("i")).alias("dim"), "value")


def slot_vectors(tokens: DataFrame, doc_col: str = "doc", first: int = 1, n: int = len(TARGETS)) -> DataFrame:
    """(doc, slot, vector): the vectors at positions first..first+n-1."""
    at = tokens.where(F.col("pos").between(first, first + n - 1))
    return at.select(doc_col, (F.col("pos") - F.lit(first)).cast("int").alias("slot"),
                     F.col("embedding").cast("array<double>").alias("vector"))


def position_slice(tokens: DataFrame, doc_col: str = "doc", first: int = 1, n: int = len(TARGETS)) -> DataFrame:
    """``slot_vectors`` as (doc, slot, dim, value) rows."""
    return slot_vectors(tokens, doc_col, first, n).select(doc_col, "slot", F.posexplode("vector").alias("dim", "value"))


POOLINGS = {"mean": mean_pool, "gem_cls": gem_cls_pool, "reg_token": position_slice}


def pool(tokens: DataFrame, kind: str, doc_col: str = "doc", **params) -> DataFrame:
    """Pooling by name: ``mean``, ``gem_cls`` or ``reg_token``."""
    if kind not in POOLINGS:
        raise ValueError(f"unknown pooling {kind!r}")
    return POOLINGS[kind](tokens, doc_col, **params)


def to_long(vectors: DataFrame, doc_col: str = "doc") -> DataFrame:
    """(doc, vector) -> (doc, dim, value) rows."""
    return vectors.select(doc_col, F.posexplode("vector").alias("dim", "value"))


def to_vectors(pooled: DataFrame, doc_col: str = "doc", keys: Sequence[str] = ()) -> DataFrame:
    """(doc, dim, value) rows -> (doc, vector ARRAY<DOUBLE>) ordered by dim."""
    return (pooled.groupBy(doc_col, *keys)
                  .agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("_s"))
                  .select(doc_col, *keys, F.col("_s.value").alias("vector")))


def weight_columns(weights: DataFrame, n_targets: int) -> list[Column]:
    """One literal array per target from (dim, target_idx, w): a model's
    weights, so dim x targets rows come to the driver."""
    rows = weights.select("dim", "target_idx", "w").collect()
    W = np.zeros((max((r["dim"] for r in rows), default=-1) + 1, n_targets))
    for r in rows:
        W[r["dim"], r["target_idx"]] = r["w"]
    return [F.lit(W[:, t].tolist()) for t in range(n_targets)]


def _dot(vector: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(vector, weights, lambda v, w: F.coalesce(v * w, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)


def _biases(bias, n: int) -> list[float]:
    return list(map(float, bias)) if isinstance(bias, (list, tuple)) else [float(bias)] * n


def linear_head(pooled: DataFrame, weights: DataFrame, bias, doc_col: str = "doc",
                targets=TARGETS) -> DataFrame:
    """features . W + b -> one column per target, for vectors or long rows.
    ``weights`` is (dim, target_idx, w)."""
    vectors = pooled if "vector" in pooled.columns else to_vectors(pooled, doc_col)
    W, b = weight_columns(weights, len(targets)), _biases(bias, len(targets))
    return vectors.select(doc_col, *[(_dot(F.col("vector"), W[i]) + F.lit(b[i])).alias(t) for i, t in enumerate(targets)])


def slot_heads(sliced: DataFrame, weights: DataFrame, bias, doc_col: str = "doc", targets=TARGETS) -> DataFrame:
    """Position-slice variant: slot t goes through its own 1-output head t
    (null for a target whose slot a document lacks)."""
    vectors = sliced if "vector" in sliced.columns else to_vectors(sliced, doc_col, ["slot"])
    W, b = weight_columns(weights, len(targets)), _biases(bias, len(targets))
    own = [F.when(F.col("slot") == i, _dot(F.col("vector"), W[i]) + F.lit(b[i])).alias(t) for i, t in enumerate(targets)]
    return vectors.select(doc_col, *own).groupBy(doc_col).agg(*[F.max(t).alias(t) for t in targets])
