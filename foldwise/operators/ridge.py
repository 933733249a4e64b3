"""Per-(seed, fold) ridge models fitted from sufficient statistics.

Features are hashed log term frequencies of the text (``featurize``: words
split and hashed in the JVM, counted per run of rows with one ``bincount``;
no shuffle). Fitting needs one scan:
every task folds its rows into augmented Gram matrices ``[1 X Y]^T [1 X Y]``
per (seed, fold) and emits their upper triangles packed in 1,024-value chunks;
a ``groupBy`` on (seed, fold, chunk, place) sums them with partial aggregation.
Train statistics of fold k are the
seed total minus fold k, so all (seed, fold) models come from the same
aggregate. Only (d+7)^2 numbers per (seed, fold) reach the driver, where the
small systems are solved; coefficients go back to the tasks with the
prediction function (size fixed by d, seeds and folds, not by the data).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.config import TARGETS, RunConfig

# Words: maximal runs of Unicode letters, digits and underscore, lower-cased.
WORD_SPLIT = r"[^\p{L}\p{N}_]+"
HASH_SEED = 42


def word_buckets(text, n_features: int):
    """ARRAY<INT> of hashed word buckets, computed in the JVM (split + xxhash64)."""
    words = F.filter(F.split(F.lower(text), WORD_SPLIT), lambda w: w != F.lit(""))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n_features)).cast("int"))


def bucket_counts(lists: pa.ListArray, n_features: int) -> np.ndarray:
    """n x d log(1 + count) matrix from an Arrow list of bucket ids (nulls = no words)."""
    n = len(lists)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    cells = np.repeat(np.arange(0, n * n_features, n_features, dtype=np.int64), lengths)
    cells += values
    counts = np.bincount(cells, minlength=n * n_features)
    return np.log1p(counts.reshape(n, n_features))


#: words that ``featurize`` counts at a time: memory does not grow with a batch
WORDS_AT_ONCE = 1 << 18


def runs_of_rows(lists: pa.ListArray, most: int):
    """(begin, end) of successive rows that hold ``most`` values together, or
    of one row that holds more."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, before = 0, 0
    while begin < len(lists):
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, end
        begin, before = end, int(ends[end - 1])


def fixed_lists(X: np.ndarray, dtype=np.float32) -> pa.ListArray:
    n, d = X.shape
    offsets = pa.array(np.arange(0, n * d + 1, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(X.astype(dtype).ravel()))


def matrix(rb: pa.RecordBatch, name: str) -> np.ndarray:
    col = rb.column(rb.schema.get_field_index(name))
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def featurize(df: DataFrame, n_features: int, text_col: str = "full_text", out_col: str = "features",
              row_col: str | None = None) -> DataFrame:
    """Replace the text column by ``features ARRAY<FLOAT>``: hashed log term
    frequencies. Words are split and hashed in the JVM; Python only counts
    bucket ids of runs of rows, each with one ``bincount``. ``row_col`` adds a
    number that is unique among the rows; write the table before reading it
    twice."""
    x = df.withColumn("_bk", word_buckets(F.col(text_col), n_features)).drop(text_col)
    keep = [f for f in x.schema.fields if f.name != "_bk"]
    extra = [T.StructField(row_col, T.LongType())] if row_col else []
    schema = T.StructType(keep + [T.StructField(out_col, T.ArrayType(T.FloatType(), True))] + extra)
    names = [f.name for f in keep]

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            at = whole.schema.get_field_index("_bk")
            for begin, end in runs_of_rows(whole.column(at), WORDS_AT_ONCE):
                rb = whole.slice(begin, end - begin)
                X = bucket_counts(rb.column(at), n_features)
                cols = [rb.column(rb.schema.get_field_index(n)) for n in names] + [fixed_lists(X)]
                if row_col:
                    cols.append(pa.array(np.arange(row, row + rb.num_rows)))
                    row += rb.num_rows
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return x.mapInArrow(run, schema)


def design(X: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((X.shape[0], 1)), X])


CHUNK = 1024  # doubles per packed partial row


def gram_partials(df: DataFrame, targets: Sequence[str] = TARGETS, key_cols: Sequence[str] = ("seed", "fold"),
                  feat_col: str = "features") -> DataFrame:
    """Packed partial sums: rows (keys..., chunk, vals ARRAY<DOUBLE>[CHUNK]) holding
    the upper triangle of each task's Gram matrix per key, emitted once at the
    end of the task."""
    targets, key_cols = list(targets), list(key_cols)
    fields = [df.schema[k] for k in key_cols]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [
        T.StructField("chunk", T.IntegerType()), T.StructField("vals", T.ArrayType(T.DoubleType(), False))])
    any_null = None
    for t in targets:
        any_null = F.col(t).isNull() if any_null is None else (any_null | F.col(t).isNull())
    labelled = df.where(~any_null) if targets else df
    labelled = labelled.select(*key_cols, feat_col, *targets)

    def run(batches):
        acc: dict = {}
        for rb in batches:
            if not rb.num_rows:
                continue
            pdf = rb.select(key_cols).to_pandas()
            Y = [rb.column(rb.schema.get_field_index(t)).to_numpy(zero_copy_only=False).astype(np.float64) for t in targets]
            Z = np.column_stack([design(matrix(rb, feat_col)), *Y])
            for key, idx in pdf.groupby(key_cols, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                Zi = Z[idx]
                g = Zi.T @ Zi
                acc[key] = acc[key] + g if key in acc else g
        for key, g in acc.items():
            upper = g[np.triu_indices(g.shape[0])]
            n_chunks = -(-len(upper) // CHUNK)
            padded = np.zeros(n_chunks * CHUNK)
            padded[:len(upper)] = upper
            cols = [pa.array(np.full(n_chunks, val), type=pa.int32() if isinstance(val, (int, np.integer)) else None)
                    for val in key]
            cols += [pa.array(np.arange(n_chunks, dtype=np.int32)), fixed_lists(padded.reshape(n_chunks, CHUNK), np.float64)]
            yield pa.RecordBatch.from_arrays(cols, names=[*key_cols, "chunk", "vals"])

    return labelled.mapInArrow(run, schema)


def gram_tables(df: DataFrame, targets: Sequence[str] = TARGETS, key_cols: Sequence[str] = ("seed", "fold")) -> DataFrame:
    """Summed packed Gram chunks per key. Numbers are summed place by place
    (each task adds up its own before the shuffle), then the places of a chunk
    are put together: no buffer grows with the number of tasks."""
    return sum_partials(gram_partials(df, targets, key_cols), key_cols)


def sum_partials(partials: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Sums of packed (keys..., chunk, vals) rows, place by place."""
    long = partials.select(*key_cols, "chunk", F.posexplode("vals").alias("at", "v"))
    sums = long.groupBy(*key_cols, "chunk", "at").agg(F.sum("v").alias("v"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"])
    return sums.groupBy(*key_cols, "chunk").agg(packed.alias("vals"))


def collect_grams(grams: DataFrame, m: int, key_cols: Sequence[str] = ("seed", "fold")) -> dict:
    """Driver-side dense m x m matrices keyed by (seed, fold) -- bounded by d, not rows."""
    pdf = grams.toPandas()
    iu = np.triu_indices(m)
    out = {}
    for key, g in pdf.groupby(list(key_cols)):
        key = key if isinstance(key, tuple) else (key,)
        upper = np.concatenate([np.asarray(v, dtype=np.float64) for v in g.sort_values("chunk")["vals"]])
        G = np.zeros((m, m))
        G[iu] = upper[:len(iu[0])]
        out[tuple(int(k) for k in key)] = G + np.triu(G, 1).T
    return out


def solve(G: np.ndarray, n_targets: int, lam: float, prior: np.ndarray | None = None, prior_lam: float = 0.0) -> np.ndarray:
    """argmin ||Y - ZB||^2 + lam ||B_x||^2 + prior_lam ||B - prior||^2 (intercept unpenalised by lam)."""
    d1 = G.shape[0] - n_targets
    A = G[:d1, :d1].copy()
    b = G[:d1, d1:].copy()
    P = np.eye(d1) * lam
    P[0, 0] = 0.0
    A += P
    if prior is not None and prior_lam > 0:
        A += np.eye(d1) * prior_lam
        b += prior_lam * prior
    return np.linalg.solve(A + np.eye(d1) * 1e-12, b)


def fit_from_grams(grams: dict, n_targets: int, lam: float, priors: dict | None = None,
                   prior_lam: float = 0.0) -> dict:
    """Model of (seed, fold k) from train stats = seed total - fold k."""
    totals: dict = {}
    for (s, k), G in grams.items():
        totals[s] = totals[s] + G if s in totals else G.copy()
    coefs = {}
    for (s, k), G in grams.items():
        prior = priors.get((s, k)) if priors else None
        coefs[(s, k)] = solve(totals[s] - G, n_targets, lam, prior, prior_lam)
    return coefs


def fold_grams(feats_folded: DataFrame, cfg: RunConfig) -> dict:
    """{(seed, fold): Gram matrix of the fold's own rows} (one scan)."""
    m = cfg.n_features + 1 + len(cfg.targets)
    return collect_grams(gram_tables(feats_folded, cfg.targets), m)


def fit_fold_models(spark: SparkSession, feats_folded: DataFrame, cfg: RunConfig, priors: dict | None = None,
                    grams: dict | None = None) -> dict:
    """{(seed, fold): (d+1) x n_targets coefficients} for every fold of every seed;
    pass ``grams`` from ``fold_grams`` to solve again without another scan."""
    grams = dict(grams if grams is not None else fold_grams(feats_folded, cfg))
    m = cfg.n_features + 1 + len(cfg.targets)
    for s in cfg.seeds:  # a fold without labelled rows still gets its model (all other rows)
        for k in range(cfg.n_folds):
            grams.setdefault((int(s), k), np.zeros((m, m)))
    return fit_from_grams(grams, len(cfg.targets), cfg.ridge_lambda, priors, cfg.prior_lambda if priors else 0.0)


def fit_direct(feats: DataFrame, cfg: RunConfig, key_cols=("seed", "fold")) -> dict:
    """Models fitted on each key's own rows (e.g. pseudo table of (seed, fold))."""
    m = cfg.n_features + 1 + len(cfg.targets)
    grams = collect_grams(gram_tables(feats, cfg.targets, key_cols), m, key_cols)
    return {k: solve(G, len(cfg.targets), cfg.ridge_lambda) for k, G in grams.items()}


def fit_predicted(feats: DataFrame, coefs: dict, cfg: RunConfig) -> dict:
    """Models fitted on rows that every model of ``coefs`` labelled itself.

    The labels are linear in the features (Y = Z B), so Z'Y = (Z'Z) B: one
    Gram matrix of the features serves all models, and no row is copied per
    model. Falls back to nothing when there are no rows.
    """
    one = feats.select(F.lit(0).alias("seed"), F.lit(0).alias("fold"), "features")
    d1 = cfg.n_features + 1
    grams = collect_grams(gram_tables(one, []), d1)
    if not grams:
        return {}
    (G,) = grams.values()
    n = len(cfg.targets)
    pad = np.zeros((n, d1 + n))
    return {k: solve(np.vstack([np.hstack([G, G @ B]), pad]), n, cfg.ridge_lambda) for k, B in coefs.items()}


def coefficients_frame(spark: SparkSession, coefs: dict, targets: Sequence[str] = TARGETS) -> DataFrame:
    rows = [(int(s), int(k), int(f), t, float(B[f, ti]))
            for (s, k), B in sorted(coefs.items()) for f in range(B.shape[0]) for ti, t in enumerate(targets)]
    return spark.createDataFrame(rows, "seed INT, fold INT, feature INT, target STRING, coef DOUBLE")


def apply_model(model, Z: np.ndarray) -> np.ndarray:
    """Pluggable fold model: a (d+1) x targets coefficient matrix, or any
    callable mapping the n x d feature matrix to n x targets predictions
    (it runs inside the tasks on each Arrow batch)."""
    return model(Z[:, 1:]) if callable(model) else Z @ model


def _pred_schema(key_types, targets):
    return T.StructType([T.StructField(n, t) for n, t in key_types] +
                        [T.StructField(t, T.DoubleType()) for t in targets])


def predict_own_fold(feats_folded: DataFrame, coefs: dict, targets: Sequence[str] = TARGETS,
                     id_col: str = "text_id", feat_col: str = "features", labels: bool = False) -> DataFrame:
    """OOF: each row predicted by the model of its own (seed, fold);
    ``coefs`` maps (seed, fold) to a coefficient matrix or a callable.
    ``labels`` keeps each row's labels beside its predictions (``y_<target>``),
    so they need no join by id (ids may be null)."""
    targets = list(targets)
    seen = [f"y_{t}" for t in targets] if labels else []
    schema = _pred_schema([("seed", T.IntegerType()), (id_col, T.StringType()), ("fold", T.IntegerType())],
                          [*targets, *seen])

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            Z = design(matrix(rb, feat_col))
            keys = rb.select(["seed", "fold"]).to_pandas()
            P = np.full((rb.num_rows, len(targets)), np.nan)
            for (s, k), idx in keys.groupby(["seed", "fold"], sort=False).indices.items():
                P[idx] = apply_model(coefs[(int(s), int(k))], Z[idx])
            cols = [rb.column(rb.schema.get_field_index(c)) for c in ("seed", id_col, "fold")]
            cols += [pa.array(P[:, i]) for i in range(len(targets))]
            cols += [rb.column(rb.schema.get_field_index(c)) for c in seen]
            yield pa.RecordBatch.from_arrays(cols, names=["seed", id_col, "fold", *targets, *seen])

    known = [F.col(t).cast("double").alias(f"y_{t}") for t in targets] if labels else []
    return feats_folded.select("seed", id_col, "fold", feat_col, *known).mapInArrow(run, schema)


def predict_every_fold(spark: SparkSession, feats: DataFrame, coefs: dict, cfg: RunConfig | None = None,
                       targets: Sequence[str] = TARGETS, id_col: str = "text_id", feat_col: str = "features") -> DataFrame:
    """(seed, fold, id, targets): every row predicted by every fold model."""
    targets = list(cfg.targets if cfg else targets)
    keys = sorted(coefs)
    schema = _pred_schema([("seed", T.IntegerType()), ("fold", T.IntegerType()), (id_col, T.StringType())], targets)

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            Z = design(matrix(rb, feat_col))
            ids = rb.column(rb.schema.get_field_index(id_col))
            n = rb.num_rows
            for s, k in keys:
                P = apply_model(coefs[(s, k)], Z)
                cols = [pa.array(np.full(n, s, dtype=np.int32)), pa.array(np.full(n, k, dtype=np.int32)), ids]
                cols += [pa.array(P[:, i]) for i in range(len(targets))]
                yield pa.RecordBatch.from_arrays(cols, names=["seed", "fold", id_col, *targets])

    return feats.select(id_col, feat_col).mapInArrow(run, schema)


def predict_ensemble(feats: DataFrame, coefs: dict, targets: Sequence[str] = TARGETS, id_col: str = "text_id",
                     feat_col: str = "features") -> DataFrame:
    """(id, targets, n_models): the mean over all given models, taken for each
    row inside the task. The mean of linear models is one model with their mean
    coefficients; other models are averaged row by row. ``n_models`` says how
    many models each row's mean is of."""
    targets, models = list(targets), [coefs[k] for k in sorted(coefs)]
    linear = [m for m in models if not callable(m)]
    others = [m for m in models if callable(m)]
    mean = np.mean(linear, axis=0) if linear else None
    schema = T.StructType([*_pred_schema([(id_col, T.StringType())], targets).fields,
                           T.StructField("n_models", T.IntegerType())])

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            Z = design(matrix(rb, feat_col))
            total = np.zeros((rb.num_rows, len(targets))) if mean is None else apply_model(mean, Z) * len(linear)
            for m in others:
                total = total + apply_model(m, Z)
            P = total / len(models)
            cols = [rb.column(rb.schema.get_field_index(id_col)), *[pa.array(P[:, i]) for i in range(len(targets))],
                    pa.array(np.full(rb.num_rows, len(models), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return feats.select(id_col, feat_col).mapInArrow(run, schema)
