"""Registered queries: one Spark job per operator, each with its SQL oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> str``
(DuckDB SQL over the pre-registered views). Queries without an oracle are
checked by row count and by the invariant tests in ``tests/``.
Floating results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.config import SAMPLE_OOF_VALUE, TARGETS
from foldwise.operators import metrics as M
from foldwise.operators.folds import one_hot_name
from foldwise.plans import fixtures as FX
from foldwise.plans import sqlparts as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, nd: int = 6) -> DataFrame:
    """Round every DOUBLE column (oracle comparison is exact after rounding)."""
    return df.select(*[F.round(F.col(f.name), nd).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


# --- A7: constant-predictor score (first end-to-end query) -----------------
@register("constant_baseline_score", f"""
WITH {S.ESSAYS}, p AS (SELECT text_id, {", ".join(f"CAST({SAMPLE_OOF_VALUE} AS DOUBLE) AS {t}" for t in TARGETS)} FROM essays)
SELECT {S.mcrmse_select()} FROM essays e JOIN p USING (text_id)
""")
def constant_baseline_score(spark, sf_dir):
    from foldwise.operators.datasets import sample_oof
    train = FX.essays(spark, sf_dir, with_text=False)
    scored = M.align(train, sample_oof(train), ["text_id"])
    return round_doubles(M.mcrmse(scored))


# ---------------------------------------------------------------------------
# shared Spark inputs
# ---------------------------------------------------------------------------
T6 = list(TARGETS)
T6_SQL = ", ".join(T6)


def _folded(spark, sf_dir, seeds=(42, 43, 44), with_text=False, materialized=False):
    from foldwise.operators.folds import assign_folds
    from foldwise.session import materialize
    folded = assign_folds(FX.essays(spark, sf_dir, with_text=with_text), seeds=seeds)
    return materialize(folded) if materialized else folded


def _own_fold_preds(folded, fold_subset=None):
    """Prediction table of each fold model for its own validation rows."""
    x = folded if fold_subset is None else folded.where(F.col("fold").isin(list(fold_subset)))
    return x.select("seed", "text_id", "fold", *FX.fold_prediction_cols("fold"))


def _oof(spark, sf_dir, seeds=(42, 43, 44), fold_subset=None):
    from foldwise.operators.datasets import oof_template
    folded = _folded(spark, sf_dir, seeds, materialized=True)  # read by three branches
    keys = ["seed", "text_id", "fold"]
    template = oof_template(folded).drop(*T6)
    oof = template.join(_own_fold_preds(folded, fold_subset), keys, "left")
    return folded, oof


def _scored_oof(spark, sf_dir, seeds=(42, 43, 44)):
    folded, oof = _oof(spark, sf_dir, seeds)
    return M.align(folded, oof, ["seed", "text_id", "fold"])


OOF_SQL = f"""WITH {S.ESSAYS}, {S.folds_cte()},
fe AS (SELECT f.seed, f.fold, e.* FROM folds f JOIN essays e USING (text_id)),
p AS (SELECT seed, fold, text_id, {S.pred_sql('fold')} FROM fe)"""


# --- V1 / V2 ----------------------------------------------------------------
@register("stratified_folds", f"""
WITH {S.ESSAYS}, {S.folds_cte()} SELECT seed, text_id, fold FROM folds
""")
def stratified_folds(spark, sf_dir):
    return _folded(spark, sf_dir).select("seed", "text_id", "fold")


_MEASURED = ("n_chars", "doc_id")   # continuous targets: nearly as many values as rows


@register("sparse_label_places", f"""
WITH {S.ESSAYS}, long AS (SELECT text_id, 'n_chars' AS target, CAST(n_chars AS DOUBLE) AS value FROM essays
  UNION ALL SELECT text_id, 'doc_id', CAST(doc_id AS DOUBLE) FROM essays),
dict AS (SELECT target, value, row_number() OVER (PARTITION BY target ORDER BY count(*) DESC, value) - 1 AS place
  FROM long GROUP BY target, value)
SELECT text_id, max(CASE WHEN target = 'n_chars' THEN place END) AS n_chars_place,
  max(CASE WHEN target = 'doc_id' THEN place END) AS doc_id_place FROM long JOIN dict USING (target, value) GROUP BY text_id
""")
def sparse_label_places(spark, sf_dir):
    """One-hot labels of two targets with any number of values, as places."""
    from foldwise.operators.folds import sparse_labels
    out = sparse_labels(FX.essays(spark, sf_dir, with_text=False), _MEASURED)
    return out.select("text_id", *[F.col("labels")[i].alias(f"{t}_place") for i, t in enumerate(_MEASURED)])


_BIN_SQL = ("len(list_filter(list_distinct(list_transform(range(1, 32), lambda i: {a}[CAST(ceil(i / 32.0 * n) AS INTEGER)])), "
            "lambda b: b < {c}))")


@register("quantile_folds", f"""
WITH {S.ESSAYS}, q AS (SELECT list(n_chars ORDER BY n_chars) AS a, list(doc_id ORDER BY doc_id) AS b, count(*) AS n FROM essays),
binned AS MATERIALIZED (SELECT text_id, {_BIN_SQL.format(a="a", c="n_chars")} AS k0, {_BIN_SQL.format(a="b", c="doc_id")} AS k1 FROM essays, q)
SELECT seed, text_id, CAST((r + ('0x' || substr(md5(CAST(seed AS VARCHAR) || ':blk:' || CAST(r // 5 AS VARCHAR)), 1, 8))::BIGINT) % 5
  AS INTEGER) AS fold FROM (SELECT s.seed, text_id, row_number() OVER (PARTITION BY s.seed ORDER BY k0, k1,
  md5(CAST(s.seed AS VARCHAR) || ':' || text_id), text_id) - 1 AS r FROM binned CROSS JOIN {S.seeds_sql()} s)
""")
def quantile_folds_q(spark, sf_dir):
    """Folds stratified on continuous targets. The SQL takes exact quantiles,
    which the sketches give for up to 10,000 rows."""
    from foldwise.operators.folds import assign_folds
    narrow = FX.essays(spark, sf_dir, with_text=False).select("text_id", *_MEASURED)
    return assign_folds(narrow, seeds=(42, 43, 44), targets=_MEASURED, quantile_bins=32).select("seed", "text_id", "fold")


@register("balanced_folds")
def balanced_folds(spark, sf_dir):
    """Folds whose label balance is repaired by swaps (no SQL: tested by its balance)."""
    from foldwise.operators.balance import assign_balanced_folds
    narrow = FX.essays(spark, sf_dir, with_text=False).select("text_id", *T6)
    return assign_balanced_folds(narrow, seeds=(42, 43, 44)).select("seed", "text_id", "fold")


# --- A14 --------------------------------------------------------------------
@register("fold_balance", f"""
WITH {S.ESSAYS}, {S.folds_cte()},
fe AS (SELECT f.seed, f.fold, {", ".join("e." + t for t in T6)} FROM folds f JOIN essays e USING (text_id)),
long AS (UNPIVOT fe ON {T6_SQL} INTO NAME target VALUE value)
SELECT seed, target, value, fold, count(*) AS n_rows FROM long GROUP BY seed, target, value, fold
""")
def fold_balance_q(spark, sf_dir):
    from foldwise.operators.folds import fold_balance
    return fold_balance(_folded(spark, sf_dir))


# --- P9 ---------------------------------------------------------------------
_DOMAIN = [1.0 + 0.5 * i for i in range(9)]


@register("label_one_hot", f"""
WITH {S.ESSAYS}
SELECT text_id, {", ".join(f"CAST(coalesce({t} = {v!r}, false) AS INTEGER) AS {one_hot_name(t, v)}" for t in T6 for v in _DOMAIN)}
FROM essays
""")
def label_one_hot(spark, sf_dir):
    from foldwise.operators.folds import one_hot_labels
    return one_hot_labels(FX.essays(spark, sf_dir, with_text=False))


# --- F1 / P2 / F2 / P4 / P1 P3 ------------------------------------------------
_FOLDS42 = S.folds_cte(seeds=[42])


@register("train_split", f"""
WITH {S.ESSAYS}, {_FOLDS42}
SELECT e.text_id, e.full_text, {", ".join("e." + t for t in T6)} FROM essays e JOIN folds f USING (text_id) WHERE f.fold <> 0
""")
def train_split(spark, sf_dir):
    from foldwise.operators.splits import holdout
    train, _ = holdout(_folded(spark, sf_dir, seeds=[42], with_text=True), 0)
    return train.select("text_id", "full_text", *T6)


@register("valid_split", f"""
WITH {S.ESSAYS}, {_FOLDS42}
SELECT e.text_id, e.full_text FROM essays e JOIN folds f USING (text_id) WHERE f.fold = 0
""")
def valid_split(spark, sf_dir):
    from foldwise.operators.splits import holdout
    _, valid = holdout(_folded(spark, sf_dir, seeds=[42], with_text=True), 0)
    return valid.select("text_id", "full_text")


@register("fold_subset", f"""
WITH {S.ESSAYS}, {S.folds_cte()} SELECT seed, text_id, fold FROM folds WHERE fold IN (0, 1)
""")
def fold_subset_q(spark, sf_dir):
    from foldwise.config import DEBUG_FOLDS
    from foldwise.operators.splits import fold_subset
    return fold_subset(_folded(spark, sf_dir), DEBUG_FOLDS).select("seed", "text_id", "fold")


@register("oof_template", f"""
WITH {S.ESSAYS}, {S.folds_cte()}
SELECT seed, text_id, fold, {", ".join(f"CAST(NULL AS DOUBLE) AS {t}" for t in T6)} FROM folds
""")
def oof_template_q(spark, sf_dir):
    from foldwise.operators.datasets import oof_template
    return oof_template(_folded(spark, sf_dir))


@register("sample_oof", f"""
WITH {S.ESSAYS} SELECT text_id, {", ".join(f"CAST(3.0 AS DOUBLE) AS {t}" for t in T6)} FROM essays
""")
def sample_oof_q(spark, sf_dir):
    from foldwise.operators.datasets import sample_oof
    return sample_oof(FX.essays(spark, sf_dir, with_text=True).drop("full_text"))


# --- V4 / V5 / V6 / X3 --------------------------------------------------------
@register("debug_head", f"""
WITH {S.ESSAYS}, {_FOLDS42}
SELECT e.text_id, {", ".join("e." + t for t in T6)} FROM essays e JOIN folds f USING (text_id)
WHERE f.fold <> 0 ORDER BY e.text_id LIMIT 300
""")
def debug_head(spark, sf_dir):
    from foldwise.config import DEBUG_ROWS
    from foldwise.operators.splits import head, holdout
    train, _ = holdout(_folded(spark, sf_dir, seeds=[42]), 0)
    return head(train.select("text_id", *T6), DEBUG_ROWS, ["text_id"])


@register("head_per_fold", f"""
WITH {S.ESSAYS}, {_FOLDS42}
SELECT fold, text_id, {T6_SQL} FROM (
  SELECT f.fold, e.*, row_number() OVER (PARTITION BY f.fold ORDER BY e.text_id) AS rn
  FROM essays e JOIN folds f USING (text_id)) WHERE rn <= 300
""")
def head_per_fold(spark, sf_dir):
    from foldwise.config import DEBUG_ROWS
    from foldwise.operators.splits import head_per_group
    folded = _folded(spark, sf_dir, seeds=[42])
    return head_per_group(folded, ["fold"], ["text_id"], DEBUG_ROWS).select("fold", "text_id", *T6)


@register("seeded_shuffle", f"""
WITH {S.ESSAYS}, {_FOLDS42},
tr AS (SELECT e.text_id FROM essays e JOIN folds f USING (text_id) WHERE f.fold <> 0),
ep AS (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS epoch)
SELECT epoch, text_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || CAST(epoch AS VARCHAR) || ':' || text_id), text_id) - 1 AS rank
FROM tr CROSS JOIN ep
""")
def seeded_shuffle(spark, sf_dir):
    from foldwise.config import EPOCHS
    from foldwise.operators.splits import holdout, seeded_order
    train, _ = holdout(_folded(spark, sf_dir, seeds=[42]), 0)
    x = train.select("text_id", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])).alias("epoch"))
    return seeded_order(x, 42, F.col("epoch"), group_cols=["epoch"], name="rank").select("epoch", "text_id", "rank")


_BATCH_SQL = f"""WITH {S.ESSAYS}, {_FOLDS42},
b AS (SELECT f.fold, e.text_id, (row_number() OVER (PARTITION BY f.fold ORDER BY e.text_id) - 1) // 4 AS batch_id
      FROM essays e JOIN folds f USING (text_id))"""


@register("batch_assign", _BATCH_SQL + " SELECT fold, text_id, batch_id FROM b")
def batch_assign(spark, sf_dir):
    from foldwise.config import BATCH_SIZE
    from foldwise.operators.splits import batches
    folded = _folded(spark, sf_dir, seeds=[42])
    return batches(folded.select("fold", "text_id"), ["fold"], ["text_id"], BATCH_SIZE).select("fold", "text_id", "batch_id")


# --- X1 / X2 ------------------------------------------------------------------
from foldwise.config import MAX_TOKENS as TOKEN_LEN  # the task's own maximum sequence length (2048)
_TOK_SQL = (f"tok AS (SELECT text_id, body, CAST(len(body) + 2 AS INTEGER) AS n_real FROM (SELECT text_id, "
            f"list_filter(string_split_regex(full_text, '[ \\n\\t]+'), lambda x: x <> '')[1:{TOKEN_LEN - 2}] AS body FROM essays))")
_SEQ_SQL = "array_to_string(list_concat(list_concat(['[CLS]'], body), ['[SEP]']), ' ')"


@register("token_pad_mask", f"""
WITH {S.ESSAYS}, {_TOK_SQL}
SELECT text_id, n_real, CAST({TOKEN_LEN} AS INTEGER) AS n_tokens,
       md5({_SEQ_SQL} || repeat(' [PAD]', {TOKEN_LEN} - n_real)) AS tokens_md5,
       md5(repeat('1', n_real) || repeat('0', {TOKEN_LEN} - n_real)) AS mask_md5
FROM tok
""")
def token_pad_mask(spark, sf_dir):
    from foldwise.operators.tokens import mask_length, tokenize
    t = tokenize(FX.essays(spark, sf_dir), TOKEN_LEN)
    return t.select("text_id", mask_length(F.col("mask")).alias("n_real"), F.size("tokens").alias("n_tokens"),
                    F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
                    F.md5(F.array_join(F.col("mask").cast("array<string>"), "")).alias("mask_md5"))


@register("batch_trim", _BATCH_SQL + f""", {_TOK_SQL},
bt AS (SELECT b.fold, b.batch_id, b.text_id, t.body, t.n_real, max(t.n_real) OVER (PARTITION BY b.fold, b.batch_id) AS trim_len
       FROM b JOIN tok t USING (text_id))
SELECT fold, batch_id, text_id, trim_len, md5({_SEQ_SQL} || repeat(' [PAD]', trim_len - n_real)) AS tokens_md5 FROM bt
""")
def batch_trim(spark, sf_dir):
    from foldwise.config import BATCH_SIZE
    from foldwise.operators.splits import batches
    from foldwise.operators.tokens import pad_to_batch_longest, tokenize
    folded = _folded(spark, sf_dir, seeds=[42])
    # batches are numbered on narrow rows; texts join once by id
    b = batches(folded.select("fold", "text_id"), ["fold"], ["text_id"], BATCH_SIZE)
    texts = FX.essays(spark, sf_dir).select("text_id", "full_text")
    t = pad_to_batch_longest(tokenize(b.join(texts, "text_id"), TOKEN_LEN, pad=False, cut=True), ["fold", "batch_id"])
    return t.select("fold", "batch_id", "text_id", "trim_len", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


# --- X4 / X5 / X6 / X7 ------------------------------------------------------------
_EMB_SQL = f"""t AS (SELECT label AS doc, vec_id, CAST(vec_id % {S.TOKEN_MASK_MOD} <> 0 AS INTEGER) AS mask, embedding,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
x AS (SELECT doc, pos, CAST(mask AS DOUBLE) AS m, len(embedding) AS d, CAST(unnest(range(len(embedding))) AS INTEGER) AS dim,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM t)"""
_MEAN_SQL = "mp AS (SELECT doc, dim, sum(v * m) / greatest(sum(m), 1e-9) AS value FROM x GROUP BY doc, dim)"


@register("mean_pool", f"WITH {_EMB_SQL}, {_MEAN_SQL} SELECT doc, dim, round(value, 6) AS value FROM mp")
def mean_pool_q(spark, sf_dir):
    from foldwise.operators.pooling import mean_pool
    return round_doubles(mean_pool(FX.token_embeddings(spark, sf_dir)))


@register("gem_cls_pool", f"""WITH {_EMB_SQL}
SELECT doc, dim, round(v, 6) AS value FROM x WHERE pos = 0
UNION ALL
SELECT doc, CAST(dim + d AS INTEGER) AS dim,
  round(pow(sum(pow(greatest(v, 1e-6), 3.0) * m) / greatest(sum(m), 1e-6), 1.0 / 3.0), 6) AS value
FROM x WHERE pos > 0 GROUP BY doc, dim, d
""")
def gem_cls_pool_q(spark, sf_dir):
    from foldwise.operators.pooling import gem_cls_pool
    return round_doubles(gem_cls_pool(FX.token_embeddings(spark, sf_dir)))


@register("position_slice", f"""WITH {_EMB_SQL}
SELECT doc, CAST(pos - 1 AS INTEGER) AS slot, dim, round(v, 6) AS value FROM x WHERE pos BETWEEN 1 AND 6
""")
def position_slice_q(spark, sf_dir):
    from foldwise.operators.pooling import position_slice
    return round_doubles(position_slice(FX.token_embeddings(spark, sf_dir)))


_W_SQL = "CAST(((dim * 7 + {i} * 3) % 11) - 5 AS DOUBLE) / 100"


@register("linear_head", f"""WITH {_EMB_SQL}, {_MEAN_SQL}
SELECT doc, {", ".join(f"round(sum(value * {_W_SQL.format(i=i)}) + 3.0, 6) AS {t}" for i, t in enumerate(T6))}
FROM mp GROUP BY doc
""")
def linear_head_q(spark, sf_dir):
    from foldwise.operators.pooling import linear_head, mean_vectors
    pooled = mean_vectors(FX.token_embeddings(spark, sf_dir))
    weights = FX.head_weights(spark, FX.embedding_dim(spark, sf_dir))
    return round_doubles(linear_head(pooled, weights, FX.HEAD_BIAS))


# --- P5 / P6 --------------------------------------------------------------------
@register("paragraph_dataset", f"""
WITH {S.ESSAYS}, v AS (SELECT text_id, replace(replace(full_text, chr(10), chr(10) || chr(10)), chr(10) || chr(10), ' | ') AS t FROM essays)
SELECT text_id, md5(t) AS full_text_md5, CAST(length(t) AS INTEGER) AS n_chars FROM v
""")
def paragraph_dataset(spark, sf_dir):
    from foldwise.operators.datasets import with_variant
    e = FX.essays(spark, sf_dir)
    # fixture: the documents have single newlines only; make them blank lines first
    e = e.withColumn("full_text", F.replace(F.col("full_text"), F.lit("\n"), F.lit("\n\n")))
    v = with_variant(e, "paragraph", "train")
    return v.select("text_id", F.md5("full_text").alias("full_text_md5"), F.length("full_text").alias("n_chars"))


@register("reg_token_dataset", f"""
WITH {S.ESSAYS}, {S.TEST}
SELECT 'train' AS split, text_id, md5(' cohesion syntax vocabulary phraseology grammar conventions [SEP] ' || full_text) AS full_text_md5,
  CAST(length(' cohesion syntax vocabulary phraseology grammar conventions [SEP] ' || full_text) AS INTEGER) AS n_chars FROM essays
UNION ALL
SELECT 'test' AS split, text_id, md5(full_text), CAST(length(full_text) AS INTEGER) FROM test
""")
def reg_token_dataset(spark, sf_dir):
    from foldwise.operators.datasets import with_variant
    tr = with_variant(FX.essays(spark, sf_dir), "reg_token", "train").select(F.lit("train").alias("split"), "text_id", "full_text")
    te = with_variant(FX.test_texts(spark, sf_dir), "reg_token", "test").select(F.lit("test").alias("split"), "text_id", "full_text")
    u = tr.unionByName(te)
    return u.select("split", "text_id", F.md5("full_text").alias("full_text_md5"), F.length("full_text").alias("n_chars"))


# --- J1 / F3 / S5 / U1 -------------------------------------------------------------
_CORPUS_SQL = f"""{S.ESSAYS},
labelled AS (SELECT * FROM essays WHERE doc_id IN (SELECT doc_id FROM labels)),
corpus AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS text_id, doc_id, n_chars, text AS full_text FROM documents),
cand AS (SELECT * FROM corpus c WHERE NOT EXISTS (SELECT 1 FROM labelled l WHERE l.text_id IS NOT DISTINCT FROM c.text_id))"""


def _candidates(spark, sf_dir):
    from foldwise.plans.jobs import pseudo_base
    return pseudo_base(FX.labelled_essays(spark, sf_dir), FX.corpus(spark, sf_dir))


@register("pseudo_candidates", f"WITH {_CORPUS_SQL} SELECT text_id, md5(full_text) AS full_text_md5 FROM cand")
def pseudo_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("text_id", F.md5("full_text").alias("full_text_md5"))


@register("table_shape", f"""WITH {_CORPUS_SQL}
SELECT 'train' AS table_name, count(*) AS n_rows, CAST(8 AS INTEGER) AS n_cols FROM essays
UNION ALL SELECT 'pseudo_base', count(*), CAST(8 AS INTEGER) FROM cand
""")
def table_shape(spark, sf_dir):
    train = FX.essays(spark, sf_dir).select("text_id", "full_text", *T6)
    base = _candidates(spark, sf_dir).select("text_id", "full_text", *[F.lit(None).cast("double").alias(t) for t in T6])

    def shape(df, name):
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))
    return shape(train, "train").unionByName(shape(base, "pseudo_base"))


@register("union_rows", f"""WITH {_CORPUS_SQL}
SELECT text_id, 'train' AS origin, {T6_SQL} FROM labelled
UNION ALL SELECT text_id, 'pseudo', {", ".join(f"CAST(NULL AS DOUBLE)" for _ in T6)} FROM cand
""")
def union_rows(spark, sf_dir):
    a = FX.labelled_essays(spark, sf_dir).select("text_id", F.lit("train").alias("origin"), *T6)
    b = _candidates(spark, sf_dir).select("text_id", F.lit("pseudo").alias("origin"),
                                          *[F.lit(None).cast("double").alias(t) for t in T6])
    return a.unionByName(b)


# --- F5 ------------------------------------------------------------------------
@register("valid_names", """
SELECT c_custkey, regexp_full_match(c_name, '[a-zA-Z0-9-]+') AS name_valid,
       regexp_full_match(replace(c_name, '#', '-'), '[a-zA-Z0-9-]+') AS dashed_valid FROM customer
""")
def valid_names(spark, sf_dir):
    from foldwise.functions.text import valid_run_name
    c = FX.table(spark, sf_dir, "customer")
    return c.select("c_custkey", valid_run_name(F.col("c_name")).alias("name_valid"),
                    valid_run_name(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))).alias("dashed_valid"))


# --- A12 / J6 / A13 ------------------------------------------------------------------
@register("step_count", f"""
WITH {S.ESSAYS}, {S.folds_cte()},
c AS (SELECT seed, fold, count(*) AS n_valid FROM folds GROUP BY seed, fold),
t AS (SELECT seed, sum(n_valid) AS total FROM c GROUP BY seed)
SELECT c.seed, c.fold, CAST(t.total - c.n_valid AS BIGINT) AS n_train, c.n_valid,
  CAST(ceil((t.total - c.n_valid) / 4.0) * 4 AS BIGINT) AS n_steps FROM c JOIN t USING (seed)
""")
def step_count(spark, sf_dir):
    return M.step_counts(_folded(spark, sf_dir, materialized=True))


@register("seed_fold_grid", f"""
WITH {S.ESSAYS}, {S.folds_cte()}, fe AS (SELECT f.seed, f.fold, e.* FROM folds f JOIN essays e USING (text_id)),
grid AS (SELECT s.seed, CAST(k.fold AS INTEGER) AS fold FROM {S.seeds_sql()} s CROSS JOIN (SELECT unnest(range(5)) AS fold) k)
SELECT g.seed, g.fold, count(*) AS n_train, {", ".join(f"round(avg(fe.{t}), 6) AS {t}" for t in T6)}
FROM grid g JOIN fe ON fe.seed = g.seed AND fe.fold <> g.fold GROUP BY g.seed, g.fold
""")
def seed_fold_grid(spark, sf_dir):
    from foldwise.operators.models import fold_mean_models
    return round_doubles(fold_mean_models(spark, _folded(spark, sf_dir, materialized=True)))


@register("best_step", """
SELECT seed, fold, step AS best_step, val_mcrmse AS best_value FROM (
  SELECT CAST(42 + user_id % 3 AS INTEGER) AS seed, CAST(event_id % 5 AS INTEGER) AS fold, event_id AS step, value AS val_mcrmse,
    row_number() OVER (PARTITION BY 42 + user_id % 3, event_id % 5 ORDER BY value, event_id) AS rn FROM events) WHERE rn = 1
""")
def best_step_q(spark, sf_dir):
    return M.best_step(FX.validation_log(spark, sf_dir))


# ---------------------------------------------------------------------------
# OOF assembly, scores, losses (fixture predictions of each fold model)
# ---------------------------------------------------------------------------
def _oof_q(where: str = "") -> str:
    return OOF_SQL + f",\nsc AS (SELECT fe.seed, fe.fold, fe.text_id, {', '.join(f'fe.{t} AS y_{t}, p.{t} AS p_{t}' for t in T6)} " \
                     f"FROM fe JOIN p USING (seed, fold, text_id) {where})"


def _rm_sql(nd=6):
    rm = [f"sqrt(avg((p_{t} - y_{t}) * (p_{t} - y_{t})))" for t in T6]
    mean = "(" + " + ".join(rm) + f") / {len(T6)}"
    r = (lambda x: f"round({x}, {nd})") if nd is not None else (lambda x: x)
    return ", ".join([f"{r(mean)} AS mcrmse"] + [f"{r(x)} AS {t}" for x, t in zip(rm, T6)])


@register("oof_assemble", OOF_SQL + f"""
SELECT seed, text_id, fold, {T6_SQL} FROM p
""")
def oof_assemble(spark, sf_dir):
    from foldwise.session import shared_path
    from foldwise.sources.processed import write_table
    _, oof = _oof(spark, sf_dir)
    path = shared_path(spark, "oof")
    write_table(oof, path, "oof", partition_cols=("seed",))
    return spark.read.parquet(f"{path}/oof")


@register("oof_predicted_only", OOF_SQL + f"""
SELECT seed, text_id, fold, {T6_SQL} FROM p WHERE fold IN (0, 1)
""")
def oof_predicted_only(spark, sf_dir):
    from foldwise.config import DEBUG_FOLDS, TARGETS as TT
    _, oof = _oof(spark, sf_dir, fold_subset=DEBUG_FOLDS)
    return oof.where(F.col(TT[0]).isNotNull())


@register("mcrmse", _oof_q("WHERE fe.seed = 42") + f" SELECT {_rm_sql()} FROM sc")
def mcrmse_q(spark, sf_dir):
    return round_doubles(M.mcrmse(_scored_oof(spark, sf_dir, seeds=[42])))


@register("column_rmse", _oof_q("WHERE fe.seed = 42") + f""",
r AS (SELECT {_rm_sql(None)} FROM sc)
SELECT target, round(rmse, 6) AS rmse FROM (UNPIVOT (SELECT {T6_SQL} FROM r) ON {T6_SQL} INTO NAME target VALUE rmse)
""")
def column_rmse(spark, sf_dir):
    return round_doubles(M.column_rmse_long(M.mcrmse(_scored_oof(spark, sf_dir, seeds=[42]))))


@register("oof_score_by_seed", _oof_q() + f" SELECT seed, {_rm_sql()} FROM sc GROUP BY seed")
def oof_score_by_seed(spark, sf_dir):
    return round_doubles(M.mcrmse(_scored_oof(spark, sf_dir), ["seed"]))


@register("fold_mcrmse", _oof_q() + f" SELECT seed, fold, {_rm_sql()} FROM sc GROUP BY seed, fold")
def fold_mcrmse(spark, sf_dir):
    return round_doubles(M.mcrmse(_scored_oof(spark, sf_dir), ["seed", "fold"]))


@register("seed_mean_score", _oof_q() + f""",
s AS (SELECT seed, {_rm_sql(None)} FROM sc GROUP BY seed)
SELECT round(avg(mcrmse), 6) AS mcrmse, {", ".join(f"round(avg({t}), 6) AS {t}" for t in T6)} FROM s
""")
def seed_mean_score(spark, sf_dir):
    return round_doubles(M.seed_mean(M.mcrmse(_scored_oof(spark, sf_dir), ["seed"])))


_LONG_ERR = " UNION ALL ".join(f"SELECT seed, fold, p_{t} AS pv, y_{t} AS yv FROM sc" for t in T6)


@register("smooth_l1", _oof_q() + f""",
l AS ({_LONG_ERR}), d AS (SELECT seed, abs(pv - yv) AS d FROM l)
SELECT seed, round(avg(CASE WHEN d < 1.0 THEN 0.5 * d * d / 1.0 ELSE d - 0.5 END), 6) AS smooth_l1 FROM d GROUP BY seed
""")
def smooth_l1_q(spark, sf_dir):
    return round_doubles(M.smooth_l1_mean(_scored_oof(spark, sf_dir), ["seed"], beta=1.0))


def _wsl1_sql():
    terms = []
    for t, w in zip(T6, M.SMOOTH_L1_WEIGHTS):
        n = f"abs(p_{t} - y_{t})"
        terms.append(f"CAST({w!r} AS DOUBLE) * (CASE WHEN {n} < 1.0 THEN (0.5 * {n}) * (0.5 * {n}) / 1.0 ELSE {n} - 0.5 END)")
    return " + ".join(terms)


@register("weighted_smooth_l1", _oof_q() + f"""
SELECT seed, fold, round(sum({_wsl1_sql()}), 6) AS weighted_smooth_l1 FROM sc GROUP BY seed, fold
""")
def weighted_smooth_l1_q(spark, sf_dir):
    return round_doubles(M.weighted_smooth_l1_sum(_scored_oof(spark, sf_dir), ["seed", "fold"], beta=1.0))


@register("rmse_loss", _oof_q() + f""",
l AS ({_LONG_ERR}), e AS (SELECT seed, sqrt((pv - yv) * (pv - yv) + 1e-9) AS e FROM l)
SELECT seed, round(avg(e), 6) AS rmse_loss_mean, round(sum(e), 6) AS rmse_loss_sum FROM e GROUP BY seed
""")
def rmse_loss_q(spark, sf_dir):
    return round_doubles(M.rmse_loss(_scored_oof(spark, sf_dir), ["seed"]))


# --- A6 / J4 / K4 ---------------------------------------------------------------
def _test_fold_preds(spark, sf_dir, n_folds=5):
    t = FX.test_texts(spark, sf_dir).select("text_id", "doc_id", "n_chars")
    t = t.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(n_folds)])))
    return t.select("text_id", "fold", *FX.fold_prediction_cols("fold"))


_ENS_SQL = f"""WITH {S.TEST}, tf AS (SELECT t.*, CAST(k.fold AS INTEGER) AS fold FROM test t CROSS JOIN (SELECT unnest(range(5)) AS fold) k),
tp AS (SELECT text_id, fold, {S.pred_sql('fold')} FROM tf)"""


@register("ensemble_mean", _ENS_SQL + f"""
SELECT text_id, {", ".join(f"round(avg({t}), 6) AS {t}" for t in T6)}, count(*) AS n_models FROM tp GROUP BY text_id
""")
def ensemble_mean(spark, sf_dir):
    return round_doubles(M.fold_ensemble(_test_fold_preds(spark, sf_dir)))


@register("submission", _ENS_SQL + f"""
SELECT text_id, {", ".join(f"round(avg({t}), 6) AS {t}" for t in T6)} FROM tp GROUP BY text_id
""")
def submission(spark, sf_dir):
    from foldwise.plans.jobs import make_submission
    from foldwise.session import shared_path
    from foldwise.sources.csv import read_sample_submission
    ens = round_doubles(M.fold_ensemble(_test_fold_preds(spark, sf_dir)).drop("n_models"))
    path = shared_path(spark, "submission")
    make_submission(FX.submission_template(spark, sf_dir), ens, path)
    return read_sample_submission(spark, path)


# --- M3: fold-mean predictor ---------------------------------------------------------
_FM_SQL = f"""WITH {S.ESSAYS}, {S.folds_cte()}, fe AS (SELECT f.seed, f.fold, e.* FROM folds f JOIN essays e USING (text_id)),
grid AS (SELECT s.seed, CAST(k.fold AS INTEGER) AS fold FROM {S.seeds_sql()} s CROSS JOIN (SELECT unnest(range(5)) AS fold) k),
models AS (SELECT g.seed, g.fold, {", ".join(f"avg(fe.{t}) AS {t}" for t in T6)} FROM grid g JOIN fe ON fe.seed = g.seed AND fe.fold <> g.fold GROUP BY g.seed, g.fold)"""


def _fold_mean_oof(spark, sf_dir):
    from foldwise.operators.models import fold_mean_models, predict_constant
    folded = _folded(spark, sf_dir, materialized=True)
    models = fold_mean_models(spark, folded)
    return folded, predict_constant(folded.select("seed", "text_id", "fold"), models)


@register("fold_mean_oof", _FM_SQL + f"""
SELECT fe.seed, fe.text_id, fe.fold, {", ".join(f"round(m.{t}, 6) AS {t}" for t in T6)} FROM fe JOIN models m USING (seed, fold)
""")
def fold_mean_oof(spark, sf_dir):
    return round_doubles(_fold_mean_oof(spark, sf_dir)[1])


@register("fold_mean_score", _FM_SQL + f""",
sc AS (SELECT fe.seed, fe.fold, {', '.join(f'fe.{t} AS y_{t}, m.{t} AS p_{t}' for t in T6)} FROM fe JOIN models m USING (seed, fold))
SELECT seed, fold, {_rm_sql()} FROM sc GROUP BY seed, fold
""")
def fold_mean_score(spark, sf_dir):
    from foldwise.operators.models import fold_mean_models, score_constant
    folded = _folded(spark, sf_dir, materialized=True)
    scored = score_constant(folded, fold_mean_models(spark, folded))
    return round_doubles(M.mcrmse(scored, ["seed", "fold"]))


@register("fold_mean_submission", _FM_SQL + f""", {S.TEST}
SELECT t.text_id, {", ".join(f"round(avg(m.{t}), 6) AS {t}" for t in T6)}
FROM test t CROSS JOIN (SELECT * FROM models WHERE seed = 42) m GROUP BY t.text_id
""")
def fold_mean_submission(spark, sf_dir):
    from foldwise.operators.models import fold_mean_models, predict_constant
    models = fold_mean_models(spark, _folded(spark, sf_dir, seeds=[42], materialized=True), seeds=[42])
    t = FX.test_texts(spark, sf_dir).select("text_id").withColumn("seed", F.lit(42))
    t = t.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(5)])))
    return round_doubles(M.fold_ensemble(predict_constant(t, models)).drop("n_models"))


@register("metrics_log", _FM_SQL + f""",
sc AS (SELECT fe.seed, {', '.join(f'fe.{t} AS y_{t}, m.{t} AS p_{t}' for t in T6)} FROM fe JOIN models m USING (seed, fold)),
s AS (SELECT seed, {_rm_sql(None).replace(' AS mcrmse', ' AS oof_score')} FROM sc GROUP BY seed),
per_seed AS (UNPIVOT s ON oof_score, {T6_SQL} INTO NAME metric VALUE value),
means AS (SELECT avg(oof_score) AS oof_score_seed_mean, {", ".join(f"avg({t}) AS {t}_seed_mean" for t in T6)} FROM s),
mean_rows AS (UNPIVOT means ON oof_score_seed_mean, {", ".join(f"{t}_seed_mean" for t in T6)} INTO NAME metric VALUE value)
SELECT 'fold_mean' AS run, seed, metric, round(value, 6) AS value FROM per_seed
UNION ALL SELECT 'fold_mean', CAST(NULL AS INTEGER), metric, round(value, 6) FROM mean_rows
""")
def metrics_log(spark, sf_dir):
    from foldwise.plans.jobs import score_log
    from foldwise.operators.models import fold_mean_models, score_constant
    folded = _folded(spark, sf_dir, materialized=True)
    scored = score_constant(folded, fold_mean_models(spark, folded))
    return round_doubles(score_log(M.mcrmse(scored, ["seed"]), "fold_mean"))


# --- M6 / J3 / P7 with the fold-mean model -------------------------------------------
_PSEUDO_SQL = f"""WITH {_CORPUS_SQL}, {S.folds_cte(source='labelled')},
fe AS (SELECT f.seed, f.fold, e.* FROM folds f JOIN labelled e USING (text_id)),
grid AS (SELECT s.seed, CAST(k.fold AS INTEGER) AS fold FROM {S.seeds_sql()} s CROSS JOIN (SELECT unnest(range(5)) AS fold) k),
models AS (SELECT g.seed, g.fold, {", ".join(f"avg(fe.{t}) AS {t}" for t in T6)} FROM grid g JOIN fe ON fe.seed = g.seed AND fe.fold <> g.fold GROUP BY g.seed, g.fold),
pp AS (SELECT m.seed, m.fold, c.text_id, {", ".join(f"round(m.{t}, 6) AS {t}" for t in T6)} FROM cand c CROSS JOIN models m)"""


def _pseudo_predictions(spark, sf_dir):
    from foldwise.plans.jobs import pseudo_label_tables
    return pseudo_label_tables(spark, FX.labelled_essays(spark, sf_dir), FX.corpus(spark, sf_dir), model="fold_mean")


@register("pseudo_predictions", _PSEUDO_SQL + f" SELECT seed, fold, text_id, {T6_SQL} FROM pp")
def pseudo_predictions(spark, sf_dir):
    return round_doubles(_pseudo_predictions(spark, sf_dir).select("seed", "fold", "text_id", *T6))


@register("pseudo_read", _PSEUDO_SQL + f"""
SELECT pp.text_id, md5(c.full_text) AS full_text_md5, {", ".join("pp." + t for t in T6)}
FROM pp JOIN cand c USING (text_id) WHERE pp.seed = 42 AND pp.fold = 2""")
def pseudo_read(spark, sf_dir):
    from foldwise.plans.jobs import read_pseudo, write_pseudo_tables
    from foldwise.session import shared_path
    root = shared_path(spark, "processed")
    write_pseudo_tables(spark, FX.labelled_essays(spark, sf_dir), FX.corpus(spark, sf_dir), root)
    r = round_doubles(read_pseudo(spark, root, seed=42, fold=2))
    return r.select("text_id", F.md5("full_text").alias("full_text_md5"), *T6)


@register("pseudo_split", f"""WITH {_CORPUS_SQL},
r AS (SELECT text_id, row_number() OVER (ORDER BY md5('42:split:' || text_id), text_id) - 1 AS pos,
             count(*) OVER () AS n FROM cand)
SELECT text_id, CASE WHEN pos < ceil(n * 0.2) THEN 'valid' ELSE 'train' END AS split FROM r
""")
def pseudo_split(spark, sf_dir):
    from foldwise.operators.splits import random_split
    from foldwise.session import materialize
    ids = materialize(_candidates(spark, sf_dir).select("text_id"), "pseudo-ids")  # read once per round
    return random_split(ids, seed=42, test_fraction=0.2)


# --- S1: CSV edge -----------------------------------------------------------------
@register("csv_roundtrip", f"""
WITH {S.ESSAYS} SELECT text_id, md5(full_text) AS full_text_md5, CAST(length(full_text) AS INTEGER) AS n_chars, {T6_SQL} FROM essays
""")
def csv_roundtrip(spark, sf_dir):
    from foldwise.session import shared_path
    from foldwise.sources.csv import read_train, write_csv
    path = shared_path(spark, "raw_train_csv")
    write_csv(FX.essays(spark, sf_dir).select("text_id", "full_text", *T6), path)
    back = read_train(spark, path)
    return back.select("text_id", F.md5("full_text").alias("full_text_md5"), F.length("full_text").alias("n_chars"), *T6)


# --- K1 / S2: dataset bundle --------------------------------------------------------
def _bundle(spark, sf_dir):
    from foldwise.plans.jobs import build_dataset_bundle
    from foldwise.session import shared_path
    root = shared_path(spark, "processed")
    build_dataset_bundle(FX.essays(spark, sf_dir).select("text_id", "full_text", *T6),
                         FX.test_texts(spark, sf_dir).select("text_id", "full_text"),
                         FX.submission_template(spark, sf_dir), root, data_version="vanilla")
    return root


@register("dataset_bundle", f"""
WITH {S.ESSAYS}, {S.TEST}, s AS {S.seeds_sql()}
SELECT 'train' AS table_name, seed, count(*) AS n_rows FROM essays CROSS JOIN s GROUP BY seed
UNION ALL SELECT 'test', CAST(NULL AS INTEGER), count(*) FROM test
UNION ALL SELECT 'sample_submission', CAST(NULL AS INTEGER), count(*) FROM test
UNION ALL SELECT 'sample_oof', CAST(NULL AS INTEGER), count(*) FROM essays
""")
def dataset_bundle(spark, sf_dir):
    from foldwise.sources.processed import BUNDLE_TABLES, read_table
    root = _bundle(spark, sf_dir)
    parts = []
    for t in BUNDLE_TABLES:
        df = read_table(spark, root, t, "vanilla")
        seed = F.col("seed") if "seed" in df.columns else F.lit(None).cast("int")
        parts.append(df.groupBy(seed.alias("seed")).agg(F.count(F.lit(1)).alias("n_rows"))
                       .select(F.lit(t).alias("table_name"), "seed", "n_rows"))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


@register("processed_read", f"""
WITH {S.ESSAYS}, {S.folds_cte(seeds=[43])}
SELECT e.text_id, f.fold, {", ".join("e." + t for t in T6)} FROM essays e JOIN folds f USING (text_id) WHERE f.fold <> 0
""")
def processed_read(spark, sf_dir):
    from foldwise.sources.processed import train
    root = _bundle(spark, sf_dir)
    return train(spark, root, "vanilla", 43).where(~F.col("fold").eqNullSafe(0)).select("text_id", "fold", *T6)


# --- S4 / P8: text corpus -------------------------------------------------------------
@register("text_corpus_scan", f"""
SELECT CAST(item_id AS VARCHAR) AS text_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS full_text,
  {", ".join(f"CAST(NULL AS DOUBLE) AS {t}" for t in T6)} FROM benchmark
""")
def text_corpus_scan(spark, sf_dir):
    from foldwise.session import shared_path
    from foldwise.sources.corpus import read_text_corpus, write_text_files
    path = shared_path(spark, "corpus")
    write_text_files(FX.table(spark, sf_dir, "benchmark"), path, "item_id", "text")
    return read_text_corpus(spark, path)


# ---------------------------------------------------------------------------
# Ridge fold models (rows-only checks; exactness is tested against a direct
# numpy solve on a small fixture in tests/test_ridge.py)
# ---------------------------------------------------------------------------
def _cfg():
    from foldwise.config import RunConfig
    return RunConfig(run_name="ridge", loss="squared")


@register("cv_fit")
def cv_fit(spark, sf_dir):
    from foldwise.operators import ridge
    from foldwise.plans.jobs import _featurized_folds
    cfg = _cfg()
    coefs = ridge.fit_fold_models(spark, _featurized_folds(spark, FX.essays(spark, sf_dir), cfg), cfg)
    return ridge.coefficients_frame(spark, coefs)


@register("cv_oof")
def cv_oof(spark, sf_dir):
    from foldwise.plans.jobs import run_experiment
    return run_experiment(spark, FX.essays(spark, sf_dir), _cfg())[1]


@register("experiment_run")
def experiment_run(spark, sf_dir):
    from foldwise.plans.jobs import run_experiment
    return run_experiment(spark, FX.essays(spark, sf_dir), _cfg())[3]


@register("test_ensemble")
def test_ensemble(spark, sf_dir):
    from foldwise.operators import ridge
    from foldwise.plans.jobs import _featurized_folds, inference
    cfg = replace(_cfg(), seeds=(42,))  # the submission's seed
    coefs = ridge.fit_fold_models(spark, _featurized_folds(spark, FX.essays(spark, sf_dir), cfg), cfg)
    return inference(spark, FX.test_texts(spark, sf_dir).select("text_id", "full_text"), coefs,
                     FX.submission_template(spark, sf_dir), cfg=cfg, seed=42)


@register("pseudo_label")
def pseudo_label(spark, sf_dir):
    from foldwise.plans.jobs import pseudo_label_tables
    return pseudo_label_tables(spark, FX.labelled_essays(spark, sf_dir), FX.corpus(spark, sf_dir), model="ridge",
                               cfg=_cfg())


@register("pretrain_finetune")
def pretrain_finetune_q(spark, sf_dir):
    from foldwise.plans.jobs import pretrain_finetune
    return pretrain_finetune(spark, FX.labelled_essays(spark, sf_dir), FX.corpus(spark, sf_dir), _cfg())[2]



# --- A4 per validation pass, A13 on it ---------------------------------------------
def _validation_scores(spark, sf_dir):
    """MCRMSE of every validation pass (seed, fold, step) over all rows of the pass."""
    folded = _folded(spark, sf_dir, materialized=True)
    steps = F.explode(F.array(*[F.lit(st) for st in FX.VALIDATION_STEPS])).alias("step")
    preds = folded.select("seed", "text_id", "fold", "doc_id", "n_chars", steps)
    preds = preds.select("seed", "text_id", "fold", "step", *FX.pass_prediction_cols("fold", "step"))
    labels = folded.select("seed", "text_id", "fold", *T6)
    scored = M.align(labels, preds, ["seed", "text_id", "fold"], carry=["step"])
    return M.mcrmse(scored, ["seed", "fold", "step"])


_PASS_SQL = OOF_SQL + f""",
st AS (SELECT CAST(unnest([{", ".join(str(x) for x in FX.VALIDATION_STEPS)}]) AS INTEGER) AS step),
pp AS (SELECT fe.seed, fe.fold, st.step, {', '.join(f'fe.{t} AS y_{t}' for t in T6)}, {S.pass_pred_sql('fe.fold', 'st.step', prefix='p_')}
       FROM fe CROSS JOIN st),
vs AS (SELECT seed, fold, step, {", ".join(f"sqrt(avg((p_{t} - y_{t}) * (p_{t} - y_{t}))) AS {t}" for t in T6)} FROM pp GROUP BY seed, fold, step)"""


@register("validation_mcrmse", _PASS_SQL + f"""
SELECT seed, fold, step, round(({" + ".join(T6)}) / 6, 6) AS mcrmse, {", ".join(f"round({t}, 6) AS {t}" for t in T6)} FROM vs
""")
def validation_mcrmse(spark, sf_dir):
    return round_doubles(_validation_scores(spark, sf_dir))


@register("best_validation_step", _PASS_SQL + f"""
SELECT seed, fold, step AS best_step, round(m, 6) AS best_value FROM (
  SELECT seed, fold, step, ({" + ".join(T6)}) / 6 AS m,
         row_number() OVER (PARTITION BY seed, fold ORDER BY ({" + ".join(T6)}) / 6, step) AS rn FROM vs) WHERE rn = 1
""")
def best_validation_step(spark, sf_dir):
    log = _validation_scores(spark, sf_dir).select("seed", "fold", "step", F.col("mcrmse").alias("val_mcrmse"))
    return round_doubles(M.best_step(log))


# --- X6 + X7: one head per target slot (position-slice variant) ---------------------
@register("slot_heads", f"""WITH {_EMB_SQL}
SELECT doc, {", ".join(f"round(sum(CASE WHEN pos = {i + 1} THEN v * {_W_SQL.format(i=i)} END) + 3.0, 6) AS {t}" for i, t in enumerate(T6))}
FROM x WHERE pos BETWEEN 1 AND 6 GROUP BY doc
""")
def slot_heads_q(spark, sf_dir):
    from foldwise.operators.pooling import slot_heads, slot_vectors
    sliced = slot_vectors(FX.token_embeddings(spark, sf_dir))
    return round_doubles(slot_heads(sliced, FX.head_weights(spark, FX.embedding_dim(spark, sf_dir)), FX.HEAD_BIAS))


# --- S4 + J1 incrementally (Structured Streaming, availableNow) -----------------------
@register("pseudo_base_stream", f"WITH {_CORPUS_SQL} SELECT text_id, md5(full_text) AS full_text_md5 FROM cand")
def pseudo_base_stream(spark, sf_dir):
    from foldwise.session import shared_path
    from foldwise.sources.corpus import pack_texts
    from foldwise.streaming.corpus_stream import start_pseudo_base
    folder = shared_path(spark, "corpus_files")
    pack_texts(FX.corpus(spark, sf_dir), folder, "text_id", "full_text")
    out = shared_path(spark, "pseudo_base_stream")
    q = start_pseudo_base(spark, folder, FX.labelled_essays(spark, sf_dir).select("text_id"), out, once=True, packed=True)
    q.awaitTermination()
    return spark.read.parquet(out).select("text_id", F.md5("full_text").alias("full_text_md5"))


# --- M1-M8, G3, K6, A13 on one feature, with SQL -------------------------------------
from foldwise.plans import length_queries

QUERIES |= length_queries.QUERIES
ORACLES |= length_queries.SQL
