"""Fits, runs and pretraining on one feature, with SQL for every step.

With one feature (the logarithm of 1 + the words of a text) a fold model has
two coefficients per target, so SQL can solve its normal equations from sums.
The jobs are those of the wide models (``cv_fit`` ... ``pretrain_finetune``)
with another ``n_features``; the SQL rebuilds folds, fits, iterations, scores
and choices independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.config import LOSSES, N_FOLDS, SMOOTH_L1_WEIGHTS, TARGETS, RunConfig
from foldwise.operators import metrics as M
from foldwise.plans import fixtures as FX
from foldwise.plans import sqlparts as S

STEPS = 4          # iterations of every fit here (no tolerance ends it earlier)
RIDGE = 1.0
PENALTIES = (0.1, 1.0, 10.0, 100.0)
PRIOR_WEIGHTS = (1.0, 10.0, 100.0, 1000.0)


def config(loss: str = "squared", seeds=(42, 43, 44)) -> RunConfig:
    return RunConfig(run_name=f"length_{loss}", n_features=1, loss=loss, seeds=seeds, ridge_lambda=RIDGE,
                     max_steps=STEPS, tolerance=-1.0, penalties=PENALTIES, prior_weights=PRIOR_WEIGHTS)


# --- SQL ---------------------------------------------------------------------
T6 = list(TARGETS)
X = r"CAST(CAST(ln(1 + len(regexp_extract_all(lower(coalesce(full_text, '')), '[\p{L}\p{N}_]+'))) AS FLOAT) AS DOUBLE) AS x"
GRID = (f"grid AS (SELECT s.seed, CAST(k.fold AS INTEGER) AS fold FROM {S.seeds_sql()} s "
        f"CROSS JOIN (SELECT unnest(range({N_FOLDS})) AS fold) k)")
TARGET_WEIGHT = "CASE target " + " ".join(f"WHEN '{t}' THEN {w!r}" for t, w in zip(T6, SMOOTH_L1_WEIGHTS)) + " END"
WEIGHT = {"squared": "1.0", "smooth_l1": "CASE WHEN abs(r) < 1 THEN 1.0 ELSE 1 / abs(r) END",
          "weighted_smooth_l1": f"{TARGET_WEIGHT} * CASE WHEN abs(r) < 1 THEN 1.0 ELSE 1 / abs(r) END",
          "rmse_loss": "1 / sqrt(r * r + 1e-9)"}
VALUE = {"squared": "0.5 * r * r", "smooth_l1": "CASE WHEN abs(r) < 1 THEN 0.5 * r * r ELSE abs(r) - 0.5 END"}


def _solve(n: str, sx: str, sxx: str, sy: str, sxy: str) -> str:
    det = f"(({n}) * ({sxx}) - ({sx}) * ({sx}))"
    return f"(({sy}) * ({sxx}) - ({sx}) * ({sxy})) / {det} AS b0, (({n}) * ({sxy}) - ({sx}) * ({sy})) / {det} AS b1"


def squared_sql(source: str = "essays") -> str:
    """rows (seed, fold, text_id, x, target, y), sums per fold, coefficients c0."""
    cols = ", ".join(f"e.{t}" for t in T6)
    return f"""{S.folds_cte(source=source)}, {GRID},
wide AS (SELECT f.seed, f.fold, e.text_id, e.x, {cols} FROM folds f JOIN (SELECT *, {X} FROM {source}) e USING (text_id)),
lr AS MATERIALIZED (SELECT seed, fold, text_id, x, target, y FROM (UNPIVOT wide ON {", ".join(T6)} INTO NAME target VALUE y)),
st AS MATERIALIZED (SELECT seed, fold, target, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy,
                    sum(x * y) AS sxy, sum(y * y) AS syy FROM lr GROUP BY ALL),
tr AS MATERIALIZED (SELECT g.seed, g.fold, target, sum(n) AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy
       FROM grid g JOIN st ON st.seed = g.seed AND st.fold <> g.fold GROUP BY g.seed, g.fold, target),
c0 AS MATERIALIZED (SELECT seed, fold, target, {_solve("n", "sx", f"sxx + {RIDGE}", "sy", "sxy")} FROM tr)"""


def steps_sql(loss: str, prefix: str = "") -> str:
    """Coefficients ``<prefix>c0`` ... of every step, sums of every pass."""
    out, before = [], "c0"
    for k in range(STEPS):
        out.append(f"""{prefix}s{k} AS MATERIALIZED (SELECT seed, fold, target, sum(w) AS sw, sum(w * x) AS sx, sum(w * x * x) AS sxx,
 sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(v) AS v, count(*) AS n FROM (
  SELECT *, {WEIGHT[loss]} AS w, {VALUE.get(loss, "0.0")} AS v FROM (
   SELECT c.seed, c.fold, c.target, x, y, y - b0 - b1 * x AS r FROM {before} c
   JOIN lr ON lr.seed = c.seed AND lr.fold <> c.fold AND lr.target = c.target)) GROUP BY seed, fold, target)""")
        if k + 1 < STEPS:
            before = f"{prefix}c{k + 1}"
            out.append(f"""{before} AS MATERIALIZED (SELECT seed, fold, target,
 {_solve("sw", "sx", f"sxx + {RIDGE}", "sy", "sxy")} FROM {prefix}s{k})""")
    return ",\n".join(out)


def log_sql(loss: str) -> str:
    """The whole log of a run: steps of every fold, OOF scores, their means."""
    steps = ["c0"] + ([f"c{k}" for k in range(1, STEPS)] if loss != "squared" else [])
    tensor = " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, * FROM {c}" for k, c in enumerate(steps))
    train = "" if loss == "squared" else "UNION ALL " + " UNION ALL ".join(
        f"SELECT seed, fold, CAST({k} AS INTEGER) AS step, 'train_loss' AS metric, sum(v) / sum(n) AS value FROM s{k} GROUP BY seed, fold"
        for k in range(STEPS))
    mine = "" if loss == "squared" else steps_sql(loss) + ","
    return f"""WITH {S.ESSAYS}, {squared_sql()}, {mine}
tensor AS MATERIALIZED ({tensor}),
res AS MATERIALIZED (SELECT t.seed, t.fold, t.step, t.target, y - b0 - b1 * x AS r FROM tensor t
                     JOIN lr ON lr.seed = t.seed AND lr.fold = t.fold AND lr.target = t.target),
per AS (SELECT seed, fold, step, target, sqrt(avg(r * r)) AS rmse, sum({VALUE.get(loss)}) AS v, count(*) AS n FROM res GROUP BY ALL),
sc AS MATERIALIZED (SELECT seed, fold, step, avg(rmse) AS val_mcrmse, sum(v) / sum(n) AS val_loss FROM per GROUP BY ALL),
pick AS (SELECT seed, fold, arg_min(step, val_mcrmse) AS step FROM sc GROUP BY ALL),
oof AS (SELECT seed, target, sqrt(avg(r * r)) AS value FROM res JOIN pick USING (seed, fold, step) GROUP BY ALL),
per_seed AS (SELECT seed, target AS metric, value FROM oof UNION ALL SELECT seed, 'oof_score', avg(value) FROM oof GROUP BY seed),
log AS (SELECT seed, fold, step, 'val_mcrmse' AS metric, val_mcrmse AS value FROM sc
 UNION ALL SELECT seed, fold, step, 'val_loss', val_loss FROM sc
 UNION ALL SELECT seed, fold, step, 'val_' || target, rmse FROM per {train}
 UNION ALL SELECT seed, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), metric, value FROM per_seed
 UNION ALL SELECT CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), metric || '_seed_mean', avg(value)
           FROM per_seed GROUP BY metric)
"""


LOG_SELECT = "SELECT '{run}' AS run, seed, fold, step, metric, round(value, 6) AS value FROM log"


def _wide(expr: str) -> str:
    return ", ".join(f"round(max(CASE WHEN target = '{t}' THEN {expr} END), 6) AS {t}" for t in T6)


CORPUS = f"""{S.ESSAYS}, labelled AS (SELECT e.* FROM essays e SEMI JOIN labels USING (doc_id)),
cand AS (SELECT c.text_id, c.full_text FROM essays c ANTI JOIN labelled USING (text_id))"""

FIT_SQL = f"""WITH {S.ESSAYS}, {squared_sql()},
{", ".join(steps_sql(loss, loss + "_") for loss in LOSSES if loss != "squared")},
fits AS ({" UNION ALL ".join(f"SELECT '{loss}' AS loss, * FROM {'c0' if loss == 'squared' else f'{loss}_c{STEPS - 1}'}" for loss in LOSSES)})
SELECT loss, seed, fold, CAST(0 AS INTEGER) AS feature, target, round(b0, 6) AS coef FROM fits
UNION ALL SELECT loss, seed, fold, CAST(1 AS INTEGER), target, round(b1, 6) FROM fits"""

_LISTED = ", ".join(map(str, PENALTIES)), ", ".join(map(str, PRIOR_WEIGHTS))
PATH_SQL = f"""WITH {CORPUS}, {squared_sql("labelled")},
base AS MATERIALIZED (SELECT s.seed, c.text_id, x, row_number() OVER (PARTITION BY s.seed ORDER BY
   md5(CAST(s.seed AS VARCHAR) || ':split:' || c.text_id), c.text_id) - 1 < ceil(count(*) OVER (PARTITION BY s.seed) * 0.2) AS valid
   FROM (SELECT *, {X} FROM cand) c CROSS JOIN {S.seeds_sql()} s),
bs AS (SELECT seed, valid, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM base GROUP BY ALL),
pre AS (SELECT c.seed, c.fold, c.target, w, c.b0 + (c.b1 - p1) * t.sx / t.n AS p0, p1, c.b0 AS a0, c.b1 AS a1
  FROM (SELECT c.*, w, (t.sxx - t.sx * t.sx / t.n) * b1 / (t.sxx - t.sx * t.sx / t.n + w) AS p1
        FROM c0 c JOIN bs t ON t.seed = c.seed AND NOT t.valid CROSS JOIN (SELECT unnest([{_LISTED[0]}])::DOUBLE AS w)) c
  JOIN bs t ON t.seed = c.seed AND NOT t.valid),
pe AS (SELECT seed, fold, w, avg(sqrt(greatest(0, (d0 * d0 * n + 2 * d0 * d1 * sx + d1 * d1 * sxx) / n))) AS error
  FROM (SELECT pre.*, a0 - p0 AS d0, a1 - p1 AS d1, v.n, v.sx, v.sxx FROM pre JOIN bs v ON v.seed = pre.seed AND v.valid) GROUP BY ALL),
pp AS (SELECT seed, fold, arg_min(w, error) AS w FROM pe GROUP BY ALL),
prior AS (SELECT pre.seed, pre.fold, target, p0, p1 FROM pre JOIN pp USING (seed, fold, w)),
ft AS MATERIALIZED (SELECT tr.seed, tr.fold, tr.target, w, {_solve("n + w", "sx", f"sxx + {RIDGE} + w", "sy + w * p0", "sxy + w * p1")}
  FROM tr JOIN prior USING (seed, fold, target) CROSS JOIN (SELECT unnest([{_LISTED[1]}])::DOUBLE AS w)),
fe AS (SELECT seed, fold, w, avg(sqrt((syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx) / n)) AS error
  FROM ft JOIN st USING (seed, fold, target) GROUP BY ALL),
fp AS (SELECT seed, fold, arg_min(w, error) AS w FROM fe GROUP BY ALL)
"""

SQL = {
    "length_fit": FIT_SQL,
    "run_log": log_sql("smooth_l1") + LOG_SELECT.format(run="length_smooth_l1"),
    "run_best_step": log_sql("smooth_l1") + """SELECT seed, fold, arg_min(step, val_mcrmse) AS best_step,
  round(min(val_mcrmse), 6) AS best_value FROM sc GROUP BY seed, fold""",
    "length_run": log_sql("squared") + LOG_SELECT.format(run="length_squared"),
    "length_oof": f"""WITH {S.ESSAYS}, {squared_sql()} SELECT lr.seed, lr.text_id, lr.fold, {_wide("b0 + b1 * x")}
  FROM lr JOIN c0 USING (seed, fold, target) GROUP BY lr.seed, lr.text_id, lr.fold""",
    "length_ensemble": f"""WITH {S.ESSAYS}, {S.TEST}, {squared_sql()}, m AS (SELECT target, avg(b0) AS b0, avg(b1) AS b1 FROM c0
  WHERE seed = 42 GROUP BY target) SELECT text_id, {_wide("b0 + b1 * x")} FROM (SELECT text_id, {X} FROM test), m GROUP BY text_id""",
    "length_pseudo": f"""WITH {CORPUS}, {squared_sql("labelled")} SELECT seed, fold, text_id, {_wide("b0 + b1 * x")}
  FROM (SELECT text_id, {X} FROM cand), c0 GROUP BY seed, fold, text_id""",
    "pretrain_path": PATH_SQL + """SELECT e.seed, e.fold, 'pretrain' AS stage, e.w AS weight, round(error, 6) AS error, e.w = p.w AS chosen
  FROM pe e JOIN pp p USING (seed, fold)
  UNION ALL SELECT e.seed, e.fold, 'finetune', e.w, round(error, 6), e.w = p.w FROM fe e JOIN fp p USING (seed, fold)""",
    "length_pretrain": PATH_SQL + f""", res AS (SELECT seed, target, sqrt(avg((y - b0 - b1 * x) * (y - b0 - b1 * x))) AS v FROM lr
  JOIN ft USING (seed, fold, target) JOIN fp USING (seed, fold, w) GROUP BY seed, target)
  SELECT seed, round(avg(v), 6) AS mcrmse, {", ".join(f"round(max(CASE WHEN target = '{t}' THEN v END), 6) AS {t}" for t in T6)}
  FROM res GROUP BY seed""",
}


# --- queries -----------------------------------------------------------------
def length_fit(spark, sf_dir):
    """Coefficients of every loss after the same number of steps."""
    from foldwise.operators import ridge, robust
    from foldwise.plans.jobs import _featurized_folds
    folded = _featurized_folds(spark, FX.essays(spark, sf_dir), config())
    start, parts = ridge.fit_fold_models(spark, folded, config()), []
    for loss in LOSSES:
        coefs = start if loss == "squared" else robust.fit_steps(folded, config(loss), start)[-1][0]
        frame = ridge.coefficients_frame(spark, coefs)
        parts.append(frame.select(F.lit(loss).alias("loss"), "seed", "fold", "feature", "target", F.round("coef", 6).alias("coef")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _logged(spark, sf_dir, loss):
    """A run's log, appended to the stored run log and read back."""
    from foldwise.plans.jobs import run_experiment
    from foldwise.session import shared_path
    from foldwise.sources.processed import append_metrics, read_metrics
    cfg, root = config(loss), shared_path(spark, "runs")
    append_metrics(run_experiment(spark, FX.essays(spark, sf_dir), cfg)[3], root)
    return read_metrics(spark, root, cfg.run_name).select("run", "seed", "fold", "step", "metric", "value")


def run_log(spark, sf_dir):
    return _logged(spark, sf_dir, "smooth_l1").withColumn("value", F.round("value", 6))


def run_best_step(spark, sf_dir):
    """The checkpoint of every fold: the step of the run log with the least score."""
    log = _logged(spark, sf_dir, "smooth_l1").where((F.col("metric") == "val_mcrmse") & F.col("step").isNotNull())
    best = M.best_step(log.select("seed", "fold", "step", F.col("value").alias("val_mcrmse")))
    return best.withColumn("best_value", F.round("best_value", 6))


def length_run(spark, sf_dir):
    return _logged(spark, sf_dir, "squared").withColumn("value", F.round("value", 6))


def _rounded(df):
    return df.withColumns({t: F.round(t, 6) for t in T6})


def length_oof(spark, sf_dir):
    from foldwise.plans.jobs import run_experiment
    return _rounded(run_experiment(spark, FX.essays(spark, sf_dir), config())[1])


def length_ensemble(spark, sf_dir):
    from foldwise.operators import ridge
    from foldwise.plans.jobs import _featurized_folds, inference
    cfg = config(seeds=(42,))
    coefs = ridge.fit_fold_models(spark, _featurized_folds(spark, FX.essays(spark, sf_dir), cfg), cfg)
    return _rounded(inference(spark, FX.test_texts(spark, sf_dir).select("text_id", "full_text"), coefs,
                              FX.submission_template(spark, sf_dir), cfg=cfg, seed=42))


def length_pseudo(spark, sf_dir):
    from foldwise.plans.jobs import pseudo_label_tables
    return _rounded(pseudo_label_tables(spark, FX.labelled_essays(spark, sf_dir), FX.corpus(spark, sf_dir), model="ridge",
                                        cfg=config()))


def pretrain_path(spark, sf_dir):
    from foldwise.plans import jobs
    out = jobs.pretrain_path(spark, FX.labelled_essays(spark, sf_dir), FX.corpus(spark, sf_dir), config())
    return out.withColumn("error", F.round("error", 6))


def length_pretrain(spark, sf_dir):
    from foldwise.plans.jobs import pretrain_finetune
    scores = pretrain_finetune(spark, FX.labelled_essays(spark, sf_dir), FX.corpus(spark, sf_dir), config())[2]
    return _rounded(scores).withColumn("mcrmse", F.round("mcrmse", 6))


QUERIES = {f.__name__: f for f in (length_fit, run_log, run_best_step, length_run, length_oof, length_ensemble, length_pseudo,
                                   pretrain_path, length_pretrain)}
