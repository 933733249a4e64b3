"""DuckDB-dialect building blocks for the oracle SQL of each registered query.

They rebuild the fixtures of ``fixtures.py`` from the same parquet views with
independent SQL (global windows are fine here: the oracle runs on one node
at small scale).
"""

from __future__ import annotations

from foldwise.config import N_FOLDS, SEEDS, TARGETS
from foldwise.plans.fixtures import SCORE_COEFFICIENTS, TOKEN_MASK_MODULUS


def score_sql(t: str) -> str:
    a, b, c = SCORE_COEFFICIENTS[t]
    return f"CAST(2 + (((doc_id * {a} + n_chars * {b}) // {c}) % 9) AS DOUBLE) / 2"


def scores_sql() -> str:
    return ", ".join(f"{score_sql(t)} AS {t}" for t in TARGETS)


ESSAYS = (f"essays AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS text_id, doc_id, n_chars, "
          f"text AS full_text, {scores_sql()} FROM documents)")
TEST = (f"test AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS text_id, doc_id, n_chars, text AS full_text "
        f"FROM documents)")


def pred_sql(fold_expr: str = "fold") -> str:
    parts = []
    for i, t in enumerate(TARGETS):
        parts.append(f"round({score_sql(t)} + CAST(0.1 AS DOUBLE) * "
                     f"CAST(((doc_id * {i + 2} + {fold_expr} * 3) % 7) - 3 AS DOUBLE), 6) AS {t}")
    return ", ".join(parts)


def seeds_sql(seeds=SEEDS) -> str:
    return "(SELECT unnest([" + ", ".join(str(int(s)) for s in seeds) + "]) AS seed)"


def folds_cte(source: str = "essays", seeds=SEEDS, n_folds: int = N_FOLDS, name: str = "folds") -> str:
    """(seed, text_id, fold) by the rank + seeded block rotation design."""
    order = ", ".join(f"e.{t} NULLS FIRST" for t in TARGETS)
    return (
        f"{name} AS (SELECT seed, text_id, CAST((r + ('0x' || substr(md5(CAST(seed AS VARCHAR) || ':blk:' || "
        f"CAST(r // {n_folds} AS VARCHAR)), 1, 8))::BIGINT) % {n_folds} AS INTEGER) AS fold "
        f"FROM (SELECT s.seed, e.text_id, row_number() OVER (PARTITION BY s.seed ORDER BY {order}, "
        f"md5(CAST(s.seed AS VARCHAR) || ':' || e.text_id), e.text_id) - 1 AS r "
        f"FROM {source} e CROSS JOIN {seeds_sql(seeds)} s))")


def rounded(cols, nd: int = 6) -> str:
    return ", ".join(f"round({c}, {nd}) AS {c}" for c in cols)


def mcrmse_select(pred_alias: str = "p", label_alias: str = "e", group: str = "", nd: int | None = 6) -> str:
    """SELECT list computing the six RMSEs + mean (needs GROUP BY by caller)."""
    rm = [f"sqrt(avg(({pred_alias}.{t} - {label_alias}.{t}) * ({pred_alias}.{t} - {label_alias}.{t})))" for t in TARGETS]
    mean = "(" + " + ".join(rm) + f") / {len(TARGETS)}"
    r = (lambda x: f"round({x}, {nd})") if nd is not None else (lambda x: x)
    cols = [f"{r(mean)} AS mcrmse"] + [f"{r(x)} AS {t}" for x, t in zip(rm, TARGETS)]
    return (group + ", " if group else "") + ", ".join(cols)


TOKEN_MASK_MOD = TOKEN_MASK_MODULUS


def pass_pred_sql(fold_expr: str = "fold", step_expr: str = "step", prefix: str = "") -> str:
    parts = []
    for i, t in enumerate(TARGETS):
        parts.append(f"round({score_sql(t)} + CAST(0.1 AS DOUBLE) * "
                     f"CAST(((doc_id * {i + 2} + {fold_expr} * 3 + {step_expr} // 125) % 7) - 3 AS DOUBLE), 6) AS {prefix}{t}")
    return ", ".join(parts)
