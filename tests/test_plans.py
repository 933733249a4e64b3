"""Plan-shape checks: pruning, partition filters, no single-partition row stages."""

import pytest

import __spark_entry__ as E
from foldwise.plans import catalog
from foldwise.config import TARGETS
from foldwise.operators.folds import assign_folds
from foldwise.plans import fixtures as FX
from tests.conftest import SF001, SF01


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["mcrmse", "fold_mean_score", "oof_score_by_seed", "fold_balance",
                                  "stratified_folds", "smooth_l1"])
def test_metric_queries_never_read_text(spark, name):
    # a query may read a materialized (checkpointed) fold table instead of the
    # parquet scan; either way no text column may appear anywhere in the plan
    plan = _plan(E.queries()[name](spark, SF01))
    assert ",text:" not in plan and "<text:" not in plan and "full_text" not in plan


def test_fold_assignment_has_no_single_partition_exchange(spark):
    df = assign_folds(FX.essays(spark, SF01, with_text=False), seeds=[42, 43])
    plan = _plan(df)
    assert "SinglePartition" not in plan


def test_processed_read_prunes_partitions(spark):
    df = E.queries()["processed_read"](spark, SF001)
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(data_version" in plan or "PartitionFilters" in plan
    assert "seed" in plan and "fold" in plan


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 15 and df.columns == ["seed", "fold", "mcrmse", *TARGETS]


def test_every_query_has_an_oracle_or_is_model_based():
    assert set(E.oracle_sql()) <= set(E.queries())
    rows_only = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert rows_only == {"balanced_folds", "cv_fit", "cv_oof", "experiment_run", "test_ensemble", "pseudo_label", "pretrain_finetune"}


def test_head_per_group_limits_each_task_before_the_shuffle(spark):
    plan = _plan(E.queries()["head_per_fold"](spark, SF01))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_debug_head_is_a_top_k(spark):
    plan = _plan(E.queries()["debug_head"](spark, SF01))
    assert "TakeOrderedAndProject" in plan


def test_gram_partials_are_packed_per_task(spark):
    from foldwise.config import RunConfig
    from foldwise.operators import ridge
    from foldwise.plans.jobs import _featurized_folds
    cfg = RunConfig(n_features=16, seeds=(42,))
    ff = _featurized_folds(spark, FX.essays(spark, SF001), cfg)
    rows = ridge.gram_partials(ff).collect()
    m = 16 + 1 + 6
    n_chunks = -(-(m * (m + 1) // 2) // ridge.CHUNK)
    assert all(len(r.vals) == ridge.CHUNK for r in rows)
    assert len(rows) <= ff.rdd.getNumPartitions() * 5 * n_chunks
    sums = ridge.gram_tables(ff).collect()
    assert len(sums) == 5 * n_chunks and all(len(r.vals) == ridge.CHUNK for r in sums)


def _jobs_started(spark, build):
    """Jobs that building (not running) a DataFrame starts."""
    tracker, group = spark.sparkContext.statusTracker(), "built"
    spark.sparkContext.setJobGroup(group, group)
    build()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    return n


def test_building_features_and_tokens_starts_no_job(spark):
    from foldwise.operators import ridge, tokens
    essays = FX.essays(spark, SF001)
    joined = essays.select("text_id", "full_text").join(essays.select("text_id", "cohesion"), "text_id")
    assert _jobs_started(spark, lambda: ridge.featurize(joined, 16)) == 0
    assert _jobs_started(spark, lambda: tokens.tokenize(joined, 64)) == 0


def test_anti_join_reads_the_left_side_once_without_a_loop(spark):
    from foldwise.operators.joins import anti_join_null_safe
    left = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = _plan(anti_join_null_safe(left, left.select("doc_id").where("doc_id % 2 = 0"), "doc_id"))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_pseudo_split_has_no_product(spark):
    plan = _plan(E.queries()["pseudo_split"](spark, SF01))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_build_session_keeps_an_active_session_as_it_is(spark):
    from foldwise.session import build_session
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert build_session() is spark
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) in (None, "None")
