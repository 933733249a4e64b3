"""Properties of the stratified fold assignment (no reference folds to compare:
the assignment is ours, so balance and determinism are what is checked)."""

import collections
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.config import TARGETS
from foldwise.operators.folds import assign_folds, fold_balance, one_hot_labels
from foldwise.plans import fixtures as FX
from tests.conftest import SF01


def _essays(spark):
    return FX.essays(spark, SF01, with_text=False).select("text_id", *TARGETS)


def _folds(df, **kw):
    return {(r.seed, r.text_id): r.fold for r in assign_folds(df, **kw).select("seed", "text_id", "fold").collect()}


def test_every_row_exactly_one_fold_and_sizes_within_one(spark):
    e = _essays(spark)
    f = assign_folds(e, seeds=[42, 43, 44])
    pdf = f.select("seed", "text_id", "fold").toPandas()
    assert len(pdf) == 3 * e.count()
    assert not pdf.duplicated(["seed", "text_id"]).any()
    assert set(pdf.fold) == set(range(5))
    sizes = pdf.groupby(["seed", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1


def test_independent_of_input_order_partitions_and_bucket_size(spark):
    e = _essays(spark)
    base = _folds(e, seeds=[42, 43])
    assert _folds(e.repartition(7, "cohesion").orderBy(F.rand(1)), seeds=[42, 43]) == base
    assert _folds(e.coalesce(1), seeds=[42, 43]) == base
    assert _folds(e, seeds=[42, 43], bucket_hex_digits=1) == base
    assert _folds(e, seeds=[42, 43], bucket_hex_digits=5) == base


def test_seeds_give_different_partitions(spark):
    e = _essays(spark)
    a = _folds(e, seeds=[42])
    b = _folds(e, seeds=[43])
    ids = sorted({k[1] for k in a})
    same_a = same_both = 0
    rnd = random.Random(0)
    for _ in range(20000):
        i, j = rnd.sample(ids, 2)
        if a[(42, i)] == a[(42, j)]:
            same_a += 1
            same_both += b[(43, i)] == b[(43, j)]
    assert 0.15 < same_both / same_a < 0.25


def test_balance_better_than_random(spark):
    e = _essays(spark)
    f = assign_folds(e, seeds=[42]).toPandas()
    n = len(f)

    def max_dev(folds):
        dev = 0.0
        for t in TARGETS:
            ct = pd.crosstab(f[t], folds)
            ideal = ct.sum(axis=1).to_numpy()[:, None] / 5
            dev += abs(ct.to_numpy() - ideal).mean()
        return dev / len(TARGETS)

    ours = max_dev(f.fold)
    rnd = sum(max_dev(pd.Series(random.Random(s).choices(range(5), k=n))) for s in range(5)) / 5
    assert ours < rnd


def test_hot_label_vector_is_split_and_balanced(spark):
    # one label vector holds 40% of the rows
    rows = [(f"h{i}", *[3.0] * 6) for i in range(4000)] + \
           [(f"r{i}", *[1.0 + 0.5 * ((i * (k + 3)) % 9) for k in range(6)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "text_id string, " + ", ".join(f"{t} double" for t in TARGETS))
    pdf = assign_folds(df, seeds=[42]).toPandas()
    hot = pdf[pdf.text_id.str.startswith("h")].fold.value_counts()
    assert hot.max() - hot.min() <= 1
    sizes = pdf.fold.value_counts()
    assert sizes.max() - sizes.min() <= 1


def test_null_targets_sort_first_and_are_assigned(spark):
    rows = [(f"n{i}", None, *[2.0] * 5) for i in range(7)] + [(f"v{i}", 1.0, *[2.0] * 5) for i in range(8)]
    df = spark.createDataFrame(rows, "text_id string, " + ", ".join(f"{t} double" for t in TARGETS))
    pdf = assign_folds(df, seeds=[42]).toPandas()
    assert len(pdf) == 15 and pdf.fold.notna().all()
    assert pdf.fold.value_counts().max() == 3


def test_fold_balance_counts_every_row_per_target(spark):
    e = _essays(spark)
    bal = fold_balance(assign_folds(e, seeds=[42])).toPandas()
    assert (bal.groupby("target").n_rows.sum() == e.count()).all()


def test_one_hot_has_column_per_value_and_null_is_zero(spark):
    rows = [("a", 1.0, 2.0, 3.0, 4.0, 5.0, 1.5), ("b", None, 2.0, 3.0, 4.0, 5.0, 2.5)]
    df = spark.createDataFrame(rows, "text_id string, " + ", ".join(f"{t} double" for t in TARGETS))
    oh = {r.text_id: r.asDict() for r in one_hot_labels(df).collect()}
    assert oh["a"]["cohesion_1_0"] == 1
    assert oh["b"]["cohesion_1_0"] == 0
    assert oh["a"]["conventions_1_5"] == 1 and oh["a"]["conventions_2_5"] == 0
    assert len(oh["a"]) == 1 + 1 + 1 + 1 + 1 + 1 + 2


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

_score = st.one_of(st.none(), st.sampled_from([1.0, 1.5, 2.0, 3.0, 4.5, 5.0]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[_score] * 6), min_size=1, max_size=60), st.integers(2, 6), st.integers(0, 999))
def test_folds_property_random_tables(spark, labels, k, seed):
    rows = [(f"id{i}", *lab) for i, lab in enumerate(labels)]
    df = spark.createDataFrame(rows, "text_id string, " + ", ".join(f"{t} double" for t in TARGETS))
    got = assign_folds(df, seeds=[seed], n_folds=k).select("text_id", "fold").toPandas()
    assert len(got) == len(rows) and got.text_id.is_unique
    sizes = got.fold.value_counts().reindex(range(k), fill_value=0)
    assert sizes.max() - sizes.min() <= 1 and got.fold.between(0, k - 1).all()
    again = assign_folds(df.repartition(3), seeds=[seed], n_folds=k, bucket_hex_digits=1).select("text_id", "fold").toPandas()
    assert dict(zip(got.text_id, got.fold)) == dict(zip(again.text_id, again.fold))


def test_continuous_targets_binned(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    vals = rng.uniform(1, 5, size=(3000, 6))
    rows = [(f"c{i}", *map(float, v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "text_id string, " + ", ".join(f"{t} double" for t in TARGETS))
    pdf = assign_folds(df, seeds=[42], bin_width=0.5).toPandas()
    sizes = pdf.fold.value_counts()
    assert sizes.max() - sizes.min() <= 1 and len(pdf) == 3000
    original = {f"c{i}": float(v[0]) for i, v in enumerate(vals)}
    assert all(original[i] == c for i, c in zip(pdf.text_id, pdf.cohesion))  # labels are not binned
    bins = (pdf.cohesion // 0.5)
    ct = pd.crosstab(bins, pdf.fold).to_numpy()
    assert (ct.max(axis=1) - ct.min(axis=1)).max() <= 3  # first target: near-perfect spread per bin
