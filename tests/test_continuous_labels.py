"""Targets with as many values as rows: bins from sketches, sparse labels."""

import numpy as np
from pyspark.sql import functions as F

from foldwise.operators.folds import assign_folds, label_dictionary, quantile_bounds, quantile_key, sparse_labels

TWO = ["u", "v"]


def measured(spark, n=3000, parts=4):
    df = spark.range(n).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text_id"),
                               (F.rand(3) * 10).alias("u"), (F.randn(4) * F.randn(5)).alias("v"))
    return df.repartition(parts)


def written(spark, df):
    from foldwise.session import materialize
    return materialize(df)


def test_bounds_are_quantiles(spark):
    df = written(spark, measured(spark))
    bounds = quantile_bounds(df, TWO, 8)
    pdf = df.toPandas()
    for t in TWO:
        want = np.quantile(pdf[t], np.arange(1, 8) / 8)
        rank = np.searchsorted(np.sort(pdf[t].to_numpy()), bounds[t]) / len(pdf)
        assert len(bounds[t]) == 7 and np.abs(rank - np.arange(1, 8) / 8).max() < 0.002 and np.allclose(bounds[t], want, atol=0.2)
    keys = df.select(quantile_key("u", bounds["u"]).alias("k")).toPandas().k
    assert keys.nunique() == 8 and (keys == np.searchsorted(bounds["u"], pdf.u, side="left")).all()


def test_unique_labels_fold_evenly_and_without_a_label_window(spark):
    df = written(spark, measured(spark))
    out = assign_folds(df, (42, 43), targets=TWO, quantile_bins=16)
    pdf = out.toPandas()
    assert len(pdf) == 6000 and not pdf.duplicated(["seed", "text_id"]).any()
    for _, g in pdf.groupby("seed"):
        sizes = g.fold.value_counts()
        assert len(sizes) == 5 and sizes.max() - sizes.min() <= 1
        for t in TWO:
            bins = np.searchsorted(np.quantile(g[t], np.arange(1, 16) / 16), g[t])
            held = np.array([[((bins == b) & (g.fold == f)).sum() for f in range(5)] for b in range(16)])
            assert np.abs(held - held.mean(axis=1, keepdims=True)).max() < 15  # of 37.5
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert len(windows) == 1 and "_pid" in windows[0] and "_k0" not in windows[0]
    again = assign_folds(df.repartition(7), (42, 43), targets=TWO, quantile_bins=16).toPandas()
    key = ["seed", "text_id"]
    assert (again.sort_values(key).fold.to_numpy() == pdf.sort_values(key).fold.to_numpy()).all()


def test_null_values_and_ids_and_empty_tables(spark):
    df = written(spark, measured(spark, 60).withColumn("u", F.when(F.col("u") > 9, None).otherwise(F.col("u")))
                 .withColumn("text_id", F.when(F.col("text_id").isin("t1", "t2"), None).otherwise(F.col("text_id"))))
    assert assign_folds(df, (42,), targets=TWO, quantile_bins=4).count() == 60
    assert assign_folds(df.limit(0), (42,), targets=TWO, quantile_bins=4).count() == 0
    assert sparse_labels(df.limit(0), TWO).count() == 0


def test_sparse_labels_of_many_values(spark):
    df = written(spark, measured(spark, 2500).withColumn("u", F.when(F.rand(9) < 0.4, F.lit(5.0)).when(F.rand(8) < 0.05, None)
                                                  .otherwise(F.round("u", 3))))
    pdf = df.toPandas()
    assert pdf.u.nunique() > 1000
    got = {r["text_id"]: r["labels"] for r in sparse_labels(df, TWO).collect()}
    assert len(got) == 2500
    for i, t in enumerate(TWO):
        counts = pdf[t].value_counts()
        order = sorted(counts.index, key=lambda v: (-counts[v], v))
        place = {v: p for p, v in enumerate(order)}
        assert all(got[k][i] == (None if np.isnan(v) else place[v]) for k, v in zip(pdf.text_id, pdf[t]))
    assert {r["place"] for r in label_dictionary(df, TWO).where("target = 'u' and value = 5.0").collect()} == {0}
