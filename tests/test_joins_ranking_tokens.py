import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.operators import joins, ranking, splits, tokens


def test_anti_join_is_null_safe(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "text_id string")
    right = spark.createDataFrame([("b",), (None,)], "text_id string")
    got = sorted(r.text_id for r in joins.anti_join_null_safe(left, right, "text_id").collect())
    assert got == ["a"]
    right2 = spark.createDataFrame([("b",)], "text_id string")
    got2 = {r.text_id for r in joins.anti_join_null_safe(left, right2, "text_id").collect()}
    assert got2 == {"a", None}


def test_assert_unique(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "text_id string, fold int")
    with pytest.raises(ValueError):
        joins.assert_unique(df, ["text_id"])
    joins.assert_unique(df.dropDuplicates(), ["text_id"])


def test_positions_match_pandas_rank_with_skewed_groups(spark):
    rng = np.random.default_rng(0)
    g = np.where(rng.random(5000) < 0.6, 0, rng.integers(1, 50, 5000))  # group 0 holds 60%
    pdf = pd.DataFrame({"g": g.astype(int), "k": rng.permutation(5000).astype(int)})
    df = spark.createDataFrame(pdf)
    for n in (1, 3, 16):
        got = ranking.positions(df, ["g"], ["k"], n_partitions=n).toPandas()
        exp = pdf.assign(pos=pdf.groupby("g").k.rank(method="first").astype(int) - 1)
        m = got.merge(exp, on=["g", "k"], suffixes=("", "_e"))
        assert len(m) == 5000 and (m.pos == m.pos_e).all()


def test_exclusive_offsets_equal_cumulative_sum(spark):
    rows = [(s, a, b, c, int(n)) for s in (1, 2) for a in range(3) for b in range(4) for c in ("x", "y")
            for n in [((a * 7 + b * 3 + ord(c)) % 5) + 1]]
    df = spark.createDataFrame(rows, "s int, a int, b int, c string, n long")
    got = ranking.exclusive_offsets(df, ["s"], [["a"], ["b"], ["c"]], "n").toPandas()
    got = got.sort_values(["s", "a", "b", "c"])
    exp = got.groupby("s").n.cumsum() - got.n
    assert (got.offset.to_numpy() == exp.to_numpy()).all()


def test_random_split_size_and_disjoint(spark):
    df = spark.createDataFrame([(f"t{i}",) for i in range(601)], "text_id string")
    s = splits.random_split(df, 42).toPandas()
    assert (s.split == "valid").sum() == 121  # ceil(0.2 * 601)
    assert len(s) == 601 and s.text_id.is_unique
    assert splits.random_split(df, 43).toPandas().set_index("text_id").split.ne(s.set_index("text_id").split).any()


def test_head_and_head_per_group(spark):
    df = spark.createDataFrame([(i % 3, f"t{i:03d}") for i in range(30)], "fold int, text_id string")
    assert [r.text_id for r in splits.head(df, 4, ["text_id"]).collect()] == ["t000", "t001", "t002", "t003"]
    h = splits.head_per_group(df, ["fold"], ["text_id"], 2).toPandas()
    assert len(h) == 6 and set(h[h.fold == 1].text_id) == {"t001", "t004"}
    assert splits.head(df, None, ["text_id"]).count() == 30


def test_encode_pad_mask_and_trim(spark):
    df = spark.createDataFrame([("a", "  one two\tthree\n\nfour "), ("b", "x")], "text_id string, full_text string")
    t = {r.text_id: r for r in tokens.tokenize(df, 5).collect()}
    assert t["a"].tokens == ["[CLS]", "one", "two", "three", "[SEP]"] and t["a"].mask == [1] * 5
    assert t["b"].tokens == ["[CLS]", "x", "[SEP]", "[PAD]", "[PAD]"] and t["b"].mask == [1, 1, 1, 0, 0]
    nopad = {r.text_id: r for r in tokens.tokenize(df, 5, pad=False).collect()}
    assert nopad["b"].tokens == ["[CLS]", "x", "[SEP]"]
    b = tokens.tokenize(df, 8).withColumn("batch_id", F.lit(0))
    tr = {r.text_id: r for r in tokens.trim_batches(b).collect()}
    assert tr["a"].trim_len == 6 and len(tr["b"].tokens) == 6 and tr["b"].mask == [1, 1, 1, 0, 0, 0]


def test_dynamic_padding_equals_pad_then_trim(spark):
    rows = [("a", "one two three four five six"), ("b", "x"), ("c", "p q"), ("d", "")]
    df = spark.createDataFrame(rows, "text_id string, full_text string").withColumn("batch_id", F.lit(0))
    full = {r.text_id: (r.tokens, r.mask) for r in tokens.trim_batches(tokens.tokenize(df, 6)).collect()}
    dyn = {r.text_id: (r.tokens, r.mask) for r in tokens.pad_to_batch_longest(tokens.tokenize(df, 6, pad=False, cut=True)).collect()}
    assert full == dyn


def test_positions_are_reproducible_across_runs(spark):
    df = spark.range(0, 3000).select((F.col("id") % 7).alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    a = ranking.positions(df, ["g"], ["k"]).toPandas().sort_values(["g", "k"]).reset_index(drop=True)
    b = ranking.positions(df.repartition(5), ["g"], ["k"], n_partitions=11).toPandas().sort_values(["g", "k"]).reset_index(drop=True)
    assert a.equals(b)
