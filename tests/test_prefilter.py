"""The id filter and the anti-join that skips the shuffle for most texts."""

import re

import pytest
from pyspark.sql import functions as F

from foldwise.operators.joins import IdFilter, anti_join_null_safe, anti_join_prefiltered


def ids(spark, n, step=1, null=False):
    df = spark.range(0, n * step, step).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("text_id"))
    return df.unionByName(spark.createDataFrame([(None,)], "text_id string")) if null else df


def test_filter_holds_every_id_and_few_others(spark):
    held = IdFilter(ids(spark, 2000, 3, null=True), "text_id")
    assert held.ids == 2000 and held.bits <= 20_000
    probe = ids(spark, 9000).withColumn("may", held.may_hold(F.col("text_id"))).toPandas()
    member = probe.text_id.str[1:].astype(int) % 3 == 0
    member &= probe.text_id.str[1:].astype(int) < 6000
    assert probe.may[member].all()
    assert probe.may[~member].mean() < 0.04
    assert spark.range(1).select(held.may_hold(F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("max_bits", [64, 1 << 26])
@pytest.mark.parametrize("null", [False, True])
def test_same_rows_as_the_plain_anti_join(spark, null, max_bits):
    left = ids(spark, 500, null=True).withColumn("full_text", F.lit("x"))
    right = ids(spark, 100, 3, null=null)
    got = anti_join_prefiltered(left, right, "text_id", max_bits)
    assert got.columns == left.columns
    want = anti_join_null_safe(left, right, "text_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_sides(spark):
    left = ids(spark, 5)
    assert anti_join_prefiltered(left, left.limit(0), "text_id").count() == 5
    assert anti_join_prefiltered(left.limit(0), left, "text_id").count() == 0


def test_texts_that_are_ruled_out_are_not_exchanged(spark):
    from foldwise.plans import fixtures as FX
    from foldwise.plans.jobs import pseudo_base
    from tests.conftest import SF001
    out = pseudo_base(FX.labelled_essays(spark, SF001), FX.corpus(spark, SF001))
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"
    first = plan.children().apply(0).toString()
    assert "Join" not in first and "full_text" in first
    assert not re.search(r"Repartition|Aggregate", first)
