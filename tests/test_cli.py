"""End-to-end steps through the command line on CSV inputs built from sf0.001."""

import os

from pyspark.sql import functions as F

from foldwise import cli
from foldwise.config import TARGETS
from foldwise.plans import fixtures as FX
from foldwise.sources import csv, processed
from foldwise.sources.corpus import write_text_files
from tests.conftest import SF001


def test_cli_steps(spark, tmpdir_fresh):
    d = tmpdir_fresh
    csv.write_csv(FX.essays(spark, SF001).select("text_id", "full_text", *TARGETS), f"{d}/train")
    csv.write_csv(FX.test_texts(spark, SF001).select("text_id", "full_text"), f"{d}/test")
    csv.write_csv(FX.submission_template(spark, SF001), f"{d}/ss")
    write_text_files(FX.corpus(spark, SF001).where("doc_id % 3 = 0"), f"{d}/corpus", "doc_id", "full_text")
    common = ["--train", f"{d}/train", "--test", f"{d}/test", "--sample-submission", f"{d}/ss",
              "--out", f"{d}/out", "--seeds", "42", "43", "--n-features", "16"]
    cli.main(["build", *common])
    assert processed.train(spark, f"{d}/out/processed", "vanilla", 43).count() == 200
    r = cli.main(["train", *common, "--run-name", "r1"])
    assert len(r["scores"]) == 2
    log = processed.read_metrics(spark, f"{d}/out/runs", "r1")
    assert log.where(F.col("metric") == "oof_score_seed_mean").count() == 1
    cli.main(["infer", *common])
    sub = csv.read_sample_submission(spark, f"{d}/out/submission")
    assert sub.count() == 200 and sub.where(F.col("cohesion").isNull()).count() == 0
    cli.main(["pseudo", *common, "--corpus", f"{d}/corpus"])
    p = processed.pseudo(spark, f"{d}/out/processed", 42, 1)
    assert p.count() == 67  # corpus ids are doc_id stems, never train ids ('d' prefix)
