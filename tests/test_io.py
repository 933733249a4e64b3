"""CSV edge, partitioned catalogue, text corpus scan."""

import os

import pytest
from pyspark.sql import functions as F

from foldwise.config import TARGETS
from foldwise.sources import corpus, csv, processed

EDGE_TEXTS = [
    ("lead", "  leading and trailing blanks  "),
    ("quote", 'she said "yes", then left'),
    ("comma", "a, b, c"),
    ("para", "first\n\nsecond"),
    ("crlf", "dos\r\nline"),
    ("backslash", "back\\slash \\\" mix"),
    ("NA", "id that pandas would read as missing"),
    ("007", "digits id stays a string"),
    ("empty", ""),
    ("null", None),
]


def test_csv_roundtrip_edge_rows(spark, tmpdir_fresh):
    rows = [(i, t, *[float(k) for k in range(6)]) for i, t in EDGE_TEXTS]
    df = spark.createDataFrame(rows, csv.TRAIN_SCHEMA)
    path = os.path.join(tmpdir_fresh, "train_csv")
    csv.write_csv(df.repartition(3), path)
    back = {r.text_id: r for r in csv.read_train(spark, path).collect()}
    assert len(back) == len(EDGE_TEXTS)
    for i, t in EDGE_TEXTS:
        expected = None if t in ("", None) else t  # empty string reads back as null
        assert back[i].full_text == expected, i
    assert back["007"].text_id == "007" and back["NA"].text_id == "NA"
    assert back["lead"].conventions == 5.0


def test_partitioned_catalogue_prunes_and_overwrites_one_seed(spark, tmpdir_fresh):
    df = spark.createDataFrame([(f"t{i}", s, i % 5, "vanilla") for s in (42, 43) for i in range(20)],
                               "text_id string, seed int, fold int, data_version string")
    processed.write_table(df, tmpdir_fresh, "train", ("data_version", "seed", "fold"))
    # rewrite seed 42 only: seed 43 must survive (dynamic partition overwrite)
    processed.write_table(df.where("seed = 42").limit(5), tmpdir_fresh, "train", ("data_version", "seed", "fold"))
    r = processed.train(spark, tmpdir_fresh, "vanilla", 43)
    assert r.count() == 20
    assert processed.train(spark, tmpdir_fresh, "vanilla", 42).count() == 5
    plan = r.where(F.col("fold") != 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "seed" in plan and "fold" in plan


def _write(dirname, name, content, binary=False):
    mode = "wb" if binary else "w"
    with open(os.path.join(dirname, name), mode, **({} if binary else {"encoding": "utf-8", "newline": ""})) as fh:
        fh.write(content)


def test_text_corpus_scan_reads_every_file(spark, tmpdir_fresh):
    # fewer than 100 files and a count that is not a multiple of 100: all kept
    for i in range(37):
        _write(tmpdir_fresh, f"doc{i}.txt", f"text {i}")
    _write(tmpdir_fresh, "win.txt", "a\r\nb\rc")
    _write(tmpdir_fresh, "A 0+1%.v2.txt", "odd name")
    _write(tmpdir_fresh, "BB.02.txt", "two dots")
    _write(tmpdir_fresh, "skip.csv", "not a text file")
    _write(tmpdir_fresh, "empty.txt", "")
    got = {r.text_id: r for r in corpus.read_text_corpus(spark, tmpdir_fresh).collect()}
    assert len(got) == 37 + 4 and got["empty"].full_text == ""  # a zero-length file is a row, too
    assert got["win"].full_text == "a\nb\nc"
    assert got["A 0+1%.v2"].full_text == "odd name"
    assert got["BB.02"].full_text == "two dots"
    assert all(got["doc3"][t] is None for t in TARGETS)


def test_empty_corpus_raises(spark, tmpdir_fresh):
    with pytest.raises(Exception):
        corpus.read_text_corpus(spark, os.path.join(tmpdir_fresh, "missing")).collect()


def test_write_text_files_roundtrip(spark, tmpdir_fresh):
    df = spark.createDataFrame([(1, "one\ntwo"), (2, "x")], "item_id long, text string")
    out = os.path.join(tmpdir_fresh, "corpus")
    corpus.write_text_files(df, out, "item_id", "text")
    got = {r.text_id: r.full_text for r in corpus.read_text_corpus(spark, out).collect()}
    assert got == {"1": "one\ntwo", "2": "x"}


def test_ingest_csv_once_to_parquet(spark, tmpdir_fresh):
    rows = [(i, t, *[1.0] * 6) for i, t in EDGE_TEXTS[:6]]
    csv.write_csv(spark.createDataFrame(rows, csv.TRAIN_SCHEMA), os.path.join(tmpdir_fresh, "in"))
    df = csv.ingest_csv(spark, os.path.join(tmpdir_fresh, "in"), csv.TRAIN_SCHEMA, os.path.join(tmpdir_fresh, "pq"))
    assert df.count() == 6
    assert "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()
    assert {r.text_id: r.full_text for r in df.collect()}["para"] == "first\n\nsecond"


def test_write_text_files_needs_posix_folder(spark):
    df = spark.createDataFrame([(1, "x")], "item_id long, text string")
    with pytest.raises(ValueError):
        corpus.write_text_files(df, "s3a://bucket/corpus", "item_id", "text")
