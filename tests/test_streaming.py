import os

from foldwise.streaming.corpus_stream import start_pseudo_base


def _write(d, name, text):
    with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
        fh.write(text)


def test_incremental_pseudo_base(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "corpus")
    os.makedirs(src)
    out = os.path.join(tmpdir_fresh, "out")
    ckpt = os.path.join(tmpdir_fresh, "ckpt")
    train_ids = spark.createDataFrame([("t1",), ("t2",)], "text_id string")
    for name in ("t1", "x1", "x2"):
        _write(src, f"{name}.txt", f"text of {name}\r\n")
    q = start_pseudo_base(spark, src, train_ids, out, ckpt, once=True)
    q.awaitTermination(120)
    first = {r.text_id: r.full_text for r in spark.read.parquet(out).collect()}
    assert first == {"x1": "text of x1\n", "x2": "text of x2\n"}
    # new files only are processed on the next run; train ids stay out
    for name in ("t2", "x3"):
        _write(src, f"{name}.txt", name)
    q = start_pseudo_base(spark, src, train_ids, out, ckpt, once=True)
    q.awaitTermination(120)
    ids = sorted(r.text_id for r in spark.read.parquet(out).collect())
    assert ids == ["x1", "x2", "x3"]


def test_packed_texts_give_the_rows_of_the_files(spark, tmpdir_fresh):
    from foldwise.sources.corpus import pack_texts, write_text_files

    rows = [(f"x{i}", f"text {i}\r\nof x.{i}\r") for i in range(40)] + [("a.b", "ü"), ("x1", "text 1\r\nof x.1\r"), (None, "no id"),
                                                                   ("e1", ""), ("e2", None), ("t1", "train")]
    df = spark.createDataFrame(rows, "text_id string, full_text string").repartition(3)
    train_ids = spark.createDataFrame([("t1",)], "text_id string")
    got = {}
    for packed, write in ((False, write_text_files), (True, pack_texts)):
        src, out, ckpt = (os.path.join(tmpdir_fresh, f"{packed}-{n}") for n in ("src", "out", "ckpt"))
        write(df, src, "text_id", "full_text")
        start_pseudo_base(spark, src, train_ids, out, ckpt, once=True, packed=packed).awaitTermination(120)
        got[packed] = sorted((r.text_id, r.full_text) for r in spark.read.parquet(out).collect())
    assert got[True] == got[False] and len(got[True]) == 42
    # what the driver lists does not grow with the texts
    files = [f for f in os.listdir(os.path.join(tmpdir_fresh, "True-src")) if f.endswith(".parquet")]
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
