"""The streamed audit against filters applied one by one in all orders."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from foldwise.llm import audit as AU
from foldwise.session import shared_path

SCHEMA = "doc_id long, text string, source string, part string, flags long, key string"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """Per row the letters of the filters it fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "D": bool(re.search(r"[#$%&*|]", t)),
               "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "E": i is not None and i > least[t]}
        out.append({k for k, v in bad.items() if v})
    return out


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    bad, out = fails(rows), {}
    for order in map("".join, permutations("ABCDE")):
        for part in {s or "" for _, _, s in rows}:
            left = [(i, b) for (i, _, s), b in zip(rows, bad) if (s or "") == part]
            mine, gone = left, []
            for step, f in enumerate(order, 1):
                now = [(i, b) for i, b in left if f in b]
                left = [(i, b) for i, b in left if f not in b]
                out[part, order, step] = [len(left), len(now), sum(f in b for _, b in gone), sum(b == {f} for _, b in mine),
                                          sum(i in good for i, _ in now), sum(i in toxic for i, _ in now)]
                gone += now
    total = defaultdict(int)
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def sample(n=160):
    rng = random.Random(2)
    texts = ["", None, "A B C", "same words " * 60, " ".join(f"w{k}" for k in range(60)), "# " + " ".join(f"v{k}" for k in range(70)),
             "ABC " * 55, " ".join(f"U{k}" for k in range(50)), "é ü " * 30, " ".join(f"x{k}" for k in range(20000))]
    rows = [(i, rng.choice(texts), rng.choice(["s1", "s2", "", None])) for i in range(n)]
    rows += [(i + 1000, f"text {i}", "s1") for i in range(20)] + [(None, texts[3], "s1"), (None, texts[3], "s2"), (5, rows[5][1], "s2"), (5, rows[5][1], "s2")]
    rng.shuffle(rows)
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, n, 2)] + [(None, 1, 1), (4, 1, 1), (6, None, None)]
    return rows, labels


def stored(spark, rows, files):
    """A table of so many files, in the order of the rows."""
    path = shared_path(spark, "audit-test.parquet")
    size = -(-len(rows) // files)
    for k in range(0, max(len(rows), 1), max(size, 1)):
        spark.createDataFrame([(*r, "x", 3, "k") for r in rows[k:k + size]], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def collected(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                          "toxic_lost", "shapley"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("files", [1, 5])
def test_audit_matches_plain_version(spark, files):
    """In one micro-batch, and in five with smaller ids arriving later."""
    rows, labels = sample()
    got = AU.filter_audit(spark, stored(spark, rows, files), spark.createDataFrame(labels, LABELS), batches=5)
    assert collected(got) == plain(rows, labels)


def test_a_single_file_and_an_empty_table(spark):
    rows, labels = sample(20)
    folder = stored(spark, rows, 1)
    assert collected(AU.filter_audit(spark, spark.read.parquet(folder).inputFiles()[0], spark.createDataFrame(labels, LABELS))) \
        == plain(rows, labels)
    assert AU.filter_audit(spark, stored(spark, [], 1), spark.createDataFrame(labels, LABELS)).count() == 0


def test_smaller_ids_retract_what_was_counted(spark):
    """Counters after each file are right for the files so far, and the
    second run goes on from the first one's state."""
    long = " ".join(f"w{k}" for k in range(60))
    batches = [[(9, long, "a"), (7, long, "b")], [(8, long, "a")], [(3, long, "a"), (4, long, "b")]]
    labels = AU.label_flags(spark.createDataFrame([(7, 1, 0)], LABELS))
    folder, path = (shared_path(spark, f"audit-{x}") for x in ("stream", "d.parquet"))
    seen = []
    for rows in batches:
        seen += rows
        spark.createDataFrame([(*r, "x", 3, "k") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        AU.count_masks(spark, path, labels, folder)
        got = Counter({(r["part"], r["flags"]): r["n"] for r in AU.read_counters(spark, folder).collect()})
        least = min(i for i, _, _ in seen)
        assert got == Counter((p, (16 if i > least else 0) | (32 if i == 7 else 0)) for i, _, p in seen)
    deltas = spark.read.parquet(f"{folder}/counters").where("batch = 2 and n < 0").collect()
    assert [(r["part"], r["flags"], r["n"]) for r in deltas] == [("b", 32, -1)]


def test_many_copies_send_one_row_a_batch(spark):
    rows = [(i, "copy", "s") for i in range(500)] + [(600, "other", "s")]
    df = spark.createDataFrame([(*r, "x", 3, "k") for r in rows], SCHEMA).coalesce(1)
    held = AU.settle(AU.judged(df, AU.label_flags(spark.createDataFrame([], LABELS))).coalesce(1)).where(F.col("doc_id").isNotNull())
    assert sorted(r["doc_id"] for r in held.collect()) == [0, 600]
