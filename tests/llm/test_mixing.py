"""The mix against a plain version, and its schedule's evenness."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldwise.llm import mixing as MX
from foldwise.llm.frames import Scratch

SCHEMA = "doc_id long, text string, source string, words long, slot string, offset long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 5, "x", 7) for r in rows], SCHEMA).repartition(parts)


def plain_targets(sizes: dict, weights=MX.WEIGHTS, share=MX.SHARE, passes=MX.PASSES) -> dict:
    """Reshare by weight until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    aim, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, total = aim - sum(fixed.values()), sum(weight[s] for s in free)
        out = fixed | {s: left * weight[s] / total for s in free}
        over = [s for s in free if out[s] >= passes * sizes[s]]
        if not over or not free:
            return out
        fixed |= {s: passes * sizes[s] for s in over}


def plain(rows, block_words):
    docs = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, n, s in docs:
        sizes[s] += n
    targets, out = plain_targets(sizes), []
    for s, total in sizes.items():
        words, at = min(int(targets[s] + 0.5), 2 * total), 0
        mine = [d for d in docs if d[2] == s]
        def order(d):
            said = "" if d[0] is None else str(d[0])
            return hashlib.md5(f"12:{said}".encode()).hexdigest(), d[0] is not None, d[0] or 0, d[1]
        for i, n, _ in sorted(mine, key=order):
            taken = sum(1 for p in range(2) for w in range(at, at + n) if p * total + w < words)
            out.append((i, n, total, float(targets[s]), taken))
            at += n
    return out


def close(got, want):
    got, want = (sorted(map(tuple, x), key=lambda r: (str(r[0]), r[1], r[2], r[4])) for x in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g[0], g[1], g[2], g[4]) == (w[0], w[1], w[2], w[4])
        assert g[3] == pytest.approx(w[3], rel=1e-12)


def sample(n=300):
    rng = random.Random(8)
    names = ["a", "a", "a", "a", "b", "é", "Z", "", "zz", None, "c"]
    rows = [(i, " ".join("w" * rng.randint(0, 30)), rng.choice(names)) for i in range(n)]
    rows += [(700, None, "b"), (701, "", "none"), (702, "long " * 5000, "a"), (None, "x y", "b"), (None, "x y", "b"),
             (3, "again and again", "b"), (3, "again and again", "b"), (703, "one", "tiny")]
    return rows


@pytest.mark.parametrize("block_words", [1, 7, 1024])
def test_digest_matches_plain_version(spark, block_words):
    rows = sample()
    got = MX.mix_digest(frame(spark, rows), block_words=block_words)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows_out = got.collect()
    close(rows_out, plain(rows, block_words))
    assert all(r["taken"] <= 2 * r["size"] for r in rows_out)


def test_reruns_agree_whatever_the_partitions(spark):
    a, b = (sorted(map(str, MX.mix_digest(frame(spark, sample(), p)).collect())) for p in (1, 6))
    assert a == b


def test_targets_share_the_excess(spark):
    sizes = [(0, "a", 100), (1, "b", 5), (2, "c", 0), (3, "d", 60), (4, None, 7)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, size long")
    got = {r["source"]: r["target"] for r in MX.with_targets(MX.source_table(df, MX.WEIGHTS), 1.5, 2).collect()}
    want = plain_targets({s: n for _, s, n in sizes})
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * 172)


def test_empty_tables_and_tables_without_words(spark):
    assert MX.mix_digest(frame(spark, sample()).limit(0)).count() == 0
    got = MX.mix_digest(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mix_holds_the_words_of_the_digest(spark):
    """The stretches of the slots are inside their documents, cover every pass
    once and add up to what the digest says."""
    rows = [r for r in sample() if r[0] is not None and r[0] != 3]
    df = frame(spark, rows)
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in MX.mix_digest(df, block_words=16).collect()}
    seen = defaultdict(lambda: defaultdict(int))
    for r in MX.mix(df, block_words=16).collect():
        for w in range(r["first_word"], r["first_word"] + r["words"]):
            seen[r["doc_id"]][w] += 1
    for i, (size, n) in taken.items():
        assert sum(seen[i].values()) == n and all(0 <= w < size and c <= 2 for w, c in seen[i].items())


def test_every_stretch_of_the_schedule_follows_the_shares(spark):
    """Low discrepancy: in any first part of the mix a source has its share of
    the slots but for a few."""
    rows = [(i, "w " * 50, s) for i, s in enumerate(["a"] * 40 + ["b"] * 80 + ["c"] * 60 + ["d"] * 20)]
    with Scratch(spark) as keep:
        sizes = MX.word_sizes(frame(spark, rows))
        sources = keep(MX.with_blocks(MX.with_targets(MX.source_table(sizes, MX.WEIGHTS), 1.5, 2), 2, 4), "t")
        share = {r["at"]: r["slots"] for r in sources.collect()}
        order = [r["at"] for r in MX.schedule(sources, keep).orderBy("slot").select("at").collect()]
    total, seen = sum(share.values()), defaultdict(int)
    assert len(order) == total
    for k, at in enumerate(order, 1):
        seen[at] += 1
        assert all(abs(seen[s] - k * n / total) <= 8 for s, n in share.items())
    assert seen == share


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 40))
def test_reversed_bits(spark, bits):
    ts = [t for t in (0, 1, 2, 5, 1000, (1 << bits) - 1) if t < 1 << bits]
    df = spark.createDataFrame([(t,) for t in ts], "t long").select("t", MX.reversed_bits(F.col("t"), bits).alias("r"))
    assert all(r["r"] == (int(format(r["t"], f"0{bits}b")[::-1], 2) if bits else 0) for r in df.collect())
