from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from foldwise.llm.components import components
from foldwise.llm.jaccard import keep_first, near_duplicate_classes
from foldwise.llm.lines import dedup_lines, line_report
from foldwise.llm.substrings import remove_repeats

from .conftest import frame


def brute_classes(rows):
    sets = []
    for _, x in rows:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[p:p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    lists, common = defaultdict(list), defaultdict(int)
    for k, s in enumerate(sets):
        for g in s:
            lists[g].append(k)
    for members in lists.values():
        for pair in combinations(members, 2):
            common[pair] += 1
    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k), i)) for k, (i, _) in enumerate(rows)), key=str)


def test_jaccard_classes_match_brute_force(spark, near_copies):
    rows = [(i if i % 17 else None, x) for i, x in near_copies] + near_copies[:5]
    got = sorted((tuple(r) for r in near_duplicate_classes(frame(spark, rows)).collect()), key=str)
    assert got == brute_classes(rows)


def test_jaccard_hot_groups(spark):
    """A large group of copies and of near copies, and a passage that many
    documents share."""
    rng = random.Random(1)
    word = lambda: "w%d" % rng.randrange(5000)
    base, passage = [word() for _ in range(80)], " ".join(word() for _ in range(40))
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 300):
        w = list(base)
        w[rng.randrange(80)] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(word() for _ in range(100)) + " " + passage) for i in range(300, 420)]
    got = sorted((tuple(r) for r in near_duplicate_classes(frame(spark, rows)).collect()), key=str)
    assert got == brute_classes(rows)


def test_sketches_never_differ_more_than_the_sets():
    import numpy as np
    from foldwise.llm.jaccard import SKETCH, sketches

    rng = np.random.default_rng(4)
    for size in (1, 5, 40, 400, 4000):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        b = np.concatenate([a[size // 8:], rng.integers(0, 1 << 63, size // 9, dtype=np.uint64)])
        got = sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 3)
        assert got.shape == (3, SKETCH // 64) and not got[2].any()
        differ = sum(int(x).bit_count() for x in (got[0] ^ got[1]).view(np.uint64))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_jaccard_meets_no_pairs_of_a_shared_template(spark, monkeypatch):
    """Documents that share a passage and are far from similar: their texts
    are not compared pair by pair."""
    from foldwise.llm import jaccard

    rng, compared = random.Random(8), []
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(60)) + " " + passage) for i in range(120)]
    own = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: compared.append(pairs.count()) or own(pairs, *a))
    monkeypatch.setattr(jaccard, "HEAVY", 0)  # no weights: the passage's shingles are in prefixes
    got = sorted((tuple(r) for r in near_duplicate_classes(frame(spark, rows)).collect()), key=str)
    assert got == brute_classes(rows) and sum(compared) < 120


def test_jaccard_joins_groups_before_it_meets_all_their_pairs(spark, monkeypatch):
    import foldwise.llm.jaccard as jaccard

    # every list's first is a document of one shingle, which links with no other
    common = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join(common + [f"d{k}x{j}" for j in range(4)])) for k in range(40)]
    rows += [(100 + i, " ".join(common[i:i + 5])) for i in range(96)]
    compared = []
    own = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: compared.append(pairs.count()) or own(pairs, *a))
    got = sorted(tuple(r) for r in near_duplicate_classes(frame(spark, rows)).collect())
    assert got == [(k, 100, 0) for k in range(40)] + [(100 + i, 1, 100 + i) for i in range(96)]
    assert sum(compared) < 150  # of 780 pairs


def test_jaccard_meets_a_pair_once_a_run_of_common_shingles(spark):
    """Two sets that link share most of their prefixes; the pair is not met at every common shingle."""
    import numpy as np

    from foldwise.llm import jaccard
    from foldwise.llm.frames import Scratch

    rng = np.random.default_rng(6)
    common = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, rng.integers(1, 1 << 63, 20, dtype=np.uint64)])) for _ in range(2)]
    doc, x = np.repeat([0, 1], 320), np.concatenate(sets)
    n, d, token, place, tag, level = jaccard.prefixes(doc, x, 2, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    info = jaccard.packed(n[d], place, tag, level[d], 1)
    rows = [(t, r, i, r) for t, r, i, k in zip(token.view(np.int64).tolist(), d.tolist(), info.tolist(), tag) if k == 1]
    entries = spark.createDataFrame(rows, "token long, row long, info long, component long")
    bits = jaccard.sketches(doc, x, 2).tolist()
    facts = spark.createDataFrame([(r, 320, *bits[r]) for r in range(2)],
                                  "row long, n int, " + ", ".join(f"{b} long" for b in jaccard.BITS))
    both = len(set(t for t, r, *_ in rows if r == 0) & set(t for t, r, *_ in rows if r == 1))
    with Scratch(spark) as keep:
        met = [tuple(r) for r in jaccard._open_pairs(entries, facts, keep).collect()]
    assert set(met) == {(1, 0)} and both > 50 and len(met) <= 16


def test_only_texts_of_pairs_meet_them(spark):
    from foldwise.llm.jaccard import _marked

    texts = spark.range(3000).selectExpr("id - 1500 as row", "'x' as text")
    wanted = [(-1500,), (-1,), (0,), (7,), (1499,)]
    got = {r["row"] for r in _marked(texts, spark.createDataFrame(wanted, "u long")).collect()}
    assert got >= {w for w, in wanted} and len(got) < 30


def test_keep_first_keeps_one_of_each_component(spark, near_copies):
    rows = near_copies + near_copies[:30] + [(3, "another text under a known id and more words")]
    kept = sorted((r["doc_id"], r["text"] or "") for r in keep_first(frame(spark, rows)).collect())
    classes = brute_classes(near_copies)
    want = {(i, x or "") for i, x in near_copies if (i, ) in {(c[0], ) for c in classes if c[0] == c[2]}}
    assert kept == sorted(want | {(3, "another text under a known id and more words")})


def brute_repeats(rows):
    seen, out = set(), []
    for i, x in rows:
        w = (x or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p:p + 20])
            if k in seen:
                gone[p:p + 20] = [True] * 20
            seen.add(k)
        left = b" ".join(a for a, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return out


def test_substrings_match_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(250):
        k = rng.random()
        if k < 0.4:
            x = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
        elif k < 0.7 and rows:
            w = (rng.choice(rows)[1] or "").split()
            q = rng.randint(0, len(w))
            w[q:q] = [rng.choice("ab")] * rng.randint(0, 3)
            x = "  ".join(w)
        elif k < 0.8:
            x = "x " * rng.randint(0, 100)
        else:
            x = None if k < 0.85 else " ".join(f"w{rng.randint(0, 3)}" for _ in range(rng.randint(0, 120)))
        rows.append((i, x))
    got = remove_repeats(frame(spark, rows, 5), with_text=True).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_repeats(rows)
    for r in got:
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"]


def test_substrings_with_repeated_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (1, text), (1, text), (1, "other " + text), (2, None)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in remove_repeats(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 30, 0), (1, 30, 30), (1, 31, 30), (2, 0, 0)], key=str)


def test_lines_keep_the_first_of_each_group(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(0, base + "\nshort line\nEr."), (1, "x y z\n" + base.upper() + "!!\nshort line"), (3, None), (4, ""),
            (5, base.replace("word7 ", "word7s ") + "\n" + base), (None, "null id one two three four"),
            (6, "null id one two three four"), (6, "null id one two three four")]
    got = sorted(((r["doc_id"], r["n_lines"], r["removed_lines"]) for r in line_report(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(0, 3, ""), (1, 3, "1,2"), (3, 1, ""), (4, 1, ""), (5, 2, "0,1"), (None, 1, ""), (6, 1, "0"),
                          (6, 1, "0")], key=str)
    text = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
    assert text[1] == "x y z" and text[3] is None and text[5] == ""
    assert dedup_lines(frame(spark, rows)).columns == frame(spark, rows).columns


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row = row, [i]
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def similar(x, y):
    return edit_distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9)


def edited_pairs(n_words, edits, count, seed):
    """Pairs of lines, the second with replaced words, similar by brute force."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    out = []
    while len(out) < count:
        x = [word() for _ in range(n_words)]
        y = list(x)
        for at in rng.sample(range(n_words), edits):
            y[at] = word()
        if similar(" ".join(x), " ".join(y)) and x != y:
            out.append((" ".join(x), " ".join(y)))
    return out


def test_line_recall_against_brute_force(spark):
    """One replaced word at every length, and a tenth of all words."""
    cases = [(n, 1) for n in (4, 6, 8, 10, 15, 25, 40, 50, 120)] + [(20, 2), (30, 3), (50, 5), (120, 8)]
    pairs = [(case, pair) for case in cases for pair in edited_pairs(*case, 60, 100 * case[0] + case[1])]
    rows = [(2 * i + k, pair[k]) for i, (_, pair) in enumerate(pairs) for k in (0, 1)]
    gone = {r["doc_id"] for r in line_report(frame(spark, rows)).where("n_removed > 0").collect()}
    found = defaultdict(list)
    for i, (case, _) in enumerate(pairs):
        found[case].append(2 * i + 1 in gone)
    share = {case: sum(f) / len(f) for case, f in found.items()}
    print(share)
    assert all(i % 2 for i in gone)  # the first of a pair stays
    assert min(share.values()) >= 0.9, share


def test_lines_match_brute_force_groups(spark):
    """Random lines and copies of them with a word replaced, put in or left
    out: the removed lines are those of the brute-force groups."""
    rng = random.Random(3)
    lines = [["w%d" % rng.randrange(4000) for _ in range(rng.choice((1, 2, 3, 5, 9, 14, 26, 60)))] for _ in range(60)]
    docs = []
    for i in range(90):
        text = []
        for _ in range(rng.randint(0, 3)):
            w = list(rng.choice(lines))
            if len(w) > 4 and rng.random() < 0.5:
                at, kind = rng.randrange(len(w)), rng.random()
                w[at:at + 1] = ["q%d" % rng.randrange(4000)] if kind < 0.5 else [w[at], "new"] if kind < 0.8 else []
            text.append(rng.choice((" ", ", ")).join(w))
        docs.append((i, "\n".join(text)))
    places = [(i, k, " ".join(x.replace(",", "").split())) for i, t in docs for k, x in enumerate(t.split("\n")) if x]
    head = list(range(len(places)))

    def root(a):
        while head[a] != a:
            a = head[a]
        return a

    for a, b in combinations(range(len(places)), 2):
        x, y = places[a][2], places[b][2]
        few = min(len(set(x.split())), len(set(y.split()))) < 4
        if x == y or (not few and similar(x, y)):
            lo, hi = sorted((root(a), root(b)))
            head[hi] = lo
    want = defaultdict(list)
    for a, (i, k, _) in enumerate(places):
        if root(a) != a:
            want[i].append(str(k))
    got = {r["doc_id"]: r["removed_lines"] for r in line_report(frame(spark, docs)).collect()}
    assert got == {i: ",".join(want[i]) for i, _ in docs}


def test_lines_of_a_hot_group_and_a_shared_phrase(spark):
    """Many variants of one line make one group though no bucket gives all
    pairs; lines that only share a phrase stay."""
    rng = random.Random(8)
    word = lambda: "v%d" % rng.randrange(9000)
    base, phrase = [word() for _ in range(24)], [word() for _ in range(6)]
    rows = []
    for i in range(200):
        w = list(base)
        w[rng.randrange(24)] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(phrase + [word() for _ in range(18)])) for i in range(200, 320)]
    rows += [(i, " ".join(rows[i - 120][1].split()[:-1] + [word()])) for i in range(320, 440)]  # partners within it
    gone = {r["doc_id"] for r in line_report(frame(spark, rows)).where("n_removed > 0").collect()}
    assert gone >= set(range(1, 200)) and not gone & set(range(200, 320))
    assert len(gone & set(range(320, 440))) >= 108


def test_lines_of_very_many_words_match_when_equal(spark):
    """More words than a lane of the SimHash counts: found when equal, and no
    overflow stops the job."""
    huge = " ".join(f"w{i}" for i in range(140_000))
    half = " ".join(f"v{i}" for i in range(40_000))
    rows = [(1, huge), (2, huge), (3, huge.replace("w", "u")), (4, half), (5, half.replace("v7 ", "vx "))]
    got = {r["doc_id"]: r["n_removed"] for r in line_report(frame(spark, rows, 2)).collect()}
    assert {i: got[i] for i in (1, 2, 3, 4, 5)} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_lines_with_clashing_columns_and_very_long_texts(spark):
    long = " ".join("z%d" % (i * i % 7919) for i in range(60_000))
    rows = [(1, long, 5), (2, "a b c d\n" + long, 6), (2, "a b c d", 7), (None, None, 8)]
    names = ("removed", "_a", "_b", "_d", "_id", "own", "hash", "a", "line", "k1")
    docs = spark.createDataFrame([(i, x, *[n] * len(names)) for i, x, n in rows],
                                 "doc_id long, text string, " + ", ".join(f"{c} int" for c in names))
    out = {r["removed"]: r for r in dedup_lines(docs).collect()}
    assert dedup_lines(docs).columns == docs.columns and sorted(out) == [5, 6, 7, 8]
    assert all(r[c] == n for n, r in out.items() for c in names)
    assert out[5]["text"] == long and sorted((out[6]["text"], out[7]["text"])) == ["", "a b c d"] and out[8]["text"] is None


def test_lines_of_a_large_bucket_are_all_compared(spark, monkeypatch):
    """Pairs that share one key only, with many lines unlike them all."""
    from foldwise.llm import lines as L
    from foldwise.llm.frames import Scratch

    monkeypatch.setattr(L, "SQUARE", 8)
    rng = random.Random(21)
    texts = []
    for i in range(30):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(6)]
        texts += [" ".join(words), " ".join(words)[:-1] + "z"]
    docs = frame(spark, list(enumerate(texts)))
    lines = docs.select("doc_id", F.xxhash64("text").alias("a"), F.lit(0).alias("line"), F.col("doc_id").alias("id"),
                        F.lit(0).cast("long").alias("sim"), F.length("text").alias("length"),
                        F.array(F.lit(7).cast("long")).alias("keys"))
    with Scratch(spark) as keep:
        links = {(r["u"], r["v"]) for r in L.similar_lines(docs, lines, keep).collect()}
    assert links == {(2 * i + 1, 2 * i) for i in range(30)}


def test_lines_of_a_group_are_not_all_compared(spark, monkeypatch):
    """A group of lines by replaced words and one that has a word more: of the
    pairs between them one is compared by the edit distance."""
    from foldwise.llm import lines as L

    rng, compared, rows = random.Random(12), [], []
    for k in range(6):
        base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(40)]
        for i in range(12):
            w = list(base)
            w[i % 6 * 5] = "x%d" % i
            rows.append((100 * k + i, " ".join(w if i < 6 else w[:20] + ["put", "in"] + w[20:])))
    own = L._verified
    monkeypatch.setattr(L, "_verified", lambda pairs, *a: compared.append(pairs.count()) or own(pairs, *a))
    gone = {r["doc_id"] for r in line_report(frame(spark, rows)).where("n_removed > 0").collect()}
    assert gone == {100 * k + i for k in range(6) for i in range(1, 12)}
    assert 6 <= sum(compared) <= 6 * 4  # of 6 * 36 pairs


def test_bounds_of_long_lines_agree_with_the_edit_distance(spark, monkeypatch):
    """Pairs looked at piece by piece and by their letters first, with codes by hash and by place."""
    from foldwise.llm import lines as L
    from foldwise.llm.frames import Scratch

    rng, rows = random.Random(31), []
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    for i in range(60):
        x = [word("abc\u00e9") for _ in range(rng.randint(5, 30))]
        y = [w for w in x if rng.random() > 0.1] if i % 3 else [word("xyz") for _ in x]
        for _ in range(rng.randint(0, 4)):
            y.insert(rng.randint(0, len(y)), word("abcx"))
        rows.append((2 * i + 1, 2 * i, x, y, int(max(len(" ".join(x)), len(" ".join(y))) * 0.2 + 1e-9)))
    want = {u for u, _, x, y, most in rows if edit_distance(" ".join(x), " ".join(y)) <= most}
    assert 10 < len(want) < 50
    pairs = spark.createDataFrame(rows, "u long, v long, xs array<string>, ys array<string>, budget int")
    for size, code in ((0, L._code), (0, lambda piece: F.lit(1 << 16)), (1 << 40, L._code)):
        monkeypatch.setattr(L, "LARGE_PAIR", size)
        monkeypatch.setattr(L, "_code", code)
        with Scratch(spark) as keep:
            assert {r["u"] for r in L._verified(pairs, keep, "links").collect()} == want


def test_lines_of_repeated_rows_take_the_facts_of_the_first_place(spark):
    from foldwise.llm import lines as L
    from foldwise.llm.frames import Scratch

    text = " ".join(f"word{i}" for i in range(12))
    docs = frame(spark, [(1, "one two three four five\n" + text), (2, text), (2, text), (3, "six"), (3, "six")])
    with Scratch(spark) as keep:
        hashes = keep(L.line_hashes(docs).withColumn("row", F.monotonically_increasing_id()), "hashes")
        got = {r["n"]: r for r in L._distinct_lines(hashes, keep).collect()}
        place = {r["row"]: (r["doc_id"], r["line"]) for r in hashes.collect()}
    assert sorted(got) == [2, 5, 12] and got[12]["times"] == 2 and any(got[12][f"x{g}"] for g in range(10))
    assert place[got[12]["id"]] in {(1, 1), (2, 0)}


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (103, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 103: 100, 105: 100}


def test_empty_tables(spark):
    empty = frame(spark, []).limit(0)
    for f in (near_duplicate_classes, keep_first, remove_repeats, line_report, dedup_lines):
        assert f(empty).collect() == []
