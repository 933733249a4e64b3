from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import decontaminate as D
from foldwise.llm.bpe import Bpe, encode_digest, encode_documents
from foldwise.llm.langid import fit, fitted, identify, keep_identified, training_sample
from foldwise.llm.lmscore import lm_scores
from foldwise.llm.quality import quality_rules
from foldwise.llm.queries import vocabulary
from foldwise.llm.toxicity import Settings, hashed_words, score, train

from .conftest import frame


def test_bpe_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    path, rng = vocabulary(), random.Random(1)
    library, own = Tokenizer.from_file(path), Bpe(path)
    letters = "abcdefghijklmnopqrstuvwxyz'''  0123#$%éüñß<|>startofendtext"
    vocab = [v.replace("</w>", "") for v in own.vocab]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(vocab) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    texts += ["a" + chr(c) + "b" for c in range(0x20, 0x3000, 3)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "ΟΔΟΣ Σ", "İstanbul", "ﬁ ½ ²", "\x1cx\x85z",
              "it's we'll I'D 'S", "", " \n", "x" * 3000, "Ⱥa"]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == library.decode(want, skip_special_tokens=False), t
    rows = [(1, "Hello there"), (None, None), (1, "Hello there")]
    assert [r["n_tokens"] for r in encode_digest(frame(spark, rows, 1), path).orderBy("doc_id").collect()] == [0, 2, 2]
    got = encode_documents(frame(spark, rows, 1), path).where("doc_id = 1").first()
    assert got["ids"] == library.encode("Hello there").ids and got["decoded"] == "hello</w> there</w>"


def _edit(p, t):
    prev = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        cur = [i + 1]
        for j, y in enumerate(t):
            cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_leaks_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(25)] + [(99, None), (98, "?")]
    docs = [(-1, None), (-2, "")]
    for k in range(150):
        t = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        it = rng.choice(items[:25])[1].split()
        for _ in range(rng.randint(0, len(it) // 4 + 1)):
            q = rng.randrange(len(it) + 1)
            if rng.random() < 0.4 or q == len(it):
                it.insert(q, rng.choice(words))
            elif len(it) > 1:
                del it[q]
        q = rng.randint(0, len(t))
        docs.append((k, " ".join(t[:q] + it + t[q:])))
    want = {}
    for d, t in docs:
        for i, it in items[:25]:
            s = _edit(it.split(), (t or "").split())
            if s <= D.error_budget(len(it.split())):
                want[d, i] = s
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.leaks(frame(spark, docs), bench).collect()}
    assert got == want
    left = {r["doc_id"] for r in D.remove_leaks(frame(spark, docs), bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert D.leaks(frame(spark, docs), bench.limit(0)).collect() == []


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(5)]
    docs = [(i, "some words before " + t) for i, t in items]
    got = sorted((r["doc_id"], r["item_id"]) for r in
                 D.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(i, i) for i in range(5)]


def test_items_without_id_are_found(spark):
    item = "seven quick foxes jump over the lazy brown dogs today"
    items = spark.createDataFrame([(None, item), (None, None), (3, "")], "item_id long, text string")
    docs = [(1, f"so {item} indeed"), (2, "nothing of the kind"), (None, item)]
    assert sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in D.leaks(frame(spark, docs), items).collect()) == [
        ("1", None, 0), ("None", None, 0)]
    assert [r["doc_id"] for r in D.remove_leaks(frame(spark, docs), items).collect()] == [2]


def test_language_models(spark):
    rng = random.Random(3)
    syllables = {"aa": ["ba", "ke", "lo", "mi"], "bb": ["str", "ung", "ich", "tz"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    models = fit([(lang, text(lang, 60)) for _ in range(150) for lang in ("aa", "bb")])
    # probabilities of all continuations of a context add up to one at most
    rows = [(i, text(lang, 40), None) for i, lang in enumerate(["aa", "bb"] * 20)]
    rows += [(100, None), (101, ""), (102, "12 3.4 --"), (103, "xqj wvf zzq pfy " * 30), (None, text("aa", 30)), (0, rows[0][1])]
    got = {(r["doc_id"], r["lang_pred"]): r for r in identify(frame(spark, rows), models).collect()}
    for i in range(40):
        assert (i, ["aa", "bb"][i % 2]) in got
    assert all((k, "und") in got for k in (100, 101, 102)) and (None, "aa") in got
    kept = sorted(str(r["doc_id"]) for r in keep_identified(frame(spark, rows), models).collect())
    assert kept == sorted([str(i) for i in range(40)] + ["None", "0"])
    nothing = identify(frame(spark, rows), fit([])).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and {r["score"] for r in nothing} == {0.0}
    assert keep_identified(frame(spark, rows), fit([])).count() == len(rows)


def test_only_letters_make_a_language(spark):
    """Category L counts: no numbers of any kind, no marks, no symbols."""
    import unicodedata

    from foldwise.llm.langid import letter_words

    # of a capital's lower case, marks that it adds are left out
    assert all(bool(letter_words(chr(c))) == (unicodedata.category(chr(c))[0] == "L")
               for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert letter_words("a½b ²c Ⅷ d9e_f") == ["a", "b", "c", "d", "e", "f"]
    models = fit([("x", "abab abba baba aabb"), ("y", "ba ab")] * 10)
    rows = [(i, t) for i, t in enumerate(["½ ² ③ Ⅷ", "一 丁", "12 ٣", "_ __", "½a"])]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(frame(spark, rows), models).collect()}
    assert [got[i] == ("und", 0.0) for i in range(5)] == [True, False, True, True, False]


def _syllable_text(rng, lang, n):
    syllables = {"aa": ["ba", "ke", "lo", "mi"], "bb": ["str", "ung", "ich", "tz"], "cc": ["ou", "vey", "dja", "qi"]}
    return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_long_clean_texts_are_kept(spark):
    """A small excess per character does not count more in a longer text."""
    rng = random.Random(12)
    text = lambda lang, n: _syllable_text(rng, lang, n)
    models = fit([(lang, text(lang, 60)) for _ in range(150) for lang in ("aa", "bb")])
    topic = " ".join(text("aa", 12) + " bamike kestrlo" for _ in range(2000))
    mixed = " ".join(text("aa", 19) + " " + text("bb", 1) for _ in range(2000))
    rows = [(1, topic), (2, mixed), (3, "xqj wvf zzq pfy " * 10000), (4, topic[:3000])]
    assert len(topic) > 130_000 and len(mixed) > 130_000
    assert sorted(r["doc_id"] for r in keep_identified(frame(spark, rows), models).collect()) == [1, 2, 4]


def test_rare_languages_are_learned(spark):
    rng = random.Random(13)
    rows = [(i, _syllable_text(rng, lang, 20), lang) for i, lang in enumerate(["aa", "bb"] * 2000)]
    rows += [(9000 + i, _syllable_text(rng, "cc", 60), "cc") for i in range(3)]
    sample = training_sample(frame(spark, rows), 1000)
    assert sorted(x for lang, x in sample if lang == "cc") == sorted(r[1] for r in rows[-3:])
    assert 800 < len(sample) < 1200
    own, other = fitted(frame(spark, rows), 1000), fit(sample)
    assert own.langs == other.langs and all(np.array_equal(a, b) for a, b in zip(own.terms + own.rest, other.terms + other.rest))
    assert fitted(frame(spark, rows).where("lang is null")).langs == []
    new = [(1, _syllable_text(rng, "cc", 40)), (2, _syllable_text(rng, "aa", 40)), (3, "xqj wvf zzq pfy " * 30)]
    got = {r["doc_id"]: r["lang_pred"] for r in keep_identified(frame(spark, new), fit(sample))
           .selectExpr("doc_id", "lang lang_pred").collect()}
    assert got == {1: "cc", 2: "aa"}


def test_kneser_ney_probabilities_add_up():
    models = fit([("x", "abab abba baba aabb"), ("y", "ba ab"), ("x", "abc"), ("x", "bca"), ("y", "aab")])
    letters = "abc"
    # all words of up to 7 letters hold nearly all of the mass, and never more
    words, total, last = [""], 0.0, 0.0
    for _ in range(7):
        words = [w + c for w in words for c in letters]
        last = float(np.exp2(-models.word_costs(words)[:, 0]).sum())
        total += last
    assert 0.5 < total <= 1.0


def test_lm_scores_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, None if i == 5 else " ".join(rng.choice(["The", "a", "cat", "sat", f"r{rng.randint(0, 40)}"])
                                             for _ in range(rng.randint(0, 30)))) for i in range(120)]
    rows += [(3, rows[3][1]), (None, "a cat")]
    df = frame(spark, rows)
    got = lm_scores(df, df["doc_id"] % 3 != 0).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for i, x in rows:
        if i is not None and i % 3:
            counts.update((x or "").lower().split() + ["</end>"])
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len((x or "").split()) + 1, sum(counts[w] > 0 for w in (x or "").lower().split() + ["</end>"]), n,
                   round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in (x or "").lower().split() + ["</end>"]), 6))
                  for i, x in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_automaton_adds_up_to_one(spark):
    """The weights of all continuations of any history are a distribution."""
    from foldwise.llm.lmscore import Automaton, learn

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(12))) for i in range(60)]
    model, _ = learn(frame(spark, rows))
    machine = Automaton(model)
    v = model.vocabulary
    unseen = 0.1 / (v.tokens + 0.1 * (v.kinds + 1))
    for history in ([], [1], [2, 3], [4, 4], [1, 2, 3]):
        start = machine.traverse(history)
        known = sum(10 ** (machine.traverse(history + [w]) - start) for w in range(len(v.counts)))
        rest = 10 ** (machine.traverse(history + [-1]) - start) * unseen
        assert known + rest == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("cache", [1 << 18, 64, 4])
def test_lm_scores_hold_all_ngrams(spark, monkeypatch, cache):
    """However small the automaton is, all n-grams seen twice count."""
    from foldwise.llm import lmscore

    monkeypatch.setattr(lmscore, "NGRAMS", cache)
    monkeypatch.setattr(lmscore, "VOCABULARY", 4 * cache)
    monkeypatch.setattr(lmscore, "PART_GRAMS", 100)
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcd") if rng.random() < 0.6 else f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 25))))
            for i in range(150)] + [(200, None), (None, "a b a b a b"), (3, "a b c")]
    texts = [(x or "").split() + ["</end>"] for i, x in rows if i is not None and i % 4]
    c1, c2, c3 = (Counter(tuple(t[p:p + k]) for t in texts for p in range(len(t) - k + 1)) for k in (1, 2, 3))
    norm = sum(c1.values()) + 0.1 * (len(c1) + 1)

    def probability(history, w):
        if not history:
            return (c1[w,] + 0.1) / norm
        counts, total = (c2, c1) if len(history) == 1 else (c3, c2)
        own = {g: n for g, n in counts.items() if g[:-1] == history and n >= 2}
        lower = probability(history[1:], w)
        if not own:
            return lower
        share = {g: (n - 0.7) / total[history] for g, n in own.items()}
        return share.get((*history, w), 0) + (1 - sum(share.values())) * lower

    def want(x):
        t = (x or "").split() + ["</end>"]
        return sum(math.log10(probability(tuple(t[max(0, p - 2):p]), w)) for p, w in enumerate(t))

    df = frame(spark, rows)
    got = lm_scores(df, df["doc_id"] % 4 != 0).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == sorted((str(i), round(want(x), 6)) for i, x in rows)


def test_texts_are_copied_only_where_ids_repeat(spark, monkeypatch):
    """Unique ids tell rows apart; else the rows are numbered and written once.
    The scores are those of one model either way."""
    from foldwise.llm import lmscore

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 20)))) for i in range(60)]
    written, own = [], lmscore.materialize
    monkeypatch.setattr(lmscore, "materialize", lambda df, name: written.append(name) or own(df, name))

    def scores(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted((x, round(r["base_score"], 6), round(r["score"], 6)) for r, x in
                      ((r, dict(rows)[r["doc_id"]]) for r in lm_scores(df, df["text"] < "d").collect()))

    alone = scores(rows)
    assert "lm-texts" not in written
    again = scores(rows + [(0, rows[0][1])] if rows[0][1] >= "d" else [(None, "e e")] + rows)
    assert "lm-texts" in written and len(again) == len(alone) + 1
    assert [s for s in alone if s not in again] == []


def test_all_places_step_as_one_traversal_does(spark):
    """The states that the last two words give are those of a walk word by word."""
    import numpy as np

    from foldwise.llm.lmscore import BITS, Automaton, learn

    rng = random.Random(13)
    df = spark.createDataFrame([(i, " ".join(rng.choice("aabbcdef") for _ in range(rng.randint(0, 25)))) for i in range(80)],
                               "doc_id long, text string")
    machine = Automaton(learn(df)[0])
    arcs = dict(zip(machine.arcs.tolist(), zip(machine.weight.tolist(), range(len(machine.arcs)))))
    words = len(machine.word_state)

    def by_word(numbers):
        total, last = 0.0, []
        for w in numbers:
            short = machine.word_state[last[-1]] if last and last[-1] >= 0 else 0
            states = [short] if short else []
            if len(last) > 1 and last[-1] >= 0 and last[-2] >= 0:
                hit = arcs.get(int(machine.word_state[last[-2]]) << BITS | last[-1])
                if machine.word_state[last[-2]] and hit and machine.after[hit[1]] > words:
                    states.insert(0, machine.after[hit[1]])
            for state in states:
                if w >= 0 and int(state) << BITS | w in arcs:
                    total += arcs[int(state) << BITS | w][0]
                    break
                total += machine.rest[state]
            else:
                total += machine.root[w] if w >= 0 else 0.0
            last.append(w)
        return total

    assert len(machine.arcs) > 20
    texts = [[rng.randrange(-1, words) or -1 for _ in range(rng.randint(0, 12))] + [0] for _ in range(200)]
    first = np.cumsum([0] + [len(t) for t in texts])
    got = np.add.reduceat(machine.walk(np.array(sum(texts, [])), first), first[:-1])
    assert np.allclose(got, [by_word(t) for t in texts])


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (2, "a b\n\na b\n  \n a b"), (None, "é#*x $%&|<> b"), (3, "one two " * 20)]
    rows += [(10 + i, "\n".join(" ".join(rng.choice("abc#é") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 9))))
             for i in range(150)]

    def brute(x):
        x = x or ""
        w = x.encode().split()
        at = {}
        for p in range(len(w) - 7):
            at.setdefault(tuple(w[p:p + 8]), []).append(p)
        covered = {q for ps in at.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        lines, dups = set(), 0
        for line in x.split("\n"):
            if line.encode().split():
                dups += line in lines
                lines.add(line)
        return (len(w), sum(len(z.decode()) for z in w), sum(c in "#*$%&|<>" for c in x), dups, len(covered),
                len(w) < 20 or 100 * len(covered) > 30 * len(w))

    got = quality_rules(frame(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((str(r["doc_id"]), *[r[c] for c in names]) for r in got) == sorted((str(i), *brute(x)) for i, x in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_drops_what_diverges(spark):
    rng = random.Random(9)
    common = ["the", "of", "and", "to", "in"]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "word%s" % "".join(
        rng.choice("abcdefg") for _ in range(5)) for _ in range(300))
    rows = [(i, prose()) for i in range(200)] + [(900, " ".join("#%d*|" % rng.randrange(10**6) for _ in range(300)))]
    got = {r["doc_id"]: r["kept"] for r in quality_rules(frame(spark, rows)).collect()}
    assert not got.pop(900) and all(got.values())


def test_quality_references_of_rare_languages(spark):
    """Documents of a language with few rows are held against their own kind,
    and all words count, however rows fall into chunks."""
    from foldwise.llm.quality import learn_references

    rng = random.Random(14)
    common = {"en": ["the", "of", "and", "to", "in"], "zz": ["qua", "vel", "dor"]}
    prose = lambda lang: " ".join(rng.choice(common[lang]) if rng.random() < 0.5 else
                                  "%s%s" % (lang, rng.randint(0, 3000)) for _ in range(120))
    rows = [(i, prose("en"), "en") for i in range(3000)] + [(9000 + i, prose("zz"), "zz") for i in range(2)]
    refs = learn_references(frame(spark, rows))
    assert refs.langs == ["en", "zz"]
    for k, lang in enumerate(refs.langs):
        counts = Counter(w for _, x, own in rows if own == lang for w in x.split())
        want = sorted((n / sum(counts.values()) for n in counts.values()), reverse=True)[:64]
        assert sorted(refs.shares[k], reverse=True) == pytest.approx(want)
    assert all(r["kept"] for r in quality_rules(frame(spark, rows)).where("doc_id >= 9000").collect())


def test_toxicity_learns_inflected_words(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))

    def text(bad):
        w = [word() for _ in range(60)]
        for _ in range(3 * bad):
            w[rng.randrange(60)] = "vorpal" + word()
        return " ".join(w)

    y = [i % 3 == 0 for i in range(700)]
    texts = [text(b) for b in y]
    net = train(texts[:500], list(map(int, y[:500])), Settings())
    rows = list(enumerate(texts[500:])) + [(900, None), (901, ""), (None, texts[0])]
    got = {r["doc_id"]: r for r in score(frame(spark, rows), net).collect()}
    right = sum((got[i]["predicted"] == 1) == y[500 + i] for i in range(200))
    assert right >= 195 and got[900]["score"] == got[901]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert train(["a"], [1]) is None
    assert {r["score"] for r in score(frame(spark, rows), None).collect()} == {0.5}


def test_toxicity_learns_from_all_labelled_rows(spark):
    from foldwise.llm.toxicity import fit as fit_toxicity

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    # 40 toxic words, each in 20 of 2,400 texts: no small sample holds all of them
    rows, toxic = [], []
    for i in range(2400):
        bad = i % 3 == 0
        w = [word() for _ in range(30)] + (["zq" + "wxyz"[i // 3 % 4] + "uvstrnmlkj"[i // 12 % 10] + "x"] * 2 if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        toxic.append((i, int(bad)))
    rows += [(None, "no id"), (9000, None)]
    labels = spark.createDataFrame(toxic + [(None, 1), (9000, 1), (8000, 1), (1, None)], "doc_id long, toxic int")
    # one shard: the model of the texts in memory
    own = fit_toxicity(frame(spark, rows[:600]), labels, Settings())
    docs, seen = frame(spark, rows), []
    place = {r[0]: r[1] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 3), 1 << 30)").collect()}
    for i in sorted(range(600), key=lambda i: (place[i], i)):
        seen.append((rows[i][1], toxic[i][1]))
    plain = train([t for t, _ in seen], [y for _, y in seen], Settings())
    assert np.array_equal(own.embed, plain.embed) and np.array_equal(own.out, plain.out) and own.out_bias == plain.out_bias
    # many shards of rows beyond every bound
    net = fit_toxicity(docs, labels, Settings(kind_rows=20, shard_rows=300))
    fresh = [(i, " ".join([word() for _ in range(30)] + ["zq" + a + b + "x"] * 2))
             for i, (a, b) in enumerate((a, b) for a in "wxyz" for b in "uvstrnmlkj")]
    clean = [(100 + i, " ".join(word() for _ in range(32))) for i in range(200)]
    got = {r["doc_id"]: r["predicted"] for r in score(frame(spark, fresh + clean), net).collect()}
    assert sum(got[i] for i, _ in fresh) >= 38 and sum(got[i] for i, _ in clean) <= 4
    assert fit_toxicity(docs, labels.where("toxic = 1")) is None


def test_toxicity_joins_labels_alike_whatever_the_size(spark):
    from foldwise.llm.toxicity import _dealt

    labels, name = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "10MB")
    try:
        rows = _dealt(frame(spark, [(1, "a"), (2, "b"), (3, "c")]), labels, 4)
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.collect()) == [(1, "a", 1), (2, "b", 0)]


def test_written_tables_leave_no_shuffle_files(spark):
    from foldwise.llm.frames import Scratch
    from foldwise.session import materialize

    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    df, before = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), files()
    with Scratch(spark) as keep:
        assert keep(df, "shuffled").count() == 7 and materialize(df, "shuffled").count() == 7
        left = files() - before
    # the counts that read the tables shuffle a row a task, the writes nothing any more
    assert len({x.split("_")[1] for x in left}) <= 2


def test_pooling_matches_a_plain_loop():
    from foldwise.llm.tokens import text_chunks
    from foldwise.llm.toxicity import WIDTHS, _start
    import pyarrow as pa

    texts = ["a b c d", "", "a", "x y", "a b a b a b a"]
    (_, _, data, begin), = text_chunks(pa.array(texts))
    words, first = hashed_words(data, begin, 64)
    net = _start(words, first, np.array([0, 1, 0, 1, 1]), Settings(buckets=64))
    z, _ = net.forward(words, first)
    x = net.vectors(words)
    for d in range(len(texts)):
        want = net.out_bias
        for k, width in enumerate(WIDTHS):
            acts = [sum(x[p + j] @ net.filters[k][j] for j in range(width)) + net.bias[k]
                    for p in range(first[d], first[d + 1] - width + 1)]
            want += np.maximum(np.max(acts, axis=0), 0) @ net.out[k] if acts else 0
        assert z[d] == pytest.approx(want, rel=1e-4)


def test_empty_tables(spark):
    empty = frame(spark, []).limit(0)
    assert quality_rules(empty).collect() == []
    assert lm_scores(empty, empty["doc_id"] > 0).collect() == []
    assert identify(empty, fit([])).collect() == [] and score(empty, None).collect() == []
    assert encode_digest(empty, vocabulary()).collect() == []


def test_language_models_do_not_depend_on_how_many_words_are_held(monkeypatch):
    from foldwise.llm import langid

    rng = random.Random(12)
    sample = [(lang, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(40)))
              for lang, letters in (("a", "abcdefgh"), ("b", "efghijkl")) for _ in range(60)]
    held, sizes = langid._grams, []
    monkeypatch.setattr(langid, "_grams", lambda words, order: sizes.append(len(words)) or held(words, order))
    whole = langid.fit(sample)
    monkeypatch.setattr(langid, "WORDS_AT_ONCE", 7)
    sizes.clear()
    parts = langid.fit(sample)
    assert max(sizes) <= 7
    for name in ("keys", "terms", "contexts", "rest"):
        assert all((x == y).all() for x, y in zip(getattr(whole, name), getattr(parts, name), strict=True))
    assert (abs(whole.mean - parts.mean) < 1e-9).all()


def test_bpe_cache_is_bounded_and_keeps_what_is_asked_for_again(monkeypatch):
    rng = random.Random(13)
    often = [f"often{k}" for k in "abcde"]
    texts = [" ".join([*often, *("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(20))]) for _ in range(60)]
    small, large = Bpe(vocabulary(), 100), Bpe(vocabulary())
    asked, own = Counter(), small._answer
    monkeypatch.setattr(small, "_answer", lambda s: asked.update([s]) or own(s))
    for t in texts:
        assert small.encode(t) == large.encode(t)
        assert len(small.cache) + len(small.older) <= small.cache_limit
    assert [asked[w] for w in often] == [1] * 5
