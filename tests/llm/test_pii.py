from __future__ import annotations

import math
import random
import re

from foldwise.llm.pii import EVIDENCE, GENERALISE, SUPPORT, find_personal_data, sanitise

from .conftest import frame

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _ok(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if _ok(k, m.group())]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("a1@.+-%_ 0123456789()é\n\U0001d4b3") for _ in range(rng.randint(0, 80))))
            for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "4111 1111-1111 1111"), (5003, "x@y.z_a@b.c"), (None, "+1 (202) 555-0147"),
             (None, "+1 (202) 555-0147"), (5002, "4111 1111-1111 1111")]
    got = find_personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), brute(x)) for i, x in rows)
    assert sorted((str(r["doc_id"]), [(s["kind"], s["start"], s["end"]) for s in r["found"]]) for r in got) == want


def test_long_runs_are_searched_whole(spark):
    rows = [(1, "1" * 30000), (2, "a@" + "b." * 9000 + "c"), (3, "1.2." * 9000), (4, "+" + "1 " * 20000), (5, "x" * 50000)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"]]
           for r in find_personal_data(frame(spark, rows)).collect()}
    assert got == {i: brute(x) for i, x in rows}


def test_disclosing_terms_go_only_where_the_entity_is(spark):
    rows = [(i, f"write to {who}@x.org near {place} for tea {i}") for i, (who, place) in
            enumerate([("bob", "Zanzibar")] * 4 + [("amy", "Paris")])]
    rows += [(10 + i, "we write tea near to for a town") for i in range(30)]
    got = {r["doc_id"]: r["text"] for r in sanitise(frame(spark, rows)).collect()}
    assert got[0] == "write to [email] near  for tea 0"  # the place occurs with this entity alone
    assert got[4] == "write to [email] near Paris for tea 4"  # one text is no support
    assert got[12] == "we write tea near to for a town"


def test_terms_far_from_the_entity_disclose_it(spark):
    filler = " ".join(["we write tea near to for a town"] * 5)
    rows = [(i, f"Ravenna {filler} {i} bob@x.org") for i in range(4)] + [(0, f"Ravenna {filler} 0 bob@x.org")]
    rows += [(20 + i, f"{filler} {i}") for i in range(30)]
    got = sanitise(frame(spark, rows)).collect()
    assert sorted(r["text"] for r in got if r["doc_id"] < 20) == sorted(f" {filler} {i} [email]" for i in [0, 0, 1, 2, 3])
    assert all(r["text"] == f"{filler} {r['doc_id'] - 20}" for r in got if r["doc_id"] >= 20)


def _disclosed(rows):
    """(doc_id, term) by the documented ratio, entity by entity, in plain Python."""
    def names(text):
        out = {}
        for kind, start, end in brute(text):
            value = text[start:end]
            digits = re.sub("[^0-9]", "", value)
            part = {"email": value.lower().split("@")[-1], "ip": value.rsplit(".", 1)[0]}.get(kind, digits[:6])
            out |= {f"{kind}:{value.lower()}": False, f"class:{kind}:{part}": True, f"kind:{kind}": True}
        return out

    def terms(text):
        return set(re.findall("[a-z]+", re.sub(PATTERNS["email"], " ", text).lower()))

    n, gone = len(rows), set()
    facts = [(i, x, names(x), terms(x)) for i, x in rows]
    for entity, wide in {(e, w) for _, _, own, _ in facts for e, w in own.items()}:
        holding = [f for f in facts if entity in f[2]]
        if len(holding) == n:
            continue
        for term in set().union(*(f[3] for f in holding)):
            both = [f for f in holding if term in f[3]]
            shared = math.log2(len(both) * n / (len(holding) * sum(term in f[3] for f in facts)))
            if (len({f[1] for f in both}) >= SUPPORT and shared / math.log2(n / len(holding)) >= GENERALISE
                    and (not wide or len(both) * shared >= EVIDENCE)):
                gone |= {(f[0], term) for f in both}
    return gone


def test_terms_of_unique_entities_match_brute_force(spark):
    """Every entity is unique: its kind or class is what the terms disclose."""
    rng, rows = random.Random(8), []
    for i in range(240):
        words = [rng.choice("tea town we write near rain road boat".split()) for _ in range(8)]
        if i % 8 == 0:
            words += ["mailbox", f"u{i}@{rng.choice(['x.org', 'y.net'])}"] + (["Zurich"] if i % 3 == 0 else [])
        elif i % 8 == 1:
            words += ["gateway", f"10.{i % 3}.7.{i}"]
        elif i % 8 == 2:
            words += ["town", "hotline", f"+1 202 555 {1000 + i}"]
        elif i % 40 == 3:
            words += ["mailbox"]
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, "")]
    got = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in find_personal_data(frame(spark, rows)).collect()
           for s in r["found"]}
    text = dict(rows)
    terms = {(i, text[i][a:b].lower()) for i, kind, a, b in got if kind in ("generalised", "removed")}
    assert terms == _disclosed([(i, x or "") for i, x in rows])
    assert {t for _, t in terms} >= {"mailbox", "gateway", "hotline"} and "tea" not in {t for _, t in terms}
    # documents without an entity keep all their terms
    assert all(brute(text[i]) for i, _ in terms)


def test_empty_table(spark):
    assert find_personal_data(frame(spark, []).limit(0)).collect() == []
