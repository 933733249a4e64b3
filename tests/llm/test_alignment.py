"""Alignment of two vocabularies against a plain version over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foldwise.llm import alignment as AL
from tests.llm.conftest import frame

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
AWKWARD = ["a", "b", " ", "  ", "\n", "\t", "é", " ", "　", "'s", "don't", "1", "23", "<s>", "<|endoftext|>",
           "▁", "\r\n", "\r", "日本", "😀", "x.", "(\r", "\x00", "\x1c", "\u0085", "и", "ש", "<0x41>", "the ",
           " and", "᠎", "​", "—", "“hi”", "\x0b", "\x0c", "Ａ", "é"]


@pytest.fixture(scope="module")
def plain():
    """Tokens and groups of a text by the two libraries and sets of ends."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    alphabet = AL.byte_symbols()

    def a_bytes(i):
        return bytes(alphabet.index(c) for c in a.id_to_token(i))

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        left, right = [a_bytes(i) for i in x], [b_bytes(i) for i in y]
        if not b"".join(left) == b"".join(right) == (" " + text).encode():
            return []
        ends = [np.cumsum([len(t) for t in side]).tolist() for side in (left, right)]
        out, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0].index(end) + 1, ends[1].index(end) + 1
            out.append((x[i:m], y[j:n]))
            i, j = m, n
        return out

    return groups


def brute(rows, groups):
    per = [(i, groups(t)) for i, t in rows]
    linked = [Counter((x, y) for g, h in found for x in g for y in h) for _, found in per]
    held = Counter(p for c in linked for p in c)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (i, found), c in zip(per, linked):
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in found)
        out.append((i, sum(len(g) for g, _ in found), sum(len(h) for _, h in found), len(found), sum(c.values()),
                    sum(m for p, m in c.items() if held[p] == most[p[0]]), sum(m * held[p] for p, m in c.items()),
                    hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=str)


def awkward_rows(n=400):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(AWKWARD) for _ in range(rng.randint(1, 25)))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, " "), (903, "\n"), (904, "a "), (905, "a \n"), (None, "the end"),
             (906, "the the the end"), (906, "the the the end"), (906, "the the the end"), (907, "▁"),
             (908, "aaaa" * 300), (909, "long text é " * 3000)]
    return rows


@pytest.mark.parametrize("cached", [0, 20, AL.CACHED])
def test_digest_matches_plain_version(spark, plain, cached):
    rows = awkward_rows()
    got = AL.alignment_digest(frame(spark, rows), *PATHS, cached=cached, width=8)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert key(got.collect()) == key(brute(rows, plain))


def test_empty_table_and_clashing_columns(spark, plain):
    assert AL.alignment_digest(frame(spark, [(1, "x")]).limit(0), *PATHS).count() == 0
    df = frame(spark, [(1, "a b"), (2, "a c")]).withColumnsRenamed({"row": "pairs", "id": "n_a"})
    assert key(AL.alignment_digest(df, *PATHS).collect()) == key(brute([(1, "a b"), (2, "a c")], plain))


def test_documents_keep_tokens_and_groups(spark, plain):
    rows = awkward_rows(60)
    for doc_id, a, b, ga, gb in AL.align_documents(frame(spark, rows), *PATHS, width=5).collect():
        want = [plain(t) for i, t in rows if i == doc_id]
        assert [(a[sum(ga[:k]):sum(ga[:k + 1])], b[sum(gb[:k]):sum(gb[:k + 1])]) for k in range(len(ga))] in want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60),
       st.integers(1, 9))
def test_merge_path_pieces_give_overlaps_and_groups(a, b, width):
    """Any piece width gives the overlaps of the byte ranges and their components."""
    gap = sum(a) - sum(b)
    (b if gap > 0 else a).extend([abs(gap)] if gap else [])
    a_end, b_end = np.cumsum(a), np.cumsum(b)
    x, y, end, g = AL.merge_ends(a_end, b_end, width)
    owner = [(int(np.searchsorted(a_end, p, side="right")), int(np.searchsorted(b_end, p, side="right")))
             for p in range(int(a_end[-1]))]
    assert list(zip(x.tolist(), y.tolist())) == list(dict.fromkeys(owner))
    cuts = sorted(set(a_end.tolist()) & set(b_end.tolist()))
    assert g.tolist() == [int(np.searchsorted(cuts, e)) for e in end]
    ga, gb = AL.group_sizes(a_end, b_end, width)
    assert np.cumsum(ga).tolist() == [a_end.tolist().index(c) + 1 for c in cuts]
    assert np.cumsum(gb).tolist() == [b_end.tolist().index(c) + 1 for c in cuts]


def test_split_path_shares_the_work_equally():
    a, b = np.cumsum([1] * 100), np.cumsum([100])
    at = AL.split_path(a, b, np.arange(0, 102, 10))
    assert at.tolist() == [*range(0, 101, 10)]


def test_large_groups_count_like_small_ones():
    from foldwise.llm.tokens import text_chunks
    import pyarrow as pa

    for _, _, data, begin in text_chunks(pa.array(["aaaaaaa bbbabab" * 40, "x"])):
        few, many = (AL.Aligned(data, begin, PATHS).pairs(15, large) for large in (1 << 30, 0))
        assert all(np.array_equal(p, q) for p, q in zip(few, many))


def test_every_sure_character_is_split_alike_by_both_libraries():
    a, _ = AL.opened(PATHS)
    texts = [f" a{c}b {c}{c}1{c} {c}" for c in map(chr, range(0x500))]
    assert [a.joined([t]).tolist() for t in texts] == a.single(texts)
