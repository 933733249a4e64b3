"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

A piece (the unit that merges never cross) is a string of symbols. For every
prefix there is exactly one token that can end its encoding: a vocabulary
token that matches the prefix's end (all matches come from an automaton over
the vocabulary) and is compatible with the last token of the prefix before
it. Two tokens are compatible when merging their joined symbols gives those
two tokens again. Following the stored last tokens back from the whole piece
gives the ids.

Rows: a null text counts as empty and has no tokens; repeated pieces are
served from a cache of bounded size; a piece of any length is
handled whole; an empty table gives no rows. Only ``doc_id`` and ``text`` are
read. The vocabulary file's path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from foldwise.llm.frames import record

#: Unicode tables differ between libraries from here on, so texts with such
#: characters are split by the tokenizer file's own normaliser and splitter
_NEWER = re.compile("[\u0530-\U0010ffff]")
#: symbols that end a piece are moved up by this much, so a token that ends a
#: word is another string than the same letters inside a word
_ENDS = 0x10000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte:
    printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def splitter() -> re.Pattern:
    """The vocabulary's split pattern for characters below U+0530: its letter
    and number classes written out by their Unicode categories."""
    kinds = {kind: "".join(re.escape(chr(c)) for c in range(0x530) if unicodedata.category(chr(c))[0] == kind)
             for kind in "LN"}
    letter, number = f"[{kinds['L']}]", f"[{kinds['N']}]"
    space = "".join(re.escape(chr(c)) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0))
    return re.compile(f"{letter}+|'s|'t|'re|'ve|'m|'ll|'d|{number}|[^{space}{kinds['L']}{kinds['N']}]+")


class Bpe:
    """Encoder for a tokenizer file with NFC / white space / lower-case
    normalisation, pattern splitting, byte-level symbols and a word-end mark."""

    def __init__(self, path: str, cache_limit: int = 300_000):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.pattern = splitter()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        self.symbols = byte_symbols()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(map(tuple, model["merges"])):
            left, right = self.vocab[a], self.vocab[b]
            self.rank[left, right] = r
            self.parts[self.vocab[a + b]] = (left, right)
        self.matcher = ahocorasick.Automaton()
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        for token, i in self.vocab.items():
            if self.reachable(i):
                s = self._own(token)
                self.matcher.add_word(s, (len(s), i))
        self.matcher.make_automaton()
        # two generations: what is not asked for again goes with the older one
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.cache_limit = cache_limit

    def _own(self, token: str) -> str:
        if not token.endswith(self.suffix) or token == self.suffix:
            return token
        token = token[:-len(self.suffix)]
        return token[:-1] + chr(ord(token[-1]) + _ENDS)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """From the outermost symbol on one side up to the token itself: each
        node with the rank of the merge that uses it up (none: a huge one)."""
        key = token, side
        if key not in self.spines:
            if len(self.spines) > 500_000:
                self.spines.clear()
            down, used = [], 1 << 60
            while True:
                down.append((token, used))
                if token not in self.parts:
                    break
                used = self.rank[self.parts[token]]
                token = self.parts[token][side]
            self.spines[key] = down[::-1]
        return self.spines[key]

    def _meet(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two tokens before both
        are complete. Of two equal ranks the one further left goes first."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            crossing = self.rank.get((x, y), 1 << 61)
            if (x, y) == (left, right):
                return True
            if crossing < x_used and crossing <= y_used:
                return False
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own symbols gives the token."""
        known = self.whole.get(token)
        if known is None:
            known = token not in self.parts or (all(map(self.reachable, self.parts[token]))
                                                and self._meet(*self.parts[token]))
            self.whole[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = (left, right) not in self.rank and self._meet(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as the symbols of its bytes."""
        s = piece[:-1] + chr(ord(piece[-1]) + _ENDS)
        n = len(s)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        known, compatible = self.pairs.get, self.compatible
        for end, (length, token) in self.matcher.iter(s):
            i = end + 1
            if last[i] < 0:
                left = last[i - length] if i > length else -2
                if left == -2 or (left >= 0 and (known(left << 20 | token) or compatible(left, token))):
                    last[i], size[i] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def normalise(self, text: str) -> str:
        """NFC and lower case by character (no rule for a sigma at a word's
        end). Runs of white space stay: the splitter drops them anyway."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _answer(self, symbols: str) -> tuple[int, str, str]:
        ids = self.encode_piece(symbols)
        return len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids])

    def _piece(self, piece: str) -> tuple[int, str, str]:
        got = self.older.get(piece) or self._answer("".join([self.symbols[b] for b in piece.encode("utf-8")]))
        if len(piece) <= 64:
            if len(self.cache) >= self.cache_limit // 2:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = got
        return got

    def _split_by_library(self, segment: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(segment)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, tokens as text) of each piece in order."""
        get, make, out = self.cache.get, self._piece, []
        for k, segment in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append((1, str(self.added[segment]), segment))
                continue
            normal = self.normalise(segment)
            if _NEWER.search(normal):
                out += [self._answer(p) for p in self._split_by_library(segment)]
            else:
                out += [get(p) or make(p) for p in self.pattern.findall(normal)]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text or "") for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by one space."""
        return " ".join([self.names[i] for i in ids])


_OPEN: dict[str, Bpe] = {}


def opened(path: str) -> Bpe:
    """One encoder per worker process and vocabulary."""
    if path not in _OPEN:
        _OPEN[path] = Bpe(path)
    return _OPEN[path]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string())])


def _slices(batch: pa.RecordBatch, limit: int = 1 << 20):
    rows, size = [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_py() or ""
        rows.append((doc_id, text))
        size += len(text)
        if size >= limit:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text."""

    def run(batches):
        bpe = opened(path)
        for batch in batches:
            for rows in _slices(batch):
                ids = [bpe.encode(t) for _, t in rows]
                yield record(_ENCODED, [i for i, _ in rows], ids, [bpe.decode(x) for x in ids])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_documents`` with digests in place of ids and decoded text
    (made piece by piece, so a text's ids are never held as numbers)."""

    def digest(bpe: Bpe, text: str) -> tuple[int, str, str]:
        got = bpe.pieces(text)
        n, ids, tokens = zip(*got) if got else ((), (), ())
        return (sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(),
                hashlib.sha256(" ".join(tokens).encode("utf-8")).hexdigest())

    def run(batches):
        bpe = opened(path)
        for batch in batches:
            for rows in _slices(batch):
                out = [digest(bpe, t) for _, t in rows]
                yield record(_DIGEST, [i for i, _ in rows], *[[x[k] for x in out] for k in range(3)])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
