"""Quality rules by distribution divergence.

References per language are learned from all documents: a histogram of
character classes and one of the most common words. A document is kept when
the Jensen-Shannon distance of its own histograms to those of its language
stays under a threshold. Histograms of short texts are noisy, so each
threshold grows with the sampling error of the text's length, and below a
minimum length a histogram does not judge at all.

Rows: a null text counts as empty; an empty or wordless text has no words and
fails the base rules; a null language is held against the nearest reference;
repeated rows are judged alike; an empty table gives no rows. Only
``doc_id``, ``text`` and ``lang`` are read, so further columns do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.frames import record, text_pass
from foldwise.llm.tokens import Words, signed, split_words, text_chunks, windows

# character classes of a byte; the trailing bytes of a code point count nowhere
LOWER_CASE, UPPER_CASE, DIGIT, SPACE, POINT, SYMBOL, OTHER, FOREIGN, TRAIL = range(9)
N_CLASSES = TRAIL
_CLASS = np.full(256, OTHER, dtype=np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = LOWER_CASE, UPPER_CASE, DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = POINT
_CLASS[[ord(c) for c in "#*$%&|<>@=+/\\^~_{}[]`"]] = SYMBOL
_CLASS[0x80:0xC0], _CLASS[0xC0:] = TRAIL, FOREIGN
_COUNTED_SYMBOL = np.zeros(256, dtype=bool)
_COUNTED_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BLOCK_WORDS = 1 << 21

REFERENCE_SCHEMA = "lang string, kind string, key long, n long"
_REFERENCE = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("key", pa.int64()), ("n", pa.int64())])


@dataclass
class Rules:
    """Thresholds. ``common_words``: bins of the word histogram."""

    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    max_char_distance: float = 0.22
    max_word_distance: float = 0.45
    min_chars_to_judge: int = 400
    min_words_to_judge: int = 60
    common_words: int = 64


@dataclass
class References:
    """By language: class shares, and the common words' hashes with shares."""

    langs: list[str] = field(default_factory=list)
    chars: np.ndarray = field(default_factory=lambda: np.zeros((0, N_CLASSES)))
    words: list[np.ndarray] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)


def _class_counts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    n = len(begin) - 1
    doc = np.repeat(np.arange(n), np.diff(begin))
    return np.bincount(doc * (N_CLASSES + 1) + _CLASS[data], minlength=n * (N_CLASSES + 1)) \
        .reshape(n, N_CLASSES + 1)[:, :N_CLASSES]


def language_counts(docs: DataFrame) -> DataFrame:
    """Counts behind the references: per language the documents, the
    characters by class and all words, summed over all documents."""

    def run(batches):
        totals, held, size = defaultdict(int), defaultdict(list), 0

        def flush():
            rows = list(totals.items())
            yield record(_REFERENCE, *[[k[i] for k, _ in rows] for i in range(3)], [n for _, n in rows])
            for lang, counts in held.items():
                keys, at = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in counts]), minlength=len(keys)).astype(np.int64)
                yield record(_REFERENCE, [lang] * len(keys), ["word"] * len(keys), keys, n)

        for batch in batches:
            langs = batch.column(0)
            codes = langs.dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.fill_null(-1).to_numpy()
            for a, b, data, begin in text_chunks(batch.column(1)):
                w = split_words(data, begin, lower=True)
                chars, hashes, doc = _class_counts(data, begin), signed(w.hashes()), w.doc_of()
                for c in np.unique(code[a:b]):
                    if c < 0:
                        continue
                    own = code[a:b] == c
                    totals[names[c], "docs", 0] += int(own.sum())
                    for k, n in enumerate(chars[own].sum(0)):
                        totals[names[c], "char", k] += int(n)
                    keys, n = np.unique(hashes[own[doc]], return_counts=True)
                    totals[names[c], "words", 0] += int(n.sum())
                    held[names[c]].append((keys, n))
                    size += len(keys)
                if size >= BLOCK_WORDS:
                    yield from flush()
                    totals, held, size = defaultdict(int), defaultdict(list), 0
        yield from flush()

    return (docs.select("lang", "text").mapInArrow(run, REFERENCE_SCHEMA)
            .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))


def learn_references(docs: DataFrame, rules: Rules | None = None) -> References:
    """References of every language; each is a few numbers."""
    rules = rules or Rules()
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    # the first rows of a language are found in every partition before any shuffle
    most = max(rules.common_words, N_CLASSES)
    counts = language_counts(docs).withColumn("place", place).where(F.col("place") <= most)
    chars, n_words, top = defaultdict(lambda: np.zeros(N_CLASSES)), {}, defaultdict(list)
    for r in counts.collect():
        if r["kind"] == "char":
            chars[r["lang"]][r["key"]] = r["n"]
        elif r["kind"] == "words":
            n_words[r["lang"]] = max(1, r["n"])
        elif r["kind"] == "word" and r["place"] <= rules.common_words:
            top[r["lang"]].append((r["key"], r["n"]))
    refs = References(sorted(n_words))
    for lang in refs.langs:
        words = sorted(top[lang])
        refs.words.append(np.array([k for k, _ in words], dtype=np.int64))
        refs.shares.append(np.array([n / n_words[lang] for _, n in words], dtype=np.float64))
    refs.chars = np.array([chars[lang] / max(1.0, chars[lang].sum()) for lang in refs.langs]).reshape(-1, N_CLASSES)
    return refs


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, row by row."""
    m = (p + q) / 2

    def kl(a):
        return (a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1))).sum(-1)

    return np.sqrt(np.maximum(0, (kl(p) + kl(q)) / 2))


def _slack(bins: int, n: np.ndarray) -> np.ndarray:
    """Half the distance bound that sampling n items over so many bins gives
    (most items fall into few bins)."""
    return np.sqrt((bins - 1) / (8 * np.log(2) * np.maximum(1, n))) / 2


def repeated_words(w: Words, hashes: np.ndarray, k: int) -> np.ndarray:
    """Per text: words inside windows of k words found twice or more in it."""
    at, x = windows(hashes, w.first, k)
    n_docs, n = len(w.first) - 1, len(hashes)
    if not len(at):
        return np.zeros(n_docs, dtype=np.int64)
    doc = np.searchsorted(w.first, at, side="right") - 1
    order = np.lexsort((x, doc))
    same = (x[order][1:] == x[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + k, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return np.diff(covered[w.first])


def duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


RESULT_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                 "base_failed boolean, kept boolean, char_distance double, word_distance double")
_L, _B, _D = pa.int64(), pa.bool_(), pa.float64()
_RESULT = pa.schema([("doc_id", _L), ("n_words", _L), ("word_chars", _L), ("n_symbols", _L), ("n_dup_lines", _L),
                     ("n_repeat_words", _L), ("base_failed", _B), ("kept", _B), ("char_distance", _D),
                     ("word_distance", _D)])


def judge(docs: DataFrame, refs: References, rules: Rules | None = None) -> DataFrame:
    """One row per document: counts, base rules, distances and the verdict."""
    r = rules or Rules()

    known = {lang: k for k, lang in enumerate(refs.langs)}

    def work(rows, data, begin):
        n_docs = len(begin) - 1
        w = split_words(data, begin)
        low = split_words(data, begin, lower=True)
        hashes, lowered, doc = w.hashes(), signed(low.hashes()), w.doc_of()
        n_words = w.counts()
        lead = np.concatenate([[0], np.cumsum((_CLASS[data] != TRAIL) & (_CLASS[data] != SPACE))])
        word_chars = np.diff(lead[begin])
        symbols = np.diff(np.concatenate([[0], np.cumsum(_COUNTED_SYMBOL[data])])[begin])
        repeats = repeated_words(w, hashes, r.repeat_window)
        whole = data.tobytes()
        dups = [duplicate_lines(whole[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        failed = (n_words < r.min_words) | (100 * repeats > r.max_repeat_percent * n_words)

        classes = _class_counts(data, begin)
        n_chars = classes.sum(1)
        shares = classes / np.maximum(1, n_chars)[:, None]
        lang = np.array([known.get(x, -1) for x in rows.column(2).to_pylist()], dtype=np.int64)
        char_d, word_d = np.full((2, n_docs), np.inf)
        for k in range(len(refs.langs)):
            mine = (lang == k) | (lang < 0)
            if not mine.any():
                continue
            d = js_distance(shares, refs.chars[k])
            char_d = np.where(mine, np.minimum(char_d, d), char_d)
            bins = len(refs.words[k])
            place = np.searchsorted(refs.words[k], lowered).clip(0, max(0, bins - 1))
            place = np.where(refs.words[k][place] == lowered, place, bins) if bins else np.zeros(len(lowered), int)
            h = np.bincount(doc * (bins + 1) + place, minlength=n_docs * (bins + 1)).reshape(n_docs, bins + 1)
            ref = np.append(refs.shares[k], max(0.0, 1 - refs.shares[k].sum()))
            d = js_distance(h / np.maximum(1, n_words)[:, None], ref)
            word_d = np.where(mine, np.minimum(word_d, d), word_d)
        if not refs.langs:
            char_d, word_d = np.zeros((2, n_docs))
        odd = (n_chars >= r.min_chars_to_judge) & (char_d > r.max_char_distance + _slack(N_CLASSES, n_chars))
        odd |= (n_words >= r.min_words_to_judge) & (word_d > r.max_word_distance + _slack(r.common_words + 1, n_words))
        return record(_RESULT, rows.column(0), n_words, word_chars, symbols, dups, repeats, failed, ~failed & ~odd,
                      char_d, word_d)

    return text_pass(docs.select("doc_id", "text", "lang"), work, RESULT_SCHEMA)


def quality_rules(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    return judge(docs, learn_references(docs, rules), rules)
