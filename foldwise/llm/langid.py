"""Language identification with interpolated Kneser-Ney character models.

One model per language over the letters of words (a word is a run of letters,
lower-cased, with a start and an end mark; contexts do not cross words). All
models share sorted arrays of n-gram hashes, with one column per language. The
language with the lowest cross-entropy per character wins; a text whose best
cross-entropy lies far above what the language's own texts show is rejected.

The models are fitted on a bounded sample of labelled rows (``max_docs``
documents in expectation over all languages, chosen by a hash of the id: all
rows of a rare language, a share of those of a frequent one); every document is
scored on its whole text.

Rows: a null text or one without a letter (Unicode category L) gives ``und``,
score 0 and is rejected; ties go to the first language by name; repeated rows
are scored alike; without any labelled row every text is ``und`` and none is
rejected, as nothing is known to hold against it; an empty table gives no
rows. Only ``doc_id``, ``text`` and, for learning, ``lang`` are read.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.frames import record
from foldwise.llm.tokens import mix, text_chunks

#: runs of word characters other than decimal digits: letters, but also other
#: numbers (½, ², Ⅷ), which ``letter_words`` takes out
RUNS = re.compile(r"[^\W\d_]+")
START, END = 1, 2
UNKNOWN = "und"
#: bits per character beyond the language's mean below which nothing is
#: rejected, however long the text (a mix of known languages stays below)
EXCESS = 0.75
#: words whose symbols are held at a time
WORDS_AT_ONCE = 4096
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: list[str], order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Place in its word of every symbol (the start mark is 0), the hashes of
    the k-grams that end there for k = 1..order (0 where the word is too
    short on the left), and the word of every symbol."""
    text = "".join(chr(START) + w + chr(END) for w in words)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.flatnonzero(cp == START)
    lens = np.diff(np.append(starts, len(cp)))
    word = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(cp)) - np.repeat(starts, lens)
    out = [mix(cp + _SALT)]
    for k in range(1, order):
        left = np.zeros(len(cp), dtype=np.uint64)
        left[k:] = cp[:-k] if k else cp
        out.append(np.where(place >= k, mix(out[-1] * np.uint64(0xD6E8FEB86659FD93) + left + np.uint64(k + 1)), 0))
    return place, out, word


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted).clip(0, max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)


@dataclass
class Models:
    """``keys[k]``, ``terms[k]``: sorted (k+1)-gram hashes with the discounted
    share per language; ``contexts[k]``, ``rest[k]``: sorted context hashes with
    the weight of the next shorter order."""

    langs: list[str]
    order: int
    uniform: float
    keys: list[np.ndarray]
    terms: list[np.ndarray]
    contexts: list[np.ndarray]
    rest: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    limit: np.ndarray

    def word_costs(self, words: list[str]) -> np.ndarray:
        """Bits of each word under each language, (words, languages)."""
        n = len(self.langs)
        if not words:
            return np.zeros((0, n))
        place, grams, word = _grams(words, self.order)
        ok = place > 0
        p = np.full((int(ok.sum()), n), self.uniform)
        before = np.flatnonzero(ok) - 1
        for k in range(self.order):
            has = place[ok] >= k
            at, hit = _lookup(self.keys[k], grams[k][ok])
            term = np.where(hit[:, None], self.terms[k][at], 0.0) if len(self.keys[k]) else 0.0
            if k:
                c, seen = _lookup(self.contexts[k], grams[k - 1][before])
                rest = np.where(seen[:, None], self.rest[k][c], 1.0) if len(self.contexts[k]) else 1.0
            else:
                rest = self.rest[0]
            p = np.where(has[:, None], term + rest * p, p)
        cost = -np.log2(p)
        edges = np.searchsorted(word[ok], np.arange(len(words) + 1))
        total = np.vstack([np.zeros((1, n)), np.cumsum(cost, axis=0)])
        return total[edges[1:]] - total[edges[:-1]]


class WordCosts(dict):
    """Costs of words met so far in this task; emptied when it grows large."""

    def __init__(self, models: Models, limit: int = 250_000):
        super().__init__()
        self.models, self.limit = models, limit
        self.table = np.zeros((1024, len(models.langs) + 1))

    def rows(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Summed costs (one column per language) and characters of each text."""
        if len(self) > self.limit:
            self.clear()
        new = [w for w in dict.fromkeys(w for ws in words for w in ws) if w not in self]
        need = len(self) + len(new)
        if need > len(self.table):
            self.table = np.vstack([self.table, np.zeros((max(need, len(self.table)), self.table.shape[1]))])
        base = len(self)
        for a in range(0, len(new), WORDS_AT_ONCE):
            part = self.models.word_costs(new[a:a + WORDS_AT_ONCE])
            self.table[base + a:base + a + len(part), :-1] = part
        self.table[base:need, -1] = [len(w) + 1 for w in new]
        self.update(zip(new, range(base, need)))
        out = np.zeros((len(words), self.table.shape[1]))
        for i, ws in enumerate(words):
            for a in range(0, len(ws), 100_000):
                part = ws[a:a + 100_000]
                out[i] += self.table[np.fromiter(map(self.__getitem__, part), dtype=np.int64, count=len(part))].sum(0)
        return out[:, :-1], out[:, -1]


def letter_words(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), lower-cased."""
    words = RUNS.findall(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]


def _one_language(counts: Counter, order: int) -> list[dict]:
    """Per order: n-gram hashes with adjusted counts and context hashes with
    their totals and numbers of kinds."""
    words = sorted(counts)
    held = [[] for _ in range(order)]
    for a in range(0, len(words), WORDS_AT_ONCE):
        part = words[a:a + WORDS_AT_ONCE]
        place, grams, word = _grams(part, order)
        weight = np.array([counts[w] for w in part], dtype=np.float64)[word]
        for k in range(order):
            ok = place >= max(1, k)
            key, first, inverse = np.unique(grams[k][ok], return_index=True, return_inverse=True)
            spots = np.flatnonzero(ok)[first]
            none = np.zeros(len(spots), dtype=np.uint64)
            held[k].append((key, np.bincount(inverse, weights=weight[ok], minlength=len(key)),
                            grams[k - 1][spots - 1] if k else none, grams[k - 1][spots] if k else none, place[spots] > k))
    out, shorter = [], []
    for own in held:
        key, raw, context, tail, inside = map(np.concatenate, zip(*own))
        key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        raw = np.bincount(inverse, weights=raw, minlength=len(key))
        out.append({"key": key, "count": raw, "context": context[first], "inside": inside[first]})
        shorter.append(tail[first])
    for own, tails in zip(out, shorter[1:]):
        # continuation count: kinds of symbols that come before the n-gram;
        # an n-gram that begins a word has none and keeps its count
        kind, n = np.unique(tails, return_counts=True)
        at, hit = _lookup(kind, own["key"])
        own["count"] = np.where(hit & own["inside"], n[at] if len(kind) else 0, own["count"])
    return out


def fit(sample: list[tuple[str, str]], order: int = 4) -> Models:
    """Models of (language, text) rows. Every fifth text is held back to
    calibrate the rejection."""
    langs = sorted({lang for lang, _ in sample})
    counts = {lang: Counter() for lang in langs}
    held: list[tuple[int, list[str]]] = []
    seen = Counter()
    for lang, text in sample:
        words = letter_words(text)
        seen[lang] += 1
        if seen[lang] % 5 == 0:
            held.append((langs.index(lang), words))
        else:
            counts[lang].update(words)
    letters = {c for own in counts.values() for w in own for c in w}
    per = [_one_language(counts[lang], order) if counts[lang] else None for lang in langs]
    keys, terms, contexts, rest = [], [], [], []
    for k in range(order):
        all_keys = np.unique(np.concatenate([p[k]["key"] for p in per if p] or [np.zeros(0, np.uint64)]))
        all_ctx = np.unique(np.concatenate([p[k]["context"] for p in per if p] or [np.zeros(0, np.uint64)]))
        term = np.zeros((len(all_keys), len(langs)))
        back = np.ones((len(all_ctx), len(langs)))
        for j, p in enumerate(per):
            if not p or not len(p[k]["key"]):
                continue
            n = p[k]["count"]
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = once / (once + 2 * twice) if once else 0.5
            d = min(max(d, 0.1), 0.9)
            ctx, inverse = np.unique(p[k]["context"], return_inverse=True)
            total = np.bincount(inverse, weights=n)
            kinds = np.bincount(inverse)
            term[np.searchsorted(all_keys, p[k]["key"]), j] = np.maximum(n - d, 0) / total[inverse]
            cut = np.bincount(inverse, weights=np.minimum(n, d))
            back[np.searchsorted(all_ctx, ctx), j] = np.where(kinds > 0, cut / total, 1)
        keys.append(all_keys)
        terms.append(term)
        contexts.append(all_ctx)
        rest.append(back if k or len(back) else np.ones((1, len(langs))))
    n = len(langs)
    models = Models(langs, order, 1 / (len(letters) + 2), keys, terms, contexts, rest,
                    np.zeros(n), np.ones(n), np.full(n, np.inf))
    cost, chars = WordCosts(models).rows([ws for _, ws in held]) if held else (np.zeros((0, n)), np.zeros(0))
    for j in range(n):
        own = np.array([l == j for l, _ in held], dtype=bool) & (chars > 0) if held else np.zeros(0, dtype=bool)
        if own.sum() >= 20:
            h = cost[own, j] / chars[own]
            models.mean[j] = cost[own, j].sum() / chars[own].sum()
            models.spread[j] = max(1e-6, float(np.sqrt(np.median((h - models.mean[j]) ** 2 * chars[own]) / 0.455)))
            z = (h - models.mean[j]) / models.spread[j] * np.sqrt(chars[own])
            # beyond twice what any text held back shows
            models.limit[j] = max(8.0, 2 * float(z.max()))
        else:
            # too few texts to calibrate: rejected when guessing letters costs less
            models.mean[j], models.limit[j] = -np.log2(models.uniform) - EXCESS, 0.0
    return models


def _most_per_language(counts: list[int], total: int) -> int:
    """The bound per language with which all languages together give ``total``
    rows: all rows of the rare ones, as many of each of the others."""
    counts = sorted(counts)
    for k, n in enumerate(counts):
        most = total // (len(counts) - k)
        if n > most:
            return max(1, most)
        total -= n
    return max(1, *counts)


def sampled_rows(docs: DataFrame, max_docs: int = 6000) -> DataFrame | None:
    """(lang, text, p, doc_id): a bounded sample of labelled rows of every
    language: all rows of a rare language, a share of those of a frequent one.
    A document's place ``p`` in it depends on its id alone."""
    rows = docs.where("lang is not null and text is not null")
    held = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not held:
        return None
    per = _most_per_language(list(held.values()), max_docs)
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(lang, int(min(1.0, per / n) * (1 << 30))) for lang, n in sorted(held.items())],
                                               "lang string, below long")
    return rows.select("lang", "text", place.alias("p"), F.col("doc_id").cast("long").alias("doc_id")).join(
        F.broadcast(shares), "lang").where("p < below").drop("below")


def _in_order(got: pa.Table) -> list[tuple[str, str]]:
    got = got.sort_by([("p", "ascending"), ("doc_id", "ascending")])
    return list(zip(got["lang"].to_pylist(), got["text"].to_pylist()))


def training_sample(docs: DataFrame, max_docs: int = 6000) -> list[tuple[str, str]]:
    """The bounded sample as (language, text) in the order of its places."""
    rows = sampled_rows(docs, max_docs)
    return [] if rows is None else _in_order(rows.toArrow())


def fitted(docs: DataFrame, max_docs: int = 6000, order: int = 4) -> Models:
    """``fit(training_sample(docs))`` inside one task, as the sample is bounded:
    only the models come to the driver, not the texts and their n-grams."""
    rows = sampled_rows(docs, max_docs)

    def run(batches):
        got = list(batches)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(_in_order(pa.Table.from_batches(got)), order))],
                                                       type=pa.binary())], names=["models"])

    out = [] if rows is None else rows.repartition(1).mapInArrow(run, "models binary").collect()
    return pickle.loads(bytes(out[0]["models"])) if out else fit([], order)


RESULT_SCHEMA = "doc_id long, lang_pred string, score double, bits_per_char double, rejected boolean"
_RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
                     ("bits_per_char", pa.float64()), ("rejected", pa.bool_())])


def judge(models: Models, texts: list[str | None], cache: WordCosts) -> tuple[list, list, list, list]:
    """Language, score, cross-entropy and rejection of each text. The score is
    the winner's posterior with the evidence of ``min(characters, 50)``."""
    words = [letter_words(t) for t in texts]
    pred, score, bits, rejected = [], [], [], []
    cost, chars = cache.rows(words) if models.langs else (np.zeros((len(texts), 0)), np.zeros(len(texts)))
    for i, ws in enumerate(words):
        if not ws or not models.langs:
            pred.append(UNKNOWN), score.append(0.0), bits.append(None), rejected.append(bool(models.langs))
            continue
        h = cost[i] / chars[i]
        j = int(np.argmin(h))
        w = np.exp2(-(h - h[j]) * min(chars[i], 50))
        pred.append(models.langs[j])
        score.append(float(1 / w.sum()))
        bits.append(float(h[j]))
        beyond = h[j] - models.mean[j]
        rejected.append(bool(beyond > EXCESS and beyond / models.spread[j] * np.sqrt(chars[i]) > models.limit[j]))
    return pred, score, bits, rejected


def _slices(batch: pa.RecordBatch, at: int, limit: int = 1 << 20):
    """Parts of a batch with about a megabyte of text, and their texts."""
    texts = batch.column(at)
    for a, b, _, _ in text_chunks(texts, limit):
        yield batch.slice(a, b - a), texts.slice(a, b - a).to_pylist()


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """One row per document: language, score, bits per character, rejection."""

    def run(batches):
        cache = WordCosts(models)
        for batch in batches:
            for part, texts in _slices(batch, 1):
                yield record(_RESULT, part.column(0), *judge(models, texts, cache))

    return docs.select("doc_id", "text").mapInArrow(run, RESULT_SCHEMA)


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` without rejected documents, ``lang`` set to the language
    found; other columns and the order of rows stay."""
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        cache = WordCosts(models)
        for batch in batches:
            for part, texts in _slices(batch, at):
                pred, _, _, rejected = judge(models, texts, cache)
                columns = part.columns
                columns[lang] = pa.array(pred, pa.string())
                out = pa.RecordBatch.from_arrays(columns, names=part.schema.names)
                yield out.filter(pa.array([not r for r in rejected]))

    return docs.mapInArrow(run, docs.schema)
