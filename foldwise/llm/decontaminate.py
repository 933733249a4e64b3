"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items become words (runs of ASCII letters and digits and of
bytes of other scripts, lower-cased). An item of n words may differ from a
passage by e = floor((1 - similarity) * n) word edits. Cut into e + 1 pieces,
at least one piece must occur unchanged in any such passage. Exact piece hits
come from one look-up of rolling hashes per piece length; around each hit
Myers' bit-parallel algorithm finds the item's best edit distance.

Test items are taken in blocks of bounded size; each block is one pass over
all documents, so any number of items is handled.

Rows: null or empty texts and items without a word match nothing; repeated
items are matched under each of their ids, items without an id under a null
one; repeated documents match alike; empty tables give no rows. Only
``doc_id``, ``text``, ``item_id`` are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldwise.llm.frames import record
from foldwise.llm.tokens import split_words, text_chunks, windows

SIMILARITY = 0.8
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000


@dataclass
class Items:
    """A block of test items: word hashes of each, and the pieces by length:
    sorted hashes with the item and the piece's place in it."""

    ids: list[int | None]
    words: list[np.ndarray]
    budget: list[int]
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def error_budget(n: int, similarity: float = SIMILARITY) -> int:
    return int(n * (1 - similarity) + 1e-9)


def cut(n: int, parts: int) -> list[tuple[int, int]]:
    """(begin, end) of ``parts`` pieces of n words, as even as can be."""
    at = [n * k // parts for k in range(parts + 1)]
    return list(zip(at, at[1:]))


def prepare(rows: list[tuple[int | None, str]], similarity: float = SIMILARITY) -> Items:
    ids, words, budgets = [], [], []
    found = defaultdict(list)
    texts = pa.array([t for _, t in rows], type=pa.large_string())
    for a, b, data, begin in text_chunks(texts):
        w = split_words(data, begin, lower=True, separators="non_alnum")
        h = w.hashes()
        for i in range(b - a):
            own = h[w.first[i]:w.first[i + 1]]
            if not len(own):
                continue
            e = error_budget(len(own), similarity)
            for x, y in cut(len(own), e + 1):
                _, piece = windows(own[x:y], np.array([0, y - x]), y - x)
                found[y - x].append((int(piece[0]), len(ids), x))
            ids.append(rows[a + i][0])
            words.append(own)
            budgets.append(e)
    pieces = {}
    for size, got in found.items():
        got.sort()
        pieces[size] = (np.array([g[0] for g in got], dtype=np.uint64), np.array([g[1] for g in got]),
                        np.array([g[2] for g in got]))
    return Items(ids, words, budgets, pieces)


def myers(pattern: dict[int, int], m: int, text: list[int], limit: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of ``text`` and the
    (first) place after that stretch; ``pattern`` has a bit mask per word."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for i, word in enumerate(text):
        eq = pattern.get(word, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus = down | (~(diag | up) & full)
        minus = up & diag
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        # the stretch may begin anywhere: nothing is carried in at the bottom
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        up = minus | (~(diag | plus) & full)
        down = plus & diag
        if score < best:
            best, end = score, i + 1
            if best == 0:
                break
    return best, end


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def matches(items: Items, hashes: np.ndarray, first: np.ndarray, peq: dict[int, dict[int, int]]) -> list[tuple]:
    """(text, item, distance, first word, word after the last) of the best
    passage of each text and item within the item's budget."""
    spots = []
    for size, (keys, item, offset) in items.pieces.items():
        at, x = windows(hashes, first, size)
        if not len(at):
            continue
        lo = np.searchsorted(keys, x, side="left")
        n = np.searchsorted(keys, x, side="right") - lo
        hit = np.flatnonzero(n)
        if len(hit):
            rep = np.repeat(hit, n[hit])
            which = np.repeat(lo[hit], n[hit]) + np.arange(len(rep)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
            spots.append(np.stack([item[which], at[rep] - offset[which], at[rep]]))
    if not spots:
        return []
    item, begin, at = np.concatenate(spots, axis=1)
    doc = np.searchsorted(first, at, side="right") - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for k in np.lexsort((begin, item, doc)):
        d, i, b = int(doc[k]), int(item[k]), int(begin[k])
        e, m = items.budget[i], len(items.words[i])
        # hits on nearly the same diagonal share one stretch of text
        lo, hi = max(int(first[d]), b - e), min(int(first[d + 1]), b + m + e)
        if done.get((d, i), -1) >= hi or best.get((d, i), (1,))[0] == 0:
            continue
        hi = min(int(first[d + 1]), hi + e)
        done[d, i] = hi
        if i not in peq:
            peq[i] = masks(items.words[i].tolist())
        score, end = myers(peq[i], m, hashes[lo:hi].tolist(), e)
        if score <= e and score < best.get((d, i), (e + 1,))[0]:
            best[d, i] = score, lo, lo + end
    return [(d, i, s, max(lo, end - len(items.words[i])) - int(first[d]), end - int(first[d]))
            for (d, i), (s, lo, end) in sorted(best.items())]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Blocks of items of bounded size, read partition by partition."""
    rows, words = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        words += len(r["text"]) // 4
        if len(rows) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield rows
            rows, words = [], 0
    if rows:
        yield rows


def _hits_of(batch: pa.RecordBatch, at: int, items: Items, peq: dict):
    for a, b, data, begin in text_chunks(batch.column(at)):
        w = split_words(data, begin, lower=True, separators="non_alnum")
        yield a, b, matches(items, w.hashes(), w.first, peq)


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()),
                   ("first_word", pa.int64()), ("end_word", pa.int64())])
HITS_SCHEMA = "doc_id long, item_id long, distance int, item_words int, first_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and test item it holds: the least number of word
    edits and the words of the passage."""
    spark = docs.sparkSession

    def of_block(items: Items) -> DataFrame:
        def run(batches):
            peq: dict = {}
            for batch in batches:
                for a, b, got in _hits_of(batch, 1, items, peq):
                    if got:
                        ids = batch.column(0).slice(a, b - a).to_pylist()
                        yield record(_HITS, [ids[g[0]] for g in got], [items.ids[g[1]] for g in got],
                                     [g[2] for g in got], [len(items.words[g[1]]) for g in got],
                                     [g[3] for g in got], [g[4] for g in got])

        return docs.select("doc_id", "text").mapInArrow(run, HITS_SCHEMA)

    found = [of_block(prepare(rows, similarity)) for rows in item_blocks(benchmark)]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], HITS_SCHEMA)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a test item; columns, rows
    and partitions stay as they are otherwise (nothing is shuffled)."""
    at = docs.columns.index("text")

    def without(frame: DataFrame, items: Items) -> DataFrame:
        def run(batches):
            peq: dict = {}
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for a, _, got in _hits_of(batch, at, items, peq):
                    keep[[a + g[0] for g in got]] = False
                yield batch.filter(pa.array(keep))

        return frame.mapInArrow(run, frame.schema)

    return reduce(without, (prepare(rows, similarity) for rows in item_blocks(benchmark)), docs)
