"""Language-model scoring with a weighted backoff automaton.

All words, bigrams and trigrams of the training texts are counted exactly; a
bigram or trigram belongs to the model when it occurs ``LEAST`` times, whatever
the size of the corpus. Their smoothed log probabilities stand in Spark tables
that grow with the corpus. The most frequent part is also the states and arcs
of an automaton, a cache of a size bounded by arithmetic: a word belongs to it
with a share of ``1 / VOCABULARY`` of all training tokens, an n-gram with a
share of ``1 / NGRAMS``. An arc carries an n-gram's log probability, a failure
arc the weight of backing off to the next shorter history; one left-to-right
traversal of a text carries the state and adds up the weights.

The log probability of a text is a sum over its words and n-grams: each word
gives its own probability and its backing-off weight as a history, each n-gram
of the model what it changes. What the automaton leaves out is therefore added
by joins with the tables, and the score does not depend on the cache's size.

N-grams travel packed as numpy arrays, by parts of their hash, in ``ROUNDS``
rounds per order, each with a share of all hashes, so that only a share of them
is in a shuffle at a time. Texts are copied only where ids do not tell rows
apart, and counts go as soon as the weights made of them are written.

Words and n-grams are told apart by 64-bit hashes. Rows: a null text counts as
empty and has the end token alone; repeated rows are scored alike, each on its
own; an empty table gives no rows; without training texts every probability is
that of an unseen word. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.frames import Scratch, record
from foldwise.llm.tokens import Words, mix, signed, split_words, text_chunks
from foldwise.session import materialize

ADD = 0.1
VOCABULARY, NGRAMS = 1 << 20, 1 << 18
LEAST = 2  # occurrences of an n-gram of the model
DISCOUNT = 0.7
BLOCK_TOKENS = 1 << 22
ROUNDS, PART_GRAMS, BLOCK_GRAMS = 2, 1 << 20, 1 << 20
MAY_BITS = 22  # of a table that tells which codes may be arcs
BITS = 21  # of a word's number; the end token is number 0
END = 1  # the end token's hash

_COUNTS = pa.schema([("word", pa.int64()), ("n", pa.int64())])
_GRAMS = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64())])
_COUNT_PARTS = pa.schema([("part", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("n", pa.binary())])
_TEXT_PARTS = pa.schema([("part", pa.int32()), ("key", pa.binary()), ("n", pa.binary()), ("row", pa.binary()),
                         ("block", pa.int64())])
_BLOCK_SUMS = pa.schema([("block", pa.int64()), ("row", pa.binary()), ("more", pa.binary())])
_MORE = pa.schema([("row", pa.int64()), ("more", pa.float64())])


def _words(column: pa.Array):
    for a, b, data, begin in text_chunks(column):
        yield a, b, split_words(data, begin, lower=True)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word hash, n) over all texts, added up within tasks first."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)
            return record(_COUNTS, signed(keys), n)

        for batch in batches:
            for _, _, w in _words(batch.column(0)):
                keys, n = np.unique(w.hashes(), return_counts=True)
                held.append((keys, n))
                size += len(keys)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Frequent words: sorted hashes, their numbers (from 1), counts and
    backing-off weights by number; ``tokens``, ``kinds``: all training tokens
    and distinct ones."""

    keys: np.ndarray
    counts: np.ndarray
    rest: np.ndarray
    tokens: int
    kinds: int

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for words that are not frequent."""
        if not len(self.keys):
            return np.full(len(hashes), -1, dtype=np.int64)
        by = np.argsort(hashes)  # a sorted search stays in the cache
        hashes = hashes[by]
        at = np.searchsorted(self.keys, hashes).clip(0, len(self.keys) - 1)
        out = np.empty(len(hashes), dtype=np.int64)
        out[by] = np.where(self.keys[at] == hashes, at + 1, -1)
        return out

    def base(self, n) -> float:
        return math.log10((n + ADD) / (self.tokens + ADD * (self.kinds + 1)))


def with_end(numbers: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts with the end token after each text, and the
    places at which texts begin."""
    ends = w.first[1:]
    return np.insert(numbers, ends, 0), w.first + np.arange(len(w.first))


def _pack(values: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane (planes that hardly change
    compress to nothing)."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * np.uint64(0xD6E8FEB86659FD93) + y)


def _grams(w: Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all n-grams: the hash, the hashes of the two parts it is made of (a
    pair's words, a triple's pairs) and the number of the text."""
    words, first = np.insert(w.hashes(), w.first[1:], np.uint64(END)), w.first + np.arange(len(w.first))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for _ in range(order - 1):
        x, y = words[:-1], words[1:]
        words = _joined(x, y)
    ok = text[:len(words)] == text[len(text) - len(words):]  # none crosses texts
    return words[ok], x[ok], y[ok], text[:len(ok)][ok]


def _sums(row: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and their sums."""
    own, inverse = np.unique(row, return_inverse=True)
    return own, np.bincount(inverse, weights=each, minlength=len(own))


def _rounds(order: int) -> list[tuple[int, int]]:
    return [(order, k) for k in range(ROUNDS)]


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, by its upper bits: sorted keys lie part by part."""
    return ((keys >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``keys`` and the places in it at which a key begins."""
    by = np.argsort(keys)
    ordered = keys[by]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return by, np.flatnonzero(new)


def _by_part(schema: pa.Schema, part: np.ndarray, columns: list[tuple[np.ndarray, np.ndarray | None]], *same: int):
    """A row per part; ``part`` is sorted. A column comes with the places at
    which the entries of ``part`` begin in it (None: entry by entry); ``same``
    are the values of columns that all rows have alike."""
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    ends = np.append(cuts[1:], len(part))
    out = [part[cuts]]
    for values, places in columns:
        a, b = (cuts, ends) if places is None else (places[cuts], places[ends])
        out.append([_pack(values[i:j]) for i, j in zip(a.tolist(), b.tolist())])
    return record(schema, *out, *(np.full(len(cuts), v) for v in same))


def ngram_counts(texts: DataFrame, order: int, tokens: int, keep: Scratch) -> DataFrame:
    """(key, x, y, n) of all pairs or triples seen ``LEAST`` times or more."""
    parts = tokens // (ROUNDS * PART_GRAMS) + 1

    def blocks(turn):
        def run(batches):
            held, size = [], 0

            def flush():
                key, x, y = (np.concatenate([h[k] for h in held]) for k in range(3))
                by, places = _runs(key)
                n, at = np.diff(np.append(places, len(key))), by[places]
                return _by_part(_COUNT_PARTS, _part(key[at], parts), [(x[at], None), (y[at], None), (n, None)])

            for batch in batches:
                for _, _, w in _words(batch.column(0)):
                    key, x, y, _ = _grams(w, order)
                    own = key % np.uint64(ROUNDS) == turn
                    held.append((key[own], x[own], y[own]))
                    size += int(own.sum())
                    if size >= BLOCK_GRAMS:
                        yield flush()
                        held, size = [], 0
            if size:
                yield flush()

        return run

    def add_up(rows: pa.Table) -> pa.Table:
        x, y, n = (np.concatenate([_unpack(v.as_buffer()) for v in rows[c]]) for c in ("x", "y", "n"))
        key = _joined(x, y)
        by, places = _runs(key)
        n = np.add.reduceat(n[by].view(np.int64), places)  # no part is without an n-gram
        ok = n >= LEAST
        at = by[places[ok]]
        return pa.Table.from_batches([record(_GRAMS, signed(key[at]), signed(x[at]), signed(y[at]), n[ok])])

    done = []
    for _, turn in _rounds(order):
        found = texts.select("text").mapInArrow(blocks(turn), "part int, x binary, y binary, n binary")
        found = found.groupBy("part").applyInArrow(lambda rows: add_up(rows), "key long, x long, y long, n long")
        done.append(keep(found, f"lm-{order}-grams"))
    return reduce(DataFrame.unionAll, done)


@dataclass
class Model:
    """The cached part: ``pairs``, ``triples``: sorted codes; probabilities of
    their last words; ``pair_rest``: the pairs' backing-off weights."""

    vocabulary: Vocabulary
    pairs: np.ndarray
    pair_p: np.ndarray
    pair_rest: np.ndarray
    triples: np.ndarray
    triple_p: np.ndarray


@dataclass
class Tables:
    """What the whole model is: ``words`` (word, n, rest), and the values of
    all n-grams that the automaton leaves out by order (key, value)."""

    words: DataFrame
    values: dict[int, DataFrame]


class Automaton:
    """States: 0 has no history, a word's state its number + 1, a pair's state
    a higher number. ``arcs`` are sorted codes ``state << BITS | word`` with
    their weights. A history has a state if backing off from it has a weight."""

    def __init__(self, m: Model):
        v = m.vocabulary
        mask = (1 << BITS) - 1
        self.root = np.log10((v.counts + ADD) / (v.tokens + ADD * (v.kinds + 1)))
        left, right = m.pairs >> BITS, m.pairs & mask
        word_state = np.where(v.rest < 1, np.arange(len(v.counts)) + 1, 0)
        word_state[0] = 0  # nothing follows the end token
        self.word_state = word_state
        history = np.flatnonzero(m.pair_rest < 1)
        after_pair = word_state[right]
        after_pair[history] = len(v.counts) + 1 + np.arange(len(history))
        # both pairs of a triple are at least as frequent as the triple
        at = np.searchsorted(m.pairs, m.triples >> BITS)
        codes = np.concatenate([((left + 1) << BITS) | right, (after_pair[at] << BITS) | (m.triples & mask)])
        order = np.argsort(codes)
        self.arcs = codes[order]
        self.weight = np.log10(np.concatenate([m.pair_p, m.triple_p]))[order]
        self.after = np.concatenate([after_pair, np.zeros(len(m.triples), dtype=np.int64)])[order]
        self.rest = np.concatenate([[0.0], np.log10(v.rest), np.log10(m.pair_rest[history])])
        # which codes can be arcs, by a hash: most are none
        self.may = np.zeros(1 << MAY_BITS, dtype=bool)
        self.may[self._place(self.arcs)] = True

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MAY_BITS)

    def _arcs(self, states: np.ndarray, words: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places ``where``: those that have an arc, and the arcs."""
        codes = states[where] << BITS | words[where]
        may = np.flatnonzero(self.may[self._place(codes)])
        codes, where = codes[may], where[may]
        if not len(codes):
            return where, codes
        at = np.searchsorted(self.arcs, codes).clip(0, len(self.arcs) - 1)
        hit = self.arcs[at] == codes
        return where[hit], at[hit]

    def walk(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log10 weight at every place of the texts that begin at ``first`` in
        the word numbers ``ids``. The state before a place follows from the two
        words before it, so all places step at once: from the state along an
        arc, or along failure arcs to the word's state and to no history. A
        word that is not frequent (-1) has no arc anywhere; its own
        probability is left to the caller."""
        known = ids >= 0
        short = np.zeros(len(ids), dtype=np.int64)  # the state of the word before, and after each word
        ends = np.where(known, self.word_state[ids], 0)
        short[1:] = ends[:-1]
        short[first[first < len(ids)]] = 0
        # arcs of words' states: weights where no longer history has an arc, and the state after them
        place, arc = self._arcs(short, ids, np.flatnonzero((short > 0) & known))
        by_word = np.where(known, self.root[ids], 0.0) + self.rest[short]
        by_word[place] = self.weight[arc]
        ends[place] = self.after[arc]
        state = np.zeros(len(ids), dtype=np.int64)
        state[1:] = ends[:-1]
        state[first[first < len(ids)]] = 0
        deep = np.flatnonzero(state != short)
        by_word[deep] += self.rest[state[deep]]
        place, arc = self._arcs(state, ids, deep[known[deep]])
        by_word[place] = self.weight[arc]
        return by_word

    def traverse(self, numbers: list[int]) -> float:
        """Log10 weight of one text's word numbers."""
        return float(self.walk(np.array(numbers, dtype=np.int64), np.zeros(1, dtype=np.int64)).sum())


def _rest(used: Column, total: Column) -> Column:
    """What discounting leaves to the shorter history."""
    return F.coalesce(F.greatest(F.lit(1e-9), F.least(F.lit(1.0), 1 - used / total)), F.lit(1.0))


def learn(texts: DataFrame) -> tuple[Model, Tables]:
    """The model of all ``texts``: its cached part and the tables."""
    with Scratch(texts.sparkSession) as keep:
        return _learn(texts, keep)


def _learn(texts: DataFrame, keep: Scratch) -> tuple[Model, Tables]:
    counts = keep(word_counts(texts), "lm-words")
    n_texts = texts.count()
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = total + n_texts, kinds + (n_texts > 0)
    norm = float(tokens + ADD * (kinds + 1))
    least, enough = max(1, math.ceil(tokens / VOCABULARY)), max(LEAST, math.ceil(tokens / NGRAMS))

    pairs, triples = (ngram_counts(texts, k, tokens, keep) for k in (2, 3))
    used = F.sum(F.col("n") - DISCOUNT).alias("used")
    end = texts.sparkSession.createDataFrame([(END, n_texts)], "word long, n long")
    words = counts.join(pairs.groupBy(F.col("x").alias("word")).agg(used), "word", "left").select(
        "word", "n", _rest(F.col("used"), F.col("n")).alias("rest"))
    words = materialize(words.unionAll(end.withColumn("rest", F.lit(1.0))), "lm-word-weights")
    keep.free("lm-words")

    unigram = (F.col("n") + ADD) / norm
    left = words.select(F.col("word").alias("x"), F.col("n").alias("n_x"), F.col("rest").alias("rest_x"))
    right = words.select(F.col("word").alias("y"), unigram.alias("p_y"))
    cached = F.col("n") >= enough
    x, y = (F.when(cached, F.col(c)).alias(c) for c in "xy")

    def changed(grams: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        """(key, x, y, n, p, value): the probability of the last word and what
        it changes. A join carries on only what later steps need."""
        share = ((F.col("n") - DISCOUNT) / F.col("n_x")).alias("share")
        p = (F.col("share") + F.col("rest_x") * F.col("p_y")).alias("p")
        value = (F.log10("p") - F.log10("p_y") - F.log10("rest_x")).alias("value")
        met = grams.join(left, "x").select("key", x, "y", "n", share, "rest_x").join(right, "y")
        return met.select("key", "x", y, "n", p, "p_y", "rest_x").select("key", "x", "y", "n", "p", value)

    pairs = (changed(pairs, left, right).join(triples.groupBy(F.col("x").alias("key")).agg(used), "key", "left")
             .withColumn("rest", _rest(F.col("used"), F.col("n"))))
    value = (F.col("value") + F.log10("rest")).alias("value")
    pairs = materialize(pairs.select("key", "x", "y", "n", "p", "rest", value), "lm-pair-weights")
    keep.free("lm-2-grams")
    left = pairs.select(F.col("key").alias("x"), F.col("n").alias("n_x"), F.col("rest").alias("rest_x"))
    right = pairs.select(F.col("key").alias("y"), F.col("p").alias("p_y"))
    triples = materialize(changed(triples, left, right), "lm-triple-weights")

    top = words.where((F.col("n") >= least) & (F.col("word") != END)).toArrow()  # VOCABULARY rows at most
    keys = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    vocabulary = Vocabulary(keys[order], np.concatenate([[n_texts], top["n"].to_numpy()[order]]),
                            np.concatenate([[1.0], top["rest"].to_numpy()[order]]), tokens, kinds)

    def numbers(hashes):
        hashes = hashes.to_numpy().view(np.uint64)
        return np.where(hashes == END, 0, vocabulary.numbers(hashes))

    got = pairs.where(cached).select("key", "x", "y", "p", "rest").toArrow()  # NGRAMS rows at most, as triples
    codes = numbers(got["x"]) << BITS | numbers(got["y"])
    by_key, by_code = np.argsort(got["key"].to_numpy()), np.argsort(codes)
    more = triples.where(cached).select("x", "y", "p").toArrow()
    x, y = (by_key[np.searchsorted(got["key"].to_numpy(), more[c].to_numpy(), sorter=by_key)] for c in "xy")
    threes = codes[x] << BITS | codes[y] & ((1 << BITS) - 1)
    order = np.argsort(threes)
    model = Model(vocabulary, codes[by_code], got["p"].to_numpy()[by_code], got["rest"].to_numpy()[by_code],
                  threes[order], more["p"].to_numpy()[order])
    return model, Tables(words.where(F.col("word") != END),
                         {n: t.where(~cached).select("key", "value") for n, t in ((2, pairs), (3, triples))})


def ngram_values(texts: DataFrame, values: dict[int, DataFrame], tokens: int) -> list[DataFrame]:
    """(row, more): the sums of ``values`` over the n-grams of each text (row,
    text), one table per round. ``tokens``: of all texts."""
    parts = tokens // (ROUNDS * PART_GRAMS) + 1

    def blocks(order, turn):
        def run(batches):
            held, size = [], 0

            def flush():
                key, row = (np.concatenate([h[k] for h in held]) for k in range(2))
                by, at = _runs(key)
                places, key = np.append(at, len(key)), key[by[at]]
                # a text is in one block; its number tells blocks apart
                return _by_part(_TEXT_PARTS, _part(key, parts), [(key, None), (np.diff(places), None), (row[by], places)],
                                row.min() if len(row) else 0)

            for batch in batches:
                for a, b, w in _words(batch.column(1)):
                    key, _, _, text = _grams(w, order)
                    own = key % np.uint64(ROUNDS) == turn
                    held.append((key[own], batch.column(0).slice(a, b - a).to_numpy()[text[own]]))
                    size += int(own.sum())
                    if size >= BLOCK_GRAMS:
                        yield flush()
                        held, size = [], 0
            if size:
                yield flush()

        return run

    def add_up(found: pa.Table, known: pa.Table) -> pa.Table:
        keys = known["key"].to_numpy().view(np.uint64)
        by = np.argsort(keys)
        keys, value = keys[by], known["value"].to_numpy()[by]
        blocks, rows, sums = [], [], []
        if len(keys):
            for k, n, row, block in zip(found["key"], found["n"], found["row"], found["block"]):
                key = _unpack(k.as_buffer())
                at = np.searchsorted(keys, key).clip(0, len(keys) - 1)
                # n-grams without a value change no sum
                hit, n = keys[at] == key, _unpack(n.as_buffer()).view(np.int64)
                each = np.repeat(value[at[hit]], n[hit])
                row = _unpack(row.as_buffer()).view(np.int64)[np.repeat(hit, n)]
                if len(row):
                    own, more = _sums(row, each)
                    blocks.append(block.as_py())
                    rows.append(_pack(own))
                    sums.append(more.tobytes())
        return pa.Table.from_batches([record(_BLOCK_SUMS, blocks, rows, sums)])

    def of_block(found: pa.Table) -> pa.Table:
        row = np.concatenate([_unpack(r.as_buffer()) for r in found["row"]]).view(np.int64)
        return pa.Table.from_batches([record(_MORE, *_sums(row, np.concatenate(
            [np.frombuffer(m.as_buffer(), dtype=np.float64) for m in found["more"]])))])

    done = []
    for order, turn in _rounds(2) + _rounds(3):
        found = texts.mapInArrow(blocks(order, turn), "part int, key binary, n binary, row binary, block long").groupBy("part")
        part = F.shiftright(F.shiftrightunsigned("key", 33) * F.lit(parts), 31).cast("int")
        known = values[order].where(F.pmod("key", F.lit(ROUNDS)) == turn).withColumn("part", part).groupBy("part")
        # a row per block and part: a row per text and part would be more of them the more parts there are
        more = found.cogroup(known).applyInArrow(lambda a, b: add_up(a, b), "block long, row binary, more binary")
        more = more.groupBy("block").applyInArrow(lambda rows: of_block(rows), "row long, more double")
        done.append(materialize(more, "lm-more"))
    return done


_ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                   ("base", pa.float64()), ("score", pa.float64()), ("word", pa.int64()), ("n", pa.int64())])


def score(docs: DataFrame, model: Model, tables: Tables) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of ``docs``
    (row, doc_id, text; ``row`` is unique). One pass writes a row per document
    and one per document and infrequent word; the latter get their counts and
    weights by a join and are added up per document, as are the n-grams that
    the automaton leaves out."""
    v = model.vocabulary

    def run(batches):
        machine = Automaton(model)
        base = np.array([v.base(n) for n in v.counts.tolist()])
        for batch in batches:
            for a, b, w in _words(batch.column(2)):
                hashes = w.hashes()
                numbers = v.numbers(hashes)
                ids, first = with_end(numbers, w)
                known = np.concatenate([[0], np.cumsum(numbers >= 0)])[w.first]
                sums = np.add.reduceat(np.where(ids >= 0, base[ids], 0.0), first[:-1])  # no text is without a token
                scores = np.add.reduceat(machine.walk(ids, first), first[:-1])
                rows = batch.column(0).slice(a, b - a).to_numpy()
                none = pa.nulls(b - a, pa.int64())
                yield record(_ROWS, rows, batch.column(1).slice(a, b - a), np.diff(first),
                             np.diff(known) + int(v.counts[0] > 0), sums, scores, none, none)
                rare = numbers < 0
                if rare.any():
                    doc, word = w.doc_of()[rare], hashes[rare]
                    order = np.lexsort((word, doc))
                    doc, word = doc[order], word[order]
                    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])
                    at = np.flatnonzero(new)
                    n, none = len(at), pa.nulls(len(at), pa.int64())
                    yield record(_ROWS, rows[doc[at]], none, none, none, pa.nulls(n, pa.float64()),
                                 pa.nulls(n, pa.float64()), signed(word[at]), np.diff(np.append(at, len(doc))))

    schema = ("row long, doc_id long, n_tokens long, n_known long, base double, score double, word long, n long")
    rows = materialize(docs.select("row", "doc_id", "text").mapInArrow(run, schema), "lm-rows")
    rare = rows.where("word is not null").select("row", "word", F.col("n").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0))
    norm = float(v.tokens + ADD * (v.kinds + 1))
    # infrequent words only: what is in the automaton needs no join
    least = max(1, math.ceil(v.tokens / VOCABULARY))
    added = (rare.join(tables.words.where(F.col("n") < least), "word", "left").groupBy("row")
             .agg(F.sum(F.col("times") * F.log10((count + ADD) / F.lit(norm))).alias("more"),
                  F.sum(F.col("times") * F.log10(F.coalesce("rest", F.lit(1.0)))).alias("more_rest"),
                  F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("more_known")))
    own = rows.where("word is null").drop("word", "n")
    tokens = own.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    grams = reduce(DataFrame.unionAll, ngram_values(docs.select("row", "text"), tables.values, tokens))
    grams = grams.groupBy("row").agg(F.sum("more").alias("more_grams"))
    more, rest, gram = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("more", "more_rest", "more_grams"))
    return (own.join(added, "row", "left").join(grams, "row", "left")
            .select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(int(v.tokens)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
                    (F.col("score") + more + rest + gram).alias("score")))


def lm_scores(docs: DataFrame, training: Column) -> DataFrame:
    """Scores of all ``docs`` by a model of those that ``training`` marks.
    ``docs`` is read several times: unique ids tell its rows apart as they are;
    else the rows are numbered and written, so that each keeps its number."""
    n, n_ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    own = F.col("doc_id").cast("long") if n == n_ids else F.monotonically_increasing_id()
    docs = docs.select(own.alias("row"), "doc_id", "text", training.alias("training"))
    if n != n_ids:
        docs = materialize(docs, "lm-texts")
    return score(docs, *learn(docs.where("training")))
