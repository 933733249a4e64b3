"""Toxicity by a small convolutional text classifier, trained in numpy.

Words (runs of ASCII letters and digits and of bytes of other scripts,
lower-cased) are hashed to embeddings, together with their first few bytes, so
inflected forms share what they learn; filters of several widths run over the
whole text; each filter's maximum over the text goes into a logistic output.
The model is trained on all labelled rows, dealt by their ids into shards of
bounded size: a word's odds at the start are counted over all rows, then every
shard goes through its rows for an epoch and the shards' models are averaged
for the next one. Thresholds per language are calibrated on the same rows for
a flag beside the score; language is never an input of the score.

Rows: a null or empty text has no words, its filters stay at zero, and it
scores the model's base output; repeated rows score alike; without labels of
both kinds every text scores 0.5; a null language uses the common threshold;
an empty table gives no rows. Only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.frames import Scratch, record, text_pass
from foldwise.llm.tokens import split_words, text_chunks
from foldwise.session import short_lived_shuffles

WIDTHS = (1, 2, 3)
#: a word's embedding is the sum of those of the word and of these prefixes
PREFIXES = (4, 5, 6)


@dataclass
class Settings:
    """A kind of label weighs as ``kind_rows`` rows at most, however many it
    has; a shard holds about ``shard_rows`` rows and ``shard_chars`` characters
    at most; a small table is gone over more often, to ``least_steps`` steps;
    the rest shapes the model."""

    kind_rows: int = 2000
    shard_rows: int = 4000
    shard_chars: int = 16 << 20
    buckets: int = 1 << 17
    dim: int = 12
    filters: int = 12
    epochs: int = 5
    batch: int = 64
    least_steps: int = 300
    rate: float = 0.02
    seed: int = 5
    common_threshold: float = 0.7


@dataclass
class Cnn:
    embed: np.ndarray
    filters: list[np.ndarray]  # per width: (width, dim, filters)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def scores(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        z, _ = self.forward(words, first)
        return 1 / (1 + np.exp(-z))

    def vectors(self, words: np.ndarray) -> np.ndarray:
        x = self.embed[words[0]]
        for row in words[1:]:
            x += self.embed[row]
        return x

    def forward(self, words: np.ndarray, first: np.ndarray, want_places: bool = False):
        """Output before the logistic, per text; with ``want_places`` also the
        word at which each filter's maximum begins (-1: none above zero).
        ``words`` has a row of buckets for the words and one per prefix."""
        n_docs, n = len(first) - 1, words.shape[1]
        x = self.vectors(words)
        counts = np.diff(first)
        z = np.full(n_docs, self.out_bias, dtype=np.float64)
        pools, places = [], []
        for k, width in enumerate(WIDTHS):
            has = counts >= width
            pool = np.zeros((n_docs, self.filters[k].shape[2]), dtype=np.float32)
            place = np.full(pool.shape, -1, dtype=np.int64)
            if has.any() and n >= width:
                a = x[:n - width + 1] @ self.filters[k][0]
                for j in range(1, width):
                    a += x[j:n - width + 1 + j] @ self.filters[k][j]
                a += self.bias[k]
                starts, ends = first[:-1][has], first[1:][has] - width + 1
                cuts = np.stack([starts, ends], axis=1).ravel()
                # windows that cross from one text to the next lie in the odd
                # segments; the last one runs to the end
                tail = cuts[-1] >= len(a)
                best = np.maximum.reduceat(a, cuts[:-1] if tail else cuts, axis=0)[::2]
                pool[has] = np.maximum(best, 0)
                if want_places:
                    for d, (s, e) in zip(np.flatnonzero(has), zip(starts, ends)):
                        top = s + a[s:e].argmax(0)
                        place[d] = np.where(best[np.searchsorted(starts, s)] > 0, top, -1)
            z += pool @ self.out[k]
            pools.append(pool)
            places.append(place)
        return z, (pools, places)


def hashed_words(data: np.ndarray, begin: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    w = split_words(data, begin, lower=True, separators="non_alnum")
    rows = [w.hashes()] + [w.hashes(longest=n) for n in PREFIXES]
    return np.stack([(h % np.uint64(buckets)).astype(np.int32) for h in rows]), w.first


def _counts(words, first, labels, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and other texts that hold a bucket, counted per kind of prefix."""
    doc = np.repeat(np.arange(len(labels)), np.diff(first))
    pos, neg = np.zeros((2, s.buckets))
    for row in words:
        seen = np.unique(doc * s.buckets + row)
        y, bucket = labels[seen // s.buckets], seen % s.buckets
        pos += np.bincount(bucket[y == 1], minlength=s.buckets)
        neg += np.bincount(bucket[y == 0], minlength=s.buckets)
    return pos, neg


def _initial(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, s: Settings) -> Cnn:
    """Random filters over embeddings whose first component is the bucket's
    smoothed log-odds among the training texts; the rest is random."""
    rng = np.random.default_rng(s.seed)
    embed = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    # a bucket that few texts hold says little
    embed[:, 0] = odds * (pos + neg) / (pos + neg + 20) / 6
    filters = [rng.normal(0, 0.3 / np.sqrt(w), (w, s.dim, s.filters)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
    return Cnn(embed, filters, [np.zeros(s.filters, dtype=np.float32) for _ in WIDTHS],
               np.full((len(WIDTHS), s.filters), 0.3), -1.0)


def _start(words, first, labels, s: Settings) -> Cnn:
    return _initial(*_counts(words, first, labels, s), labels.sum(), (1 - labels).sum(), s)


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, name, value, grad):
        m, v = self.state.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.99 ** self.t)) + 1e-6)


def _all_words(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    parts, firsts = [], [np.zeros(1, dtype=np.int64)]
    for _, _, data, begin in text_chunks(pa.array(texts, type=pa.large_string())):
        w, f = hashed_words(data, begin, s.buckets)
        parts.append(w)
        firsts.append(f[1:] + firsts[-1][-1])
    return np.concatenate(parts, axis=1), np.concatenate(firsts)


def _epochs(n: int, s: Settings) -> int:
    return max(s.epochs, -(-s.least_steps * s.batch // n))


def _descend(net: Cnn, words, first, y: np.ndarray, weights: np.ndarray, turns: range, epochs: int, rng, s: Settings) -> None:
    """Gradient descent on the log loss, its rows weighted by their labels;
    only the windows that hold a filter's maximum carry a gradient. ``turns``
    are those of the ``epochs`` that are gone through here."""
    adam = _Adam(s.rate)
    for epoch in turns:
        order = rng.permutation(len(y))
        adam.rate = s.rate * (1 - epoch / epochs)
        for a in range(0, len(y), s.batch):
            pick = order[a:a + s.batch]
            own = np.concatenate([words[:, first[d]:first[d + 1]] for d in pick], axis=1)
            begins = np.concatenate([[0], np.cumsum(first[pick + 1] - first[pick])])
            z, (pools, places) = net.forward(own, begins, want_places=True)
            error = (1 / (1 + np.exp(-z)) - y[pick]) * weights[y[pick]] / len(pick)
            adam.t += 1
            grad_rows, grad_vals = [], []
            for k, width in enumerate(WIDTHS):
                g_pool = error[:, None] * net.out[k][None]
                g_out = pools[k].T @ error + 1e-4 * net.out[k]
                d, f = np.nonzero(places[k] >= 0)
                at, g = places[k][d, f], g_pool[d, f]
                g_filter = np.zeros_like(net.filters[k])
                for j in range(width):
                    rows = own[:, at + j]
                    np.add.at(g_filter[j].T, f, g[:, None] * net.vectors(rows))
                    grad_rows.append(rows.ravel())
                    grad_vals.append(np.tile(g[:, None] * net.filters[k][j][:, f].T, (len(rows), 1)))
                g_bias = np.bincount(f, weights=g, minlength=s.filters).astype(np.float32)
                adam.step(("f", k), net.filters[k], g_filter)
                adam.step(("b", k), net.bias[k], g_bias)
                adam.step(("o", k), net.out[k], g_out)
            net.out_bias -= adam.rate * float(np.clip(error.sum(), -1, 1)) * 5
            if grad_rows:
                rows, vals = np.concatenate(grad_rows), np.concatenate(grad_vals)
                np.subtract.at(net.embed, rows, adam.rate * 5 * vals.astype(np.float32))


def train(texts: list[str], labels: list[int], settings: Settings | None = None) -> Cnn | None:
    """A model of texts that fit into memory."""
    s = settings or Settings()
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return None
    words, first = _all_words(texts, s)
    net, epochs = _start(words, first, y, s), _epochs(len(y), s)
    _descend(net, words, first, y, np.ones(2), range(epochs), epochs, np.random.default_rng(s.seed + 1), s)
    return net


#: what a shard sends is cut into this many parts, which are added up apart
PARTS = 32
_SUMS = "part int, shard int, vals binary, seen binary"
_PARTIAL = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("vals", pa.binary()), ("seen", pa.binary())])


def _packed(rows: DataFrame) -> DataFrame:
    """(shard, packed): a shard's rows in order, compressed, as one value: every
    epoch reads it anew, and none shuffles texts."""

    def work(table: pa.Table) -> pa.Table:
        shard, sink = table["shard"][0].as_py(), pa.BufferOutputStream()
        table = table.drop_columns("shard").sort_by([("place", "ascending"), ("doc_id", "ascending")])
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pa.table({"shard": pa.array([shard], type=pa.int32()), "packed": pa.array([sink.getvalue().to_pybytes()])})

    return rows.groupBy("shard").applyInArrow(work, "shard int, packed binary")


def _shards(batches) -> Iterator[tuple[int, pa.Table]]:
    for batch in batches:
        for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield shard, pa.ipc.open_stream(packed.as_buffer()).read_all()


def _sums(packed: DataFrame, work, settings: Settings) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{part: (sums, seen)} over what ``work(words, first, labels, shard)`` gives
    of every shard: (part, vals, seen), a row of vals for every cell it has seen."""

    def own(batches):
        for shard, table in _shards(batches):
            words, first = _all_words(table["text"].to_pylist(), settings)
            labels = np.array(table["toxic"].to_pylist(), dtype=np.int64)
            for part, vals, seen in work(words, first, labels, shard):
                vals = vals.astype(np.float32 if part < PARTS else np.float64)
                yield record(_PARTIAL, [part], [shard], [vals.tobytes()], [seen.astype(np.uint8).tobytes()])

    def total(table: pa.Table) -> pa.Table:
        table, part, sums = table.sort_by("shard"), table["part"][0].as_py(), None
        for vals, mask in zip(table["vals"], table["seen"]):
            mask = np.frombuffer(mask.as_buffer(), dtype=np.uint8) > 0
            if sums is None:
                seen = np.zeros(len(mask), dtype=np.int64)
            seen += mask
            if mask.any():
                vals = np.frombuffer(vals.as_buffer(), dtype=np.float32 if part < PARTS else np.float64)
                vals = vals.reshape(int(mask.sum()), -1)
                if sums is None or sums.shape[1] != vals.shape[1]:
                    sums = np.zeros((len(mask), vals.shape[1]))
                sums[mask] += vals
            elif sums is None:
                sums = np.zeros((len(mask), 0))
        return pa.Table.from_batches([record(_PARTIAL, [part], [0], [sums.tobytes()], [seen.tobytes()])])

    with short_lived_shuffles(packed.sparkSession):
        got = packed.mapInArrow(own, _SUMS).groupBy("part").applyInArrow(total, _SUMS).toArrow()
    out = {}
    for part, sums, seen in zip(*(got[c].to_pylist() for c in ("part", "vals", "seen"))):
        seen = np.frombuffer(seen, dtype=np.int64)
        out[part] = np.frombuffer(sums, dtype=np.float64).reshape(len(seen), -1), seen
    return out


def _spread(sums: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and how often seen, of all cells in a row."""
    cells = [c if c.shape[1] else np.zeros((len(c), width)) for c, _ in (sums[p] for p in range(PARTS))]
    return np.concatenate(cells), np.concatenate([sums[p][1] for p in range(PARTS)])


def _cells(values: np.ndarray, seen: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for part, (v, n) in enumerate(zip(np.array_split(values, PARTS), np.array_split(seen, PARTS))):
        yield part, v[n], n


def _count_shard(s: Settings):
    """Of a shard the texts that hold a bucket, toxic ones and others."""

    def work(words, first, labels, shard):
        both = np.stack(_counts(words, first, labels, s), axis=1)
        return _cells(both, both.any(axis=1))

    return work


def _train_shard(net: Cnn, weights: np.ndarray, turns: range, epochs: int, s: Settings):
    """A shard's model after its turns: the embeddings it changed, last all
    other values."""

    def work(words, first, labels, shard):
        own = Cnn(net.embed.copy(), [f.copy() for f in net.filters], [b.copy() for b in net.bias], net.out.copy(), net.out_bias)
        rng = np.random.default_rng(s.seed + 1 if len(turns) == epochs else [s.seed + 1, shard, turns[0]])
        _descend(own, words, first, labels, weights, turns, epochs, rng, s)
        yield from _cells(own.embed, (own.embed != net.embed).any(axis=1))
        yield PARTS, _others(own), np.ones(1)

    return work


def _others(net: Cnn) -> np.ndarray:
    parts = [*net.filters, *net.bias, net.out, np.array([net.out_bias])]
    return np.concatenate([x.ravel().astype(np.float64) for x in parts])


def _averaged(net: Cnn, sums: dict) -> Cnn:
    """The mean of the shards' models: of a bucket's embedding over the shards
    that changed it, of all else over all (they are of about one size)."""
    cells, seen = _spread(sums, net.embed.shape[1])
    embed = net.embed.copy()
    embed[seen > 0] = cells[seen > 0] / seen[seen > 0, None]
    flat, at, out = (sums[PARTS][0] / sums[PARTS][1]).ravel(), 0, []
    for like in [*net.filters, *net.bias, net.out]:
        out.append(flat[at:at + like.size].reshape(like.shape).astype(like.dtype))
        at += like.size
    k = len(WIDTHS)
    return Cnn(embed, out[:k], out[k:2 * k], out[2 * k], float(flat[at]))


GRID = np.arange(0.05, 1.0, 0.05)


def calibrate(net: Cnn, packed: DataFrame, s: Settings) -> None:
    """Per language of 50 rows or more the threshold with the best F1 (ties:
    the one nearest to the common threshold)."""
    schema = pa.schema([("lang", pa.string()), ("toxic", pa.int32()), ("passed", pa.int32())])

    def work(batches):
        for _, table in _shards(batches):
            for a, b, data, begin in text_chunks(pa.array(table["text"].to_pylist(), type=pa.large_string())):
                scores = net.scores(*hashed_words(data, begin, len(net.embed)))
                rows = table.slice(a, b - a)
                yield record(schema, rows["lang"].to_pylist(), rows["toxic"].to_pylist(),
                             (scores[:, None] >= GRID).sum(1).astype(np.int32))

    places = packed.mapInArrow(work, "lang string, toxic int, passed int").where("lang <> ''")
    counts: dict[str, np.ndarray] = {}
    for r in places.groupBy("lang", "toxic", "passed").count().collect():
        counts.setdefault(r["lang"], np.zeros((2, len(GRID) + 1), dtype=np.int64))[r["toxic"], r["passed"]] = r["count"]
    for name, c in counts.items():
        toxic, n = c[1].sum(), c.sum()
        if n >= 50 and 0 < toxic < n:
            hit, right = (x[::-1].cumsum()[::-1][1:] for x in (c.sum(0), c[1]))
            f1 = 2 * right / (hit + toxic)
            net.thresholds[str(name)] = float(GRID[np.lexsort((np.abs(GRID - s.common_threshold), -f1))[0]])


def _dealt(docs: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """The rows of ``docs`` with a known label, their places and shards. Joined
    the same way whatever the size: a broadcast of labels serves small tables only."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    rows = docs.select("doc_id", "text", "lang").join(known.hint("merge"), "doc_id").withColumn("place", place)
    return rows.withColumn("shard", F.shiftright(F.col("place") * shards, 30).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Cnn | None:
    """A model of all labelled documents. An id's place in the order of rows,
    and with it its shard, depends on the id alone. Only sums over the shards
    reach the driver, as large as the model."""
    s = settings or Settings()
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known, given = known.where("toxic in (0, 1)"), docs.where("text is not null")
    sizes = {int(r["toxic"]): (r["n"], r["chars"]) for r in given.select("doc_id", F.length("text").alias("chars")).join(
        known, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    if len(sizes) < 2:
        return None
    n = np.array([sizes[0][0], sizes[1][0]])
    share = np.minimum(1.0, s.kind_rows / n)
    weights, epochs = share * n.sum() / (share * n).sum(), _epochs(int(n.sum()), s)
    shards = max(-(-int(n.sum()) // s.shard_rows), -(-(sizes[0][1] + sizes[1][1]) // s.shard_chars))
    rows = _dealt(given, known, shards)
    with Scratch(docs.sparkSession) as keep:
        packed = keep(_packed(rows), "toxicity-shards")
        counts, _ = _spread(_sums(packed, _count_shard(s), s), 2)
        net = _initial(counts[:, 0], counts[:, 1], n[1], n[0], s)
        for turns in ([range(epochs)] if packed.count() == 1 else [range(e, e + 1) for e in range(epochs)]):
            net = _averaged(net, _sums(packed, _train_shard(net, weights, turns, epochs, s), s))
        calibrate(net, packed, s)
    return net


_RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()),
                     ("flagged", pa.bool_())])


def score(docs: DataFrame, net: Cnn | None, settings: Settings | None = None) -> DataFrame:
    """One row per document: score, decision at the common threshold, and the
    flag at the threshold of the document's language."""
    s = settings or Settings()

    def work(rows, data, begin):
        p = np.full(rows.num_rows, 0.5) if net is None else net.scores(*hashed_words(data, begin, len(net.embed)))
        limit = np.array([net.thresholds.get(x, s.common_threshold) if net else s.common_threshold
                          for x in rows.column(2).to_pylist()])
        return record(_RESULT, rows.column(0), p, (p >= s.common_threshold).astype(np.int32), p >= limit)

    return text_pass(docs.select("doc_id", "text", "lang"), work,
                     "doc_id long, score double, predicted int, flagged boolean")
