"""Substring dedup by seeds and window hashes.

A repeat is a window of ``LENGTH`` words that also begins earlier (smaller
document, or earlier in the same one). Seeds: every window of words holds a
winnowed anchor, the k-gram with the least hash among those of the window, and
equal windows hold the same one. Anchors are joined over the corpus; those
that occur once cannot lie in a repeat. No match is extended from the others:
every window that such an anchor stands for is looked up by a 96-bit hash, and
all but the earliest of equal windows are repeats. Consecutive repeats merge into maximal spans.

Skew: a task sends one row per anchor, whatever number of copies it holds, and
finds the others to be repeated by itself; exact copies of a whole document
are found by a digest and take no part in the window join. Sorted streams take
the place of groups, so no group is ever held in memory.

Rows: a null or empty text has no words; a text shorter than a window loses
nothing; ids order documents (a null id first) and rows that repeat both id
and text count as one document; an empty table gives no rows. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.frames import record, text_pass
from foldwise.llm.tokens import signed, split_words, text_chunks, windows
from foldwise.operators.ranking import positions
from foldwise.session import materialize

LENGTH, ANCHOR = 20, 8
#: rows a task holds before it sends them on
FLUSH = 1 << 22
_I = pa.int64()


def _keyed(docs: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as (key, text), and ``facts`` with their keys, in the order
    of their ids. The ids themselves are the keys where they are unique; else
    documents are numbered by id (a null first) and a hash of their text."""
    n, n_ids = facts.agg(F.count("*"), F.count_distinct("doc_id")).first()
    text = F.coalesce("text", F.lit("")).alias("text")
    if n == n_ids:
        return docs.select(F.col("doc_id").alias("key"), text), facts.withColumn("key", F.col("doc_id"))
    keys = materialize(positions(facts, [], ["doc_id", "a", "b"], "key"), "substring-keys")
    texts = docs.select(F.col("doc_id").alias("id"), text).withColumn("hash", F.xxhash64("text"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("a"))
    return texts.dropDuplicates(["id", "hash"]).join(keys, same).select("key", "text"), keys


def document_facts(docs: DataFrame) -> DataFrame:
    """Per row: id, hash of the text, half a digest of its words, their
    number, and the SHA-256 of the words joined by single spaces."""
    schema = pa.schema([("doc_id", _I), ("a", _I), ("b", _I), ("n_words", _I), ("joined_sha256", pa.string())])

    def work(rows, data, begin):
        whole, out = data.tobytes(), []
        for x, y in zip(begin[:-1].tolist(), begin[1:].tolist()):
            words = whole[x:y].split()
            joined = hashlib.sha256(b" ".join(words))
            out.append((int.from_bytes(joined.digest()[:8], "little", signed=True), len(words), joined.hexdigest()))
        return record(schema, rows.column(0), rows.column(1), *[[o[k] for o in out] for k in range(3)])

    plain = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("a"), "text")
    return text_pass(plain, work, "doc_id long, a long, b long, n_words long, joined_sha256 string")


def winnowed(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows' first words, the place of each window's anchor, and the
    anchors (places, hashes): the leftmost least k-gram of the window."""
    at, grams = windows(hashes, first, ANCHOR)
    span = LENGTH - ANCHOR + 1
    starts, _ = windows(hashes, first, LENGTH)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64)
    # least of ``span`` k-grams by doubling; ties go to the left
    place = np.searchsorted(at, starts)
    best = np.arange(len(at))
    reach = 1
    while reach * 2 <= span:
        left, right = best[:-reach], best[reach:]
        merged = np.where(grams[right] < grams[left], right, left)
        best = np.concatenate([merged, best[len(merged):]])
        reach *= 2
    left, right = best[place], best[place + span - reach]
    pick = np.where(grams[right] < grams[left], right, left)
    chosen = np.unique(pick)
    return starts, at[pick], at[chosen], grams[chosen]



_ANCHOR = pa.schema([("anchor", _I), ("key", _I), ("place", _I), ("repeated", pa.bool_()), ("send", pa.bool_())])
_ANCHOR_SCHEMA = "anchor long, key long, place long, repeated boolean, send boolean"


def _once_each(order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From a sort and which neighbours in it are equal: whether each row has
    an equal one, and whether it is the first of its equals."""
    repeated, send = np.zeros(len(order), dtype=bool), np.ones(len(order), dtype=bool)
    repeated[order[1:]] |= same
    repeated[order[:-1]] |= same
    send[order[1:]] &= ~same
    return repeated, send


def _parts(schema: pa.Schema, *columns: np.ndarray):
    for x in range(0, len(columns[0]), 1 << 17):
        yield record(schema, *[c[x:x + (1 << 17)] for c in columns])


def anchors(texts: DataFrame) -> DataFrame:
    """Anchors of all texts; of equal anchors in one task only the first has
    ``send``, and all of them are known to be ``repeated``."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, keys, places = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            yield from _parts(_ANCHOR, signed(h), keys, places, *_once_each(order, h[order][1:] == h[order][:-1]))

        for batch in batches:
            for x, y, data, begin in text_chunks(batch.column(1)):
                keys = batch.column(0).slice(x, y - x).to_numpy(zero_copy_only=False)
                w = split_words(data, begin)
                _, _, places, hashes = winnowed(w.hashes(), w.first)
                doc = np.searchsorted(w.first, places, side="right") - 1
                held.append((hashes, keys[doc], places - w.first[doc]))
                size += len(hashes)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return texts.mapInArrow(run, _ANCHOR_SCHEMA)


def _met_again(batches):
    """From a stream sorted by anchor: the rows whose anchor has another row,
    or that are known to be repeated. The last row of a batch is decided with
    the next one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=_ANCHOR)
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h = batch.column(0).to_numpy(zero_copy_only=False)
        same = np.concatenate([[False], h[1:] == h[:-1], [False]])
        keep = same[1:] | same[:-1] | batch.column(3).to_numpy(zero_copy_only=False)
        done = batch.slice(0, len(h) - 1).filter(pa.array(keep[:-1]))
        if done.num_rows:
            yield done
        last = batch.slice(len(h) - 1).columns
        held = pa.RecordBatch.from_arrays([*last[:3], pa.array([bool(keep[-1])]), last[4]], schema=_ANCHOR)
    if held is not None and held.column(3)[0].as_py():
        yield held


def seeds(texts: DataFrame) -> DataFrame:
    """(key, places): the places of every text's repeated anchors."""
    rows = materialize(anchors(texts), "substring-anchors")
    met = (rows.where("send").repartition("anchor").sortWithinPartitions("anchor")
           .mapInArrow(_met_again, _ANCHOR_SCHEMA))
    found = met.select("key", "place").union(rows.where("repeated and not send").select("key", "place"))
    return found.groupBy("key").agg(F.collect_list("place").alias("places"))


_WINDOW = pa.schema([("w1", _I), ("w2", _I), ("key", _I), ("place", _I), ("send", pa.bool_())])
_WINDOW_SCHEMA = "w1 long, w2 long, key long, place long, send boolean"


def window_rows(affected: DataFrame) -> DataFrame:
    """Hashes (96 bits) of the windows that stand on a repeated anchor. Of
    equal windows in one task only the earliest has ``send``."""

    def run(batches):
        held, size = [], 0

        def flush():
            w1, w2, keys, places = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((places, keys, w2, w1))
            same = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
            yield from _parts(_WINDOW, signed(w1), signed(w2), keys, places, _once_each(order, same)[1])

        for batch in batches:
            for x, y, data, begin in text_chunks(batch.column(1)):
                w = split_words(data, begin)
                h = w.hashes()
                starts, anchor_of, _, _ = winnowed(h, w.first)
                if not len(starts):
                    continue
                seed = np.zeros(len(h), dtype=bool)
                places = batch.column(2).slice(x, y - x)
                of = np.repeat(np.arange(y - x), np.diff(places.offsets.to_numpy()))
                seed[w.first[of] + places.flatten().to_numpy()] = True
                ok = seed[anchor_of]
                doc = np.searchsorted(w.first, starts[ok], side="right") - 1
                _, w1 = windows(h, w.first, LENGTH)
                _, w2 = windows(w.hashes(1), w.first, LENGTH, lane=1)
                keys = batch.column(0).slice(x, y - x).to_numpy(zero_copy_only=False)
                held.append((w1[ok], w2[ok] >> np.uint64(32), keys[doc], starts[ok] - w.first[doc]))
                size += int(ok.sum())
                if size >= FLUSH // 4:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return affected.select("key", "text", "places").mapInArrow(run, _WINDOW_SCHEMA)


def _not_first(batches):
    """From a stream sorted by window and place: all rows but the first of
    each window."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        again = np.concatenate([[last == (a[0], b[0])], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        last = a[-1], b[-1]
        if again.any():
            yield batch.filter(pa.array(again))


def repeats(affected: DataFrame) -> DataFrame:
    """(key, places): where windows begin that begin earlier, too."""
    rows = window_rows(affected)
    order = ["w1", "w2", "key", "place"]
    later = (rows.where("send").repartition("w1", "w2").sortWithinPartitions(*order)
             .mapInArrow(_not_first, _WINDOW_SCHEMA))
    return (later.select("key", "place").union(rows.where("not send").select("key", "place"))
            .groupBy("key").agg(F.collect_list("place").alias("places")))


_CUT = pa.schema([("key", _I), ("n_removed", _I), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(_I))),
                  ("kept_text", pa.string())])


def cut_out(texts: DataFrame, with_text: bool) -> DataFrame:
    """Texts (key, text, places) without their repeats: the maximal spans of
    words that went, and what is left."""

    def run(batches):
        for batch in batches:
            for key, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.encode("utf-8").split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(edge, places, 1)
                np.add.at(edge, np.array(places) + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                change = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                yield record(_CUT, [key], [int(gone.sum())], [hashlib.sha256(left).hexdigest()],
                             [change.reshape(-1, 2).tolist()], [left.decode("utf-8") if with_text else None])

    return texts.select("key", "text", "places").mapInArrow(
        run, "key long, n_removed long, kept_sha256 string, spans array<array<long>>, kept_text string")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, the removed
    spans (word places, end exclusive) and, on demand, the kept text."""
    facts = materialize(document_facts(docs).dropDuplicates(["doc_id", "a"]), "substring-facts")
    texts, facts = _keyed(docs, facts)
    first = facts.groupBy("a", "b").agg(F.min("key").alias("first_key"))
    facts = materialize(facts.join(first, ["a", "b"]).select(
        "key", "doc_id", "n_words", "joined_sha256", (F.col("key") > F.col("first_key")).alias("is_copy")), "substring-docs")
    whole = F.col("is_copy") & (F.col("n_words") >= LENGTH)
    found = seeds(texts).join(facts.where(~F.col("is_copy")).select("key"), "key", "left_semi")
    affected = materialize(texts.join(found, "key"), "substring-affected")
    cut = cut_out(affected.select("key", "text").join(repeats(affected), "key"), with_text)
    none = F.sha2(F.lit(""), 256)
    out = facts.join(cut, "key", "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, none).otherwise(F.coalesce("kept_sha256", "joined_sha256")).alias("kept_sha256"),
        F.when(whole, F.array(F.array(F.lit(0).cast("long"), F.col("n_words")))).otherwise(
            F.coalesce("spans", F.array().cast("array<array<bigint>>"))).alias("spans"),
        *(["kept_text"] if with_text else []))
    return out
