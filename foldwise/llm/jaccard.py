"""Exact n-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set is its distinct shingles of ``K`` words. Two documents link
when their sets' Jaccard similarity is ``PERCENT`` or more. All sets are ordered
by one global order, heavy shingles last. If two sets link, their l-prefixes
(the first ``n - ceil(0.8 n) + l`` shingles) share l shingles, for any l. Each
document picks l by the candidates its prefix is estimated to bring: where many
are expected the prefix is longer and as many shared shingles are demanded
before a pair is verified. For a pair the smaller l of the two counts.

Equal sets are one class from the start. Candidates then come in three rounds.
First, in every list of documents that share a shingle, each is paired with the
list's first only; verified pairs make components. Second, documents that are
beside each other in a list and of two components are paired, one pair for each
two components. Third, pairs of one list whose components still differ are all
met; what is linked already needs no pair. So no link is lost and copies never
give all their pairs. The third round meets a pair at the first shingle that both
1-prefixes hold, not at all of them: a run of shingles that follow each other in
both is met at its first, and only as far up as the places before it can belong
to one of the sets alone.

Each set has a sketch of ``SKETCH`` bits, the parities of its shingles by hash.
Bits in which two sketches differ stand for a shingle each that only one of the
sets holds, and sets that link differ in a ninth of their sizes' sum at most. So
a pair whose sketches differ in more bits is no candidate, and none is lost.

The order by weight uses the ``HEAVY`` most frequent shingles of all texts
(a bounded table, with counts summed over tasks); it changes the cost of the
join, never its result.

Rows: a null or wordless text has an empty set and links with nothing; fewer
than K words make one shingle; repeated rows link; a null id takes part, a
component's id is its least id that is not null; an empty table gives no rows.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.components import components
from foldwise.llm.frames import Scratch, record
from foldwise.llm.tokens import mix, signed, split_words, text_chunks, windows
from foldwise.operators.ranking import positions
from foldwise.session import materialize

K, PERCENT = 5, 80
MAX_LEVEL = 4
#: what verifying a candidate costs against reading one list entry
VERIFY_COST = 20
HEAVY, HEAVY_LOCAL = 1 << 19, 2
FLUSH = 1 << 22
#: bits of a sketch, in longs
SKETCH = 1024
BITS = [f"b{k}" for k in range(SKETCH // 64)]
#: parts of a 1-prefix that tell roughly where a shingle is in it
PLACES = 16
#: bits that mark the texts of pairs
MARKS = 1 << 23
NULL_ID = -(1 << 63)
_I, _S = pa.int64(), pa.int32()


def shingles(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted."""
    w = split_words(data, begin, lower=True)
    h = w.hashes()
    at, x = windows(h, w.first, K)
    doc = np.searchsorted(w.first, at, side="right") - 1
    counts = w.counts()
    for c in range(1, K):
        few = np.flatnonzero(counts == c)
        if len(few):
            own = h[(w.first[few][:, None] + np.arange(c)).ravel()]
            _, y = windows(own, np.arange(0, len(own) + 1, c), c)
            doc, x = np.concatenate([doc, few]), np.concatenate([x, y])
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], x[new]


_COUNT = pa.schema([("token", _I), ("n", _I)])


def heavy_shingles(texts: DataFrame, keep: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted hashes) and in how many texts they
    are, as far as a block of texts holds ``HEAVY_LOCAL`` of them or more."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= HEAVY_LOCAL
            return record(_COUNT, signed(keys[often]), n[often])

        for batch in batches:
            for _, _, data, begin in text_chunks(batch.column(0)):
                held.append(shingles(data, begin)[1])
                size += len(held[-1])
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = keep(texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")),
                  "jaccard-heavy")
    # the least count that HEAVY shingles at most reach, from a table of counts
    by_count = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("c")).toPandas()
    by_count = by_count.sort_values("n", ascending=False)
    fits = by_count["n"][by_count["c"].cumsum() <= HEAVY]
    least = int(fits.min()) if len(fits) else (1 << 16) + 1
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n")).limit(HEAVY).toArrow() if least > 1 << 16 else \
        counts.where(F.col("n") >= least).toArrow()
    keys, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefixes(doc: np.ndarray, x: np.ndarray, n_docs: int, keys: np.ndarray, weight: np.ndarray):
    """Set sizes, and for the entries of all prefixes: text, shingle, in which
    of ``PLACES`` equal parts of the 1-prefix it is, the least l whose prefix has
    it; each text's l."""
    n = np.bincount(doc, minlength=n_docs)
    df = np.zeros(len(x), dtype=np.int64)
    if len(keys):
        at = np.searchsorted(keys, x).clip(0, len(keys) - 1)
        df = np.where(keys[at] == x, weight[at], 0)
    order = np.lexsort((x, df, doc))
    doc, x, df = doc[order], x[order], df[order]
    first = np.concatenate([[0], np.cumsum(n)])
    need = (PERCENT * n + 99) // 100
    place = np.arange(len(x)) - first[doc]
    tag = np.maximum(1, place + 1 - (n - need)[doc])
    place = np.minimum(place * PLACES // (n - need + 1)[doc], PLACES - 1)
    others = np.concatenate([[0], np.cumsum(np.maximum(df - 1, 0))])
    costs = []
    for level in range(1, MAX_LEVEL + 1):
        ends = first[:-1] + np.minimum(n, n - need + level)
        entries = others[ends] - others[first[:-1]]
        # a list entry is read once; of S entries S / l documents at most share l
        costs.append(np.where(level <= np.maximum(1, need), entries * (1 + VERIFY_COST / level), np.inf))
    level = np.argmin(np.array(costs), axis=0) + 1
    keep = tag <= level[doc]
    return n, doc[keep], x[keep], place[keep], tag[keep], level


_FACTS = pa.schema([("doc_id", _I), ("a", _I), ("n", _S), ("s1", _I), ("s2", _I), *((b, _I) for b in BITS)])


def sketches(doc: np.ndarray, x: np.ndarray, n_docs: int) -> np.ndarray:
    """Per text ``SKETCH`` parities as longs, of how many shingles have a hash
    that goes to the bit."""
    bit = (mix(x ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(SKETCH)).astype(np.int64)
    odd = np.bincount(doc * SKETCH + bit, minlength=n_docs * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_docs, SKETCH), axis=1).view(np.int64)


def document_facts(docs: DataFrame) -> DataFrame:
    """Per row: id, hash of the text, set size, two sums over its shingles
    (equal for equal sets) and its sketch."""

    def run(batches):
        for batch in batches:
            for p, q, data, begin in text_chunks(batch.column(2)):
                doc, x = shingles(data, begin)
                sums = [np.zeros(q - p, dtype=np.uint64) for _ in range(2)]
                for total, salt in zip(sums, (1, 2)):
                    np.add.at(total, doc, mix(x ^ np.uint64(0x9E3779B97F4A7C15 * salt & (1 << 64) - 1)))
                yield record(_FACTS, batch.column(0).slice(p, q - p), batch.column(1).slice(p, q - p),
                             np.bincount(doc, minlength=q - p), signed(sums[0]), signed(sums[1]),
                             *np.ascontiguousarray(sketches(doc, x, q - p).T))

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("a"), text.alias("text")).mapInArrow(
        run, "doc_id long, a long, n int, s1 long, s2 long, " + ", ".join(f"{b} long" for b in BITS))


def keyed(docs: DataFrame, facts: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """(row, text) of all documents, and ``facts`` with the same row numbers.
    Unique ids serve as they are; else documents are numbered by id and hash,
    and rows that repeat both are one document."""
    n, n_ids = facts.agg(F.count("*"), F.count_distinct("doc_id")).first()
    text = F.coalesce("text", F.lit("")).alias("text")
    if n == n_ids:
        return docs.select(F.col("doc_id").alias("row"), text), facts.withColumn("row", F.col("doc_id"))
    one = facts.dropDuplicates(["doc_id", "a"])
    numbers = keep(positions(one.select("doc_id", "a"), [], ["doc_id", "a"], "row"), "jaccard-numbers")
    numbers = numbers.withColumnsRenamed({"doc_id": "_d", "a": "_a"})
    texts = docs.select(F.col("doc_id").alias("id"), text).withColumn("hash", F.xxhash64("text")).dropDuplicates(["id", "hash"])
    texts = texts.join(numbers, F.col("id").eqNullSafe(F.col("_d")) & (F.col("hash") == F.col("_a"))).select("row", "text")
    facts = facts.join(numbers, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("a") == F.col("_a")))
    return keep(texts, "jaccard-texts"), keep(facts.drop("_d", "_a"), "jaccard-facts")


# set size, part of the 1-prefix, tag, l and whether the shingle was met again, in one number
def packed(n, place, tag, level, repeated):
    return n << 12 | place << 8 | tag << 5 | level << 2 | repeated


def unpacked(name: str) -> dict[str, Column]:
    c = F.col(name)
    return {"n": F.shiftright(c, 12), "place": F.shiftright(c, 8).bitwiseAND(F.lit(PLACES - 1)),
            "tag": F.shiftright(c, 5).bitwiseAND(F.lit(7)), "level": F.shiftright(c, 2).bitwiseAND(F.lit(7))}


_ENTRY = pa.schema([("token", _I), ("row", _I), ("info", _I), ("hub", _I), ("hub_info", _I)])
_ENTRY_SCHEMA = "token long, row long, info long, hub long, hub_info long"


def prefix_entries(texts: DataFrame, keys: np.ndarray, weight: np.ndarray, first: bool) -> DataFrame:
    """Entries of all prefixes. Of the entries of one shingle in one task only
    the first is sent on (``first``); the others name it as their hub and stay
    where they are (not ``first``)."""

    def run(batches):
        held, size = [], 0

        def flush():
            rows, n, token, place, tag, level = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((rows, n, token))
            new = np.ones(len(token), dtype=bool)
            new[1:] = token[order][1:] != token[order][:-1]
            again = ~new
            again[:-1] |= ~new[1:]
            repeated = np.zeros(len(token), dtype=np.int64)
            repeated[order] = again
            hub = np.empty(len(token), dtype=np.int64)
            hub[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            info = packed(n, place, tag, level, repeated)
            pick = np.flatnonzero((hub == np.arange(len(hub))) == first)
            for k in range(0, len(pick), 1 << 17):
                s = pick[k:k + (1 << 17)]
                yield record(_ENTRY, signed(token[s]), rows[s], info[s], rows[hub[s]], info[hub[s]])

        for batch in batches:
            for p, q, data, begin in text_chunks(batch.column(1)):
                rows = batch.column(0).slice(p, q - p).to_numpy(zero_copy_only=False)
                doc, x = shingles(data, begin)
                n, d, token, place, tag, level = prefixes(doc, x, q - p, keys, weight)
                held.append((rows[d], n[d], token, place, tag, level[d]))
                size += len(d)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return texts.mapInArrow(run, _ENTRY_SCHEMA)


def _with_hubs(batches):
    """From a stream (token, row, info) sorted by shingle: entries of shingles
    that more than one entry has, each with the first entry of its shingle as
    hub. The last entry of a batch is decided with the next one."""
    head = held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        token, row, info = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
        if held is not None:
            token, row, info = (np.concatenate([[h], c]) for h, c in zip(held, (token, row, info)))
        new = np.ones(len(token), dtype=bool)
        new[1:] = token[1:] != token[:-1]
        if head is not None and head[0] == token[0]:
            new[0] = False
        which = np.cumsum(new) - 1
        hub, hub_info = row[new], info[new]
        if head is not None:  # place -1: the shingle began in an earlier batch
            hub, hub_info = np.append(hub, head[1]), np.append(hub_info, head[2])
        hub, hub_info = hub[which], hub_info[which]
        more = ~new | (info & 1 == 1)
        more[:-1] |= ~new[1:]
        done = np.flatnonzero(more[:-1])
        if len(done):
            yield record(_ENTRY, token[done], row[done], info[done], hub[done], hub_info[done])
        head = token[-1], hub[-1], hub_info[-1]
        held = token[-1], row[-1], info[-1] | int(more[-1])
    if held is not None and held[2] & 1:
        yield record(_ENTRY, *[[v] for v in (*held, head[1], head[2])])


def _own_set(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    return shingles(data, np.array([0, len(data)]))[1]


def _marked(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``texts`` without most of those that are not among ``rows``: the bits of
    a table of bounded size tell by a hash which may be, so that few texts
    meet the pairs in a shuffle."""
    place = F.xxhash64(rows.columns[0]).bitwiseAND(F.lit(MARKS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    marks = rows.groupBy(F.shiftright(place, 6).alias("mark")).agg(F.bit_or(one).alias("marks"))
    place = F.xxhash64("row").bitwiseAND(F.lit(MARKS - 1))
    held = F.call_function("shiftright", F.col("marks"), place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return texts.join(F.broadcast(marks), F.shiftright(place, 6) == F.col("mark")).where(held).select(*texts.columns)


def verified(pairs: DataFrame, texts: DataFrame, keep: Scratch) -> DataFrame:
    """Of pairs (u, v) those whose whole texts' sets link. Pairs are dealt out
    by v, whose own text leads them; a document is v of one task's documents
    and of one entry per task at most, so no v has all the others."""
    both = pairs.union(pairs.select("v", "v")).distinct()
    texts = _marked(texts, both.select("u"))
    # merged whatever the size: a broadcast of the pairs would do for few only
    rows = both.join(texts.withColumnRenamed("row", "u").hint("merge"), "u").select("v", "u", "text")
    schema = pa.schema([("u", _I), ("v", _I)])

    def run(batches):
        lead, own = None, None
        for batch in batches:
            out = []
            for v, u, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if u == v:
                    lead, own = v, _own_set(text)
                elif v == lead:
                    other = _own_set(text)
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * common >= PERCENT * (len(own) + len(other) - common):
                        out.append((u, v))
            if out:
                yield record(schema, [o[0] for o in out], [o[1] for o in out])

    dealt = (rows.select("v", "u", (F.col("u") != F.col("v")).alias("follows"), "text").repartition("v")
             .sortWithinPartitions("v", "follows"))
    return keep(dealt.mapInArrow(run, "u long, v long"), "jaccard-links")


def near(n: Column, m: Column) -> Column:
    """Whether two set sizes allow a link."""
    return (100 * F.least(n, m)) >= (PERCENT * F.greatest(n, m))


def alike(x: str, y: str, n: Column, m: Column) -> Column:
    """Whether the sketches of two sets of ``n`` and ``m`` shingles (columns
    that end in ``x`` and ``y``) allow a link: 100 * common >= PERCENT * union,
    with the symmetric difference for common and union."""
    differ = reduce(Column.__add__, [F.bit_count(F.col(b + x).bitwiseXOR(F.col(b + y))) for b in BITS])
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (n + m)


def _open_entries(entries: DataFrame, joined: DataFrame) -> DataFrame:
    """Entries (token, row, info) of lists in which components differ, with the
    component. ``joined``: (node, component) so far."""
    rows = entries.join(joined.withColumnRenamed("node", "row"), "row", "left").withColumn(
        "component", F.coalesce("component", "row"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return rows.join(mixed.select("token"), "token", "left_semi")


def _neighbours(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): entries that follow each other in a list, by size and in a mixed
    order, and are of two components, as far as sizes and sketches allow a
    link; of each two components the pair that meets most often."""
    own, before = unpacked("info"), unpacked("before.info")
    facts = F.struct("row", "info", "component")
    met = []
    for order in ([own["n"], F.col("row")], [F.xxhash64("row"), F.col("row")]):
        rows = entries.withColumn("before", F.lag(facts).over(Window.partitionBy("token").orderBy(*order)))
        rows = rows.where(F.col("component") != F.col("before.component")).where(near(own["n"], before["n"]))
        ends = F.struct("row", "component"), F.struct("before.row", "before.component")
        met.append(rows.select(F.greatest(*ends).alias("x"), F.least(*ends).alias("y")))
    pairs = met[0].union(met[1]).groupBy("x", "y").agg(F.count("*").alias("times")).select(
        F.col("x.row").alias("u"), F.col("y.row").alias("v"), "times",
        F.least("x.component", "y.component").alias("lo"), F.greatest("x.component", "y.component").alias("hi"))
    for end in "uv":
        pairs = pairs.join(sets.withColumnsRenamed({c: c + end for c in ("n", *BITS)}).withColumnRenamed("row", end), end)
    pairs = pairs.where(alike("u", "v", F.col("nu"), F.col("nv")))
    best = pairs.groupBy("lo", "hi").agg(F.max(F.struct("times", "u", "v")).alias("best"))
    return best.select("best.u", "best.v")


def _open_pairs(entries: DataFrame, sets: DataFrame, keep: Scratch) -> DataFrame:
    """(u, v), u > v: all pairs of one list and two components, as far as
    sizes, places and sketches allow a link. Of the shingles that two sets
    share the first one makes the pair, so most others need not: all shingles
    before it in either order are in one set only, a ninth of the sizes' sum at
    most, so it is in both 1-prefixes; and no common one is just before it
    (entries in order of the prefix's parts, whatever their order inside a part).
    ``entries``: (token, row, info, component) of 1-prefixes, all that are of
    lists in which components differ."""
    own, two = unpacked("info"), unpacked("info_2")
    before = F.lag("token").over(Window.partitionBy("row").orderBy(own["place"], "token"))
    x = keep(entries.withColumn("before", before).join(sets.drop("n"), "row"), "jaccard-open")
    y = x.select("token", *[F.col(c).alias(f"{c}_2") for c in ("row", "info", "component", "before", *BITS)])
    # at least so many shingles are before it
    single = reduce(Column.__add__, [F.floor(c["place"] * (c["n"] - F.ceil(PERCENT * c["n"] / 100) + 1) / PLACES)
                                     for c in (own, two)])
    return (x.join(y, "token").where("row > row_2 and component <> component_2").where(near(own["n"], two["n"]))
            .where(F.coalesce(F.col("before") != F.col("before_2"), F.lit(True)))
            .where((100 + PERCENT) * single <= (100 - PERCENT) * (own["n"] + two["n"]))
            .where(alike("", "_2", own["n"], two["n"]))
            .select(F.col("row").alias("u"), F.col("row_2").alias("v")))


def placed_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, a (hash of the text), n (set size) and its
    component's number (null: empty set)."""
    with Scratch(docs.sparkSession) as keep:
        return materialize(_placed_documents(docs, keep), "jaccard-placed")


def _placed_documents(docs: DataFrame, keep: Scratch) -> DataFrame:
    texts, facts = keyed(docs, keep(document_facts(docs), "jaccard-facts"), keep)
    classes = facts.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("rep"))
    of_row = keep(facts.join(classes, ["s1", "s2", "n"]).select("row", "rep").distinct(), "jaccard-classes")

    heavy = heavy_shingles(docs, keep)
    sent = prefix_entries(texts, *heavy, True).select("token", "row", "info")
    lists = keep(sent.repartition("token").sortWithinPartitions("token", unpacked("info")["n"], "row")
                 .mapInArrow(_with_hubs, _ENTRY_SCHEMA).union(prefix_entries(texts, *heavy, False)), "jaccard-lists")
    reps = of_row.where("row = rep").select("row")
    sets = keep(facts.select("row", "n", *BITS).join(reps, "row").dropDuplicates(["row"]), "jaccard-sets")

    # round 1: every entry with the first of its list
    own, hub = unpacked("info"), unpacked("hub_info")
    level = F.least(own["level"], hub["level"])
    pairs = (lists.where("row <> hub").where(near(own["n"], hub["n"])).where(F.greatest(own["tag"], hub["tag"]) <= level)
             .groupBy("row", "hub").agg(F.count("*").alias("shared"), F.min(level).alias("least")).where("shared >= least")
             .join(of_row.withColumnRenamed("rep", "x"), "row")
             .join(of_row.withColumnsRenamed({"row": "hub", "rep": "y"}), "hub")
             .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct())
    for end in "uv":
        pairs = pairs.join(sets.withColumnsRenamed({c: c + end for c in ("n", *BITS)}).withColumnRenamed("row", end), end)
    pairs = keep(pairs.where(alike("u", "v", F.col("nu"), F.col("nv"))).select("u", "v"), "jaccard-pairs")
    links = verified(pairs, texts, keep)
    joined = components(links, keep)
    keep.free("jaccard-heavy")

    # round 2: neighbours in lists in which components still differ, class by class
    left = keep(_open_entries(lists.select("token", "row", "info").join(reps, "row", "left_semi"), joined), "jaccard-left")
    beside = keep(_neighbours(left, sets).join(pairs, ["u", "v"], "left_anti"), "jaccard-beside")
    links = links.union(verified(beside, texts, keep))
    pairs, joined = pairs.union(beside), components(links, keep)
    keep.free("jaccard-lists")

    # round 3: entries of 1-prefixes in lists in which components differ even now
    left = _open_entries(left.drop("component").where(own["tag"] == 1), joined)
    more = _open_pairs(left, sets, keep).distinct()
    more = keep(more.join(pairs, ["u", "v"], "left_anti"), "jaccard-more")
    joined = components(links.union(verified(more, texts, keep)), keep)

    of_row = (of_row.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
              .select("row", F.coalesce("component", "rep").alias("component")))
    return facts.select("row", "doc_id", "a", "n").join(of_row, "row", "left").select("doc_id", "a", "n", "component")


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least id that
    is reachable by links."""
    placed = placed_documents(docs)
    ids = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(ids, "component", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the least
    id (null last, then by a hash of the text). Documents with an empty set
    stay; rows that repeat id and text count as one."""
    placed = placed_documents(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.col("a").alias("_a"),
                                           "component")
    order = F.struct((F.col("_id") == NULL_ID).alias("z"), "_id", "_a")
    kept = (placed.where("component is not null").groupBy("component").agg(F.min(order).alias("k")).select("k._id", "k._a")
            .union(placed.where("component is null").select("_id", "_a").distinct()))
    n, n_distinct = placed.agg(F.count("*"), F.count_distinct("_id", "_a")).first()
    keyed = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(NULL_ID)), "_a": F.xxhash64(F.coalesce("text", F.lit("")))})
    out = keyed.join(kept, ["_id", "_a"], "left_semi")
    return (out if n == n_distinct else out.dropDuplicates(["_id", "_a"])).select(*docs.columns)
