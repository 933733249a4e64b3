"""Mixing sources to target weights on a low-discrepancy schedule.

Every source gets a share of the mix by its weight, but no more than a number
of passes over it; what a source cannot take goes to the others by weight.
The shuffled words of a source lie in blocks of equal length. The mix is a row
of slots, one block each: slot ``t`` is the van der Corput point with ``t``'s
bits in reverse order, and the source it falls to is read off the cumulative
slot counts. Over all slots the points hit every place once, so every source
gets exactly its number of slots, spread evenly over the mix at every scale.
The k-th slot of a source takes its k-th block, and from the first again after
the last; the last slot is cut so that the words add up to the target.

Nothing depends on a random state: documents are ordered by a seeded md5 of
their id inside their source, so reruns agree. Cumulative sizes come from
offsets of 4,096 parts of a source, so a source may hold any share of all rows.

Rows: a null or empty text has size 0 and is never taken; a null source is a
source of its own, the last; a null id counts as an empty one; rows that share
an id are documents of their own (of rows that also share their size it does
not matter which comes first); a text of any length may span many blocks; an
empty table gives no rows, and a table without a word takes none. Only
``doc_id``, ``source`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.hashing import seeded_key
from foldwise.llm.frames import Scratch, record, text_pass
from foldwise.llm.tokens import split_words
from foldwise.operators.ranking import exclusive_offsets, positions
from foldwise.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
#: words of a block (blocks of one source differ by one word at most)
BLOCK_WORDS = 1024
SEED = 12

_SIZES = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of every whole text."""

    def work(rows, data, begin):
        return record(_SIZES, rows.column(0), rows.column(1), split_words(data, begin).counts())

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return text_pass(narrow, work, "doc_id long, source string, size long")


def source_table(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(at, source, source_size, weight): sources in code point order, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(totals.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], name="at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    return ranked.select("at", "source", "source_size", weight.alias("weight"))


def with_targets(sources: DataFrame, share: float, passes: int) -> DataFrame:
    """Add ``target``: weight x level, but at most ``passes`` times the source.
    Each round reshares what the sources at their limit cannot take; the level
    only rises, and the last round finds no further source above its limit."""
    limit = F.col("source_size") * passes
    total = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    aim, level, before = share * (total[0] or 0), 0.0, None
    if aim:
        level = aim / total[1]
    while aim and level != before:
        full = limit <= F.col("weight") * F.lit(level)
        taken, open_weight = sources.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        before = level
        if open_weight:
            level = (aim - (taken or 0)) / open_weight
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), limit.cast("double")))


def _block_start(j: Column) -> Column:
    """First word of block ``j``: the first ``longer`` blocks have a word more."""
    return j * F.col("short") + F.least(j, F.col("longer"))


def _block_of(word: Column) -> Column:
    edge = F.col("longer") * (F.col("short") + 1)
    late = F.when(F.col("short") > 0, F.col("longer") + F.expr("(_w - longer * (short + 1)) div short"))
    return F.when(word < edge, F.expr("_w div (short + 1)")).otherwise(late)


def with_blocks(sources: DataFrame, passes: int, block_words: int) -> DataFrame:
    """Add the blocks of every source (``blocks``, ``short``, ``longer``), the
    words it gives (``words``) and its number of slots (``slots``)."""
    x = sources.withColumn("words", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * passes).cast("long"))
    x = x.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / F.lit(block_words)), F.lit(1)).cast("long"))
    x = x.withColumns({"short": F.expr("source_size div blocks"), "longer": F.col("source_size") % F.col("blocks")})
    x = x.withColumn("_size", F.greatest("source_size", F.lit(1)))
    x = x.withColumns({"_passes": F.expr("words div _size"), "_w": F.col("words") % F.col("_size") - 1})
    slots = F.col("_passes") * F.col("blocks") + F.when(F.col("_w") < 0, F.lit(0)).otherwise(_block_of(F.col("_w")) + 1)
    return x.withColumn("slots", slots.cast("long")).drop("_size", "_passes", "_w")


def reversed_bits(t: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of ``t`` in reverse order: the van der Corput
    point of ``t``, times 2**bits."""
    for step, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
                       (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        t = F.shiftleft(t.bitwiseAND(F.lit(mask)), step).bitwiseOR(F.shiftrightunsigned(t, step).bitwiseAND(F.lit(mask)))
    return F.shiftrightunsigned(t, 64 - bits) if bits else F.lit(0).cast("long")


#: places of the cumulative slot counts that share a key of the lookup join
LOOKUP = 6
#: slots in a row that are numbered together
NUMBERED = 16


def schedule(sources: DataFrame, keep: Scratch) -> DataFrame:
    """(slot, at, block, first, last): what every slot of the mix takes: words
    ``first`` to ``last`` (exclusive) of the shuffled words of source ``at``."""
    spark = sources.sparkSession
    cumulative = exclusive_offsets(sources.withColumn("_hi", F.shiftright("at", 12)), [], [["_hi"], ["at"]],
                                   count_col="slots", out_col="begin").drop("_hi")
    cumulative = keep(cumulative.where(F.col("slots") > 0), "mix-sources")
    total = cumulative.agg(F.sum("slots")).first()[0] or 0
    bits = max(total - 1, 0).bit_length()
    points = spark.range(1 << bits).select(F.col("id").alias("slot"), reversed_bits(F.col("id"), bits).alias("point"))
    points = points.where(F.col("point") < total)
    end = F.col("begin") + F.col("slots")
    keys = F.sequence(F.shiftright("begin", LOOKUP), F.shiftright(end - 1, LOOKUP))
    lookup = cumulative.select("at", "begin", end.alias("end"), F.explode(keys).alias("key"))
    hits = points.withColumn("key", F.shiftright("point", LOOKUP)).join(lookup, "key")
    hits = hits.where((F.col("point") >= F.col("begin")) & (F.col("point") < F.col("end")))
    hits = keep(hits.select("slot", "at", F.shiftright("slot", NUMBERED).alias("run")), "mix-slots")
    runs = exclusive_offsets(hits.groupBy("at", "run").agg(F.count(F.lit(1)).alias("n")), ["at"], [["run"]],
                             out_col="before").drop("n")
    in_run = F.row_number().over(Window.partitionBy("at", "run").orderBy("slot")) - 1
    ranked = hits.withColumn("_k", in_run).join(runs, ["at", "run"])
    ranked = ranked.withColumn("k", F.col("before") + F.col("_k")).join(cumulative.drop("begin"), "at")
    ranked = ranked.withColumns({"block": F.col("k") % F.col("blocks"), "_pass": F.expr("k div blocks")})
    last = F.least(_block_start(F.col("block") + 1), F.col("words") - F.col("_pass") * F.col("source_size"))
    return ranked.select("slot", "at", "block", _block_start(F.col("block")).alias("first"), last.alias("last"))


def shuffled(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Sizes with ``at``, the source's figures and ``offset``: words of the
    source before the document in its seeded order."""
    x = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    x = x.withColumn("_h", seeded_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    x = x.withColumn("_part", F.substring("_h", 1, 3))
    parts = exclusive_offsets(x.groupBy("at", "_part").agg(F.sum("size").alias("n")), ["at"], [["_part"]],
                              out_col="_before").drop("n")
    w = Window.partitionBy("at", "_part").orderBy("_h", "doc_id", "size")
    upto = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_upto", upto).join(parts, ["at", "_part"])
    return x.withColumn("offset", F.col("_before") + F.col("_upto") - F.col("size")).drop("_h", "_part", "_before", "_upto")


def pieces(placed: DataFrame) -> DataFrame:
    """One row per document and block of its source that it reaches into."""
    some = placed.where(F.col("size") > 0)
    first = some.withColumn("_w", F.col("offset")).withColumn("_from", _block_of(F.col("_w")))
    ends = first.withColumn("_w", F.col("offset") + F.col("size") - 1).withColumn("_to", _block_of(F.col("_w")))
    each = ends.withColumn("block", F.explode(F.sequence("_from", "_to"))).drop("_w", "_from", "_to")
    begin = F.greatest(F.col("offset"), _block_start(F.col("block")))
    end = F.least(F.col("offset") + F.col("size"), _block_start(F.col("block") + 1))
    return each.withColumns({"begin": begin, "end": end})


def _mixed(docs: DataFrame, keep: Scratch, weights, share: float, passes: int, block_words: int, seed: int):
    """(documents with their place in the source, their pieces joined with slots)."""
    sizes = keep(word_sizes(docs), "mix-sizes")
    sources = keep(source_table(sizes, weights), "mix-totals")
    sources = keep(with_blocks(with_targets(sources, share, passes), passes, block_words), "mix-targets")
    slots = schedule(sources, keep)
    placed = keep(shuffled(sizes, sources, seed), "mix-placed")
    taken = pieces(placed).join(slots, ["at", "block"], "left")
    begin, end = F.greatest("begin", "first"), F.least("end", "last")
    words = F.when(F.col("slot").isNotNull(), F.greatest(end - begin, F.lit(0))).otherwise(F.lit(0))
    return placed, taken.withColumns({"first_word": begin - F.col("offset"), "words": words})


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
        block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself: (slot, source, doc_id, first_word, words), one row for
    every stretch of a document that a slot takes; read it by ``slot``."""
    with Scratch(docs.sparkSession) as keep:
        _, taken = _mixed(docs, keep, weights, share, passes, block_words, seed)
        out = taken.where(F.col("words") > 0).select("slot", "source", "doc_id", "first_word", "words")
        return materialize(out, "mix")


def mix_digest(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
               block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: size, source_size, target of its source and the words
    that the mix takes of it (repeats counted)."""
    with Scratch(docs.sparkSession) as keep:
        placed, taken = _mixed(docs, keep, weights, share, passes, block_words, seed)
        cols = ["doc_id", "size", "source_size", "target"]
        # documents with words begin at different places of their source
        some = taken.groupBy("at", "offset", *cols).agg(F.sum("words").alias("taken"))
        none = placed.where(F.col("size") == 0).withColumn("taken", F.lit(0).cast("long"))
        return materialize(some.select(*cols, "taken").unionByName(none.select(*cols, "taken")), "mix-digest")
