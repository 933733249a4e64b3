"""Filter interaction audit by incremental retraction streaming.

Five filters may each fail a document; which of them removes it depends on
their order. The documents' files are read as a stream, some files at a time,
until all available ones are done. Counters per part hold how many documents
fail which set of filters (a mask of five bits). Four filters look at one text
only; the fifth fails a document whose text some smaller id has too, so a mask
may change when a smaller id arrives later: state keyed by the text holds the
smallest ids and where their documents were counted; when a smaller id comes
they are taken out of their counters again (a retraction) and counted under
the other mask.

Each task first settles its own batch: only the documents with the smallest id
of a text go to the state, all others are copies already. So a text with any
number of copies sends one row per batch of a task. State is a table with a
folder per micro-batch: a micro-batch adds its own rows and joins those of the
same texts from earlier ones, columns and shuffles of Spark instead of a
Python call per text (a state function per text took 936 CPU seconds a GB).
The narrow state is read once per micro-batch, so a run takes a fixed number of
micro-batches. Folders of state and counters are overwritten if a micro-batch
is run again, and the stream's checkpoint knows the files that are done, so the
job goes on after a failure where it stood.

From the counters, every order and step follows by sums over masks: documents
left after a set S of filters are those whose mask misses S.

Rows: a null text counts as an empty one, a null source as the empty part; a
null id is neither smaller nor larger than any other and has no labels;
documents that share an id and a text are no copies of each other; several
labels of one id count as 1 if any of them is 1; a text of any length is
handled whole; an empty table has no part and gives no rows. Only ``doc_id``,
``source`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.frames import Scratch
from foldwise.session import materialize, shared_path

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: bits of ``flags`` above the mask
GOOD, TOXIC = 1 << 5, 1 << 6
WORDS = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: micro-batches of a run, at most
BATCHES = 4
#: parts over which rows without an id are spread
SALTS = 64


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: A under 50 words, B fewer
    than 65 % distinct words, C more than 5 % upper-case letters, D a symbol."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [n < 50, 100 * distinct < 65 * n, 100 * upper > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))


def label_flags(labels: DataFrame) -> DataFrame:
    """(label_id, label_flags): one row per id."""
    def any_one(c):
        return F.coalesce(F.max(F.when(F.col(c) == 1, F.lit(1)).otherwise(F.lit(0))), F.lit(0))

    flags = any_one("quality") * F.lit(GOOD) + any_one("toxic") * F.lit(TOXIC)
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        flags.cast("int").alias("label_flags"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, key, flags): narrow rows; texts stay where they were read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    x = x.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), text_mask(F.col("text")).alias("mask"))
    # rows without an id match no label: spread them instead of joining them in one place
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(F.lit(0))
    x = x.withColumn("_salt", salt.cast("long")).join(
        labels.withColumn("_label_salt", F.lit(0).cast("long")),
        (F.col("doc_id") == F.col("label_id")) & (F.col("_salt") == F.col("_label_salt")), "left")
    flags = F.col("mask") + F.coalesce(F.col("label_flags"), F.lit(0))
    return x.select("doc_id", "part", "key", flags.cast("int").alias("flags"))


_SETTLED = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("flags", pa.int32()),
                      ("n", pa.int64())])
_SETTLED_DDL = "key binary, doc_id long, part string, flags int, n long"


def settle(rows: DataFrame) -> DataFrame:
    """Of every batch of rows: counts per (part, flags) as if the batch were
    all there is (neither key nor ``doc_id``), and the documents with the
    smallest id of each text for the state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            code = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            no_id = t.column("doc_id").combine_chunks().is_null().to_numpy(zero_copy_only=False)
            ids = t.column("doc_id").combine_chunks().fill_null(0).to_numpy()
            least = np.full(code.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, code[~no_id], ids[~no_id])
            first = ~no_id & (ids == least[code])
            flags = t.column("flags").to_numpy()
            judged_ = np.where(first | no_id, flags, flags | COPY).astype(np.int32)
            counted = pa.table({"part": t.column("part"), "flags": judged_}).group_by(["part", "flags"]).aggregate(
                [([], "count_all")])
            yield from _settled(*[pa.nulls(counted.num_rows, f.type) for f in _SETTLED][:2],
                                *[counted.column(c) for c in ("part", "flags", "count_all")])
            held = t.filter(pa.array(first)).group_by(["key", "doc_id", "part", "flags"]).aggregate([([], "count_all")])
            yield from _settled(*[held.column(c) for c in ("key", "doc_id", "part", "flags", "count_all")])

    return rows.mapInArrow(run, _SETTLED_DDL)


def _settled(*columns) -> Iterator[pa.RecordBatch]:
    columns = [c.cast(f.type) for c, f in zip(columns, _SETTLED)]
    yield from pa.table(columns, schema=_SETTLED).to_batches()


def retractions(state: DataFrame, number: int) -> DataFrame:
    """(part, flags, n): what micro-batch ``number`` changes beyond the counts
    of its tasks. Its own documents were counted as no copies, as were those of
    the smallest id before it; both move if a smaller id is known now."""
    text = Window.partitionBy("key")
    now, known = F.min("doc_id").over(text), F.min(F.when(F.col("batch") < number, F.col("doc_id"))).over(text)
    x = state.withColumns({"now": now, "known": known})
    counted = (F.col("batch") == number) | (F.col("doc_id") == F.col("known"))
    moved = x.where(counted & (F.col("doc_id") > F.col("now")))
    both = F.array(F.struct(F.col("flags"), (-F.col("n")).alias("n")),
                   F.struct(F.col("flags").bitwiseOR(F.lit(COPY)).alias("flags"), F.col("n")))
    return moved.select("part", F.explode(both).alias("d")).select("part", "d.flags", "d.n")


def count_masks(spark: SparkSession, docs_path: str, labels: DataFrame, folder: str, batches: int = BATCHES) -> None:
    """Run the stream over all available files; ``folder`` holds its progress,
    state and the deltas of every micro-batch (``counters``). Called again
    with the same folder it goes on with the files that are new."""
    docs_path = docs_path.rstrip("/")
    stored = spark.read.parquet(docs_path)
    files = -(-len(stored.inputFiles()) // batches)
    # a pattern, as a stream takes a plain path for a folder; files of any age are read
    pattern = f"{docs_path[:-1]}[{docs_path[-1]}]"
    docs = (spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", max(files, 1))
            .option("maxFileAge", "36500d").parquet(pattern))

    def update(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        state = rows.sparkSession.read.schema(f"{_SETTLED_DDL}, batch int").parquet(f"{folder}/state")
        counts = state.where((F.col("batch") == number) & F.col("doc_id").isNull()).select("part", "flags", "n")
        held = state.where((F.col("batch") <= number) & F.col("doc_id").isNotNull())
        sums = counts.unionByName(retractions(held, number)).groupBy("part", "flags").agg(F.sum("n").alias("n"))
        sums.where(F.col("n") != 0).coalesce(8).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    query = (settle(judged(docs, labels)).writeStream.foreachBatch(update).outputMode("append")
             .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()


def read_counters(spark: SparkSession, folder: str) -> DataFrame:
    """(part, flags, n): sums of all deltas."""
    deltas = spark.read.schema("part string, flags int, n long, batch int").parquet(f"{folder}/counters")
    return deltas.groupBy("part", "flags").agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def order_report(counts: DataFrame) -> DataFrame:
    """The audit of all 120 orders from (part, flags, n)."""
    every = range(1 << len(FILTERS))
    # documents that no filter of S fails, for every S, also those with a label
    x = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(len(every) - 1))))
    n = F.when(F.col("flags").bitwiseAND(F.col("s")) == 0, F.col("n")).otherwise(F.lit(0))
    x = x.groupBy("part", "s").agg(F.sum(n).alias("left"), *[
        F.sum(F.when(F.col("flags").bitwiseAND(F.lit(bit)) > 0, n).otherwise(F.lit(0))).alias(name)
        for name, bit in (("left_good", GOOD), ("left_toxic", TOXIC))])
    names = ["left", "left_good", "left_toxic"]
    per = x.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("s", *names))).alias("all"))
    per = per.select("part", *[F.col(f"all.{c}").alias(c) for c in names])

    def at(name: str, s: Column | int) -> Column:
        return F.element_at(name, F.lit(s + 1) if isinstance(s, int) else s + F.lit(1))

    def shapley(f: int) -> Column:
        """Every set without f comes before f in |S|! (4 - |S|)! orders."""
        weights = [factorial((s & ~f).bit_count()) * factorial(4 - (s & ~f).bit_count()) * (-1 if s & f else 1)
                   for s in every]
        parts = F.zip_with("left", F.array(*[F.lit(w) for w in weights]), lambda n, w: n * w)
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, v: a + v)

    per = per.withColumn("shapleys", F.array(*[shapley(1 << k) for k in range(len(FILTERS))]))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    x = per.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))

    def letter(i: Column) -> Column:
        return F.ascii(F.substring("filter_order", i, F.lit(1))) - F.lit(ord("A"))

    bits = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.call_function("shiftleft", F.lit(1), letter(i)))
    x = x.withColumn("bits", bits).withColumn("own", F.element_at("bits", F.col("step")))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda s, b: s.bitwiseOR(b))
    x = x.withColumn("before", before).withColumn("after", F.col("before").bitwiseOR(F.col("own")))
    whole = len(every) - 1
    removed = at("left", F.col("before")) - at("left", F.col("after"))
    failing = at("left", 0) - at("left", F.col("own"))
    return x.select(
        "part", "filter_order", "step", at("left", F.col("after")).alias("kept"), removed.alias("removed"),
        (failing - removed).alias("redundant"),
        (at("left", F.lit(whole) - F.col("own")) - at("left", whole)).alias("unique_fails"),
        (at("left_good", F.col("before")) - at("left_good", F.col("after"))).alias("good_lost"),
        (at("left_toxic", F.col("before")) - at("left_toxic", F.col("after"))).alias("toxic_lost"),
        F.element_at("shapleys", letter(F.col("step")) + 1).cast("long").alias("shapley"))


def filter_audit(spark: SparkSession, docs_path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Stream all files of ``docs_path`` and report every order, step and part."""
    with Scratch(spark) as keep:
        flags = keep(label_flags(labels), "audit-labels")
        folder = shared_path(spark, "audit-stream")
        keep.paths.append(folder)
        count_masks(spark, docs_path, flags, folder, batches)
        return materialize(order_report(read_counters(spark, folder)), "audit")
