"""Incremental pseudo-label base: new ``*.txt`` files in a corpus folder.

The batch job scans a finite folder once. When texts keep arriving, the same
two operators run as a stream: the binary-file source picks up new files
(``maxBytesPerTrigger`` bounds a micro-batch), and a stream-static left-anti
join drops ids that are train ids (null-safe). Output is appended to a
Parquet table; progress lives in a checkpoint under the shared folder, so a
restarted or re-run query continues where it stopped (exactly-once file sink).

A file source keeps every file's name on the driver. A corpus of very many
small texts therefore comes packed (``sources.corpus.pack_texts``): rows (path,
content) in a few Parquet files, which the same operators read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldwise.config import TARGETS
from foldwise.functions.text import file_stem, universal_newlines
from foldwise.session import shared_path

BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
PACKED_SCHEMA = "path STRING, content BINARY"


#: no file is too old to be read, whatever its modification time
ANY_AGE = "36500d"


def corpus_stream(spark: SparkSession, directory: str, glob: str = "*.txt", max_bytes_per_trigger: int = 64 << 30,
                  packed: bool = False) -> DataFrame:
    """Streaming (text_id, full_text, targets) rows for files added to
    ``directory``, of packed files for the texts in them. Zero-length files
    carry no text and are left out by the file source (packed: here); the batch
    reader (``read_text_corpus``) has them."""
    source = spark.readStream.option("maxFileAge", ANY_AGE).option("maxBytesPerTrigger", max_bytes_per_trigger)
    if packed:
        raw = source.schema(PACKED_SCHEMA).parquet(directory).where(F.length("content") > 0)
    else:
        raw = source.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", glob).load(directory)
    return raw.select(file_stem(F.col("path")).alias("text_id"),
                      universal_newlines(F.decode(F.col("content"), "UTF-8")).alias("full_text"),
                      *[F.lit(None).cast("double").alias(t) for t in TARGETS])


def pseudo_base_stream(spark: SparkSession, directory: str, train_ids: DataFrame, glob: str = "*.txt",
                       packed: bool = False) -> DataFrame:
    """Corpus stream minus train ids (stream-static null-safe anti-join)."""
    rows = corpus_stream(spark, directory, glob, packed=packed)
    ids = train_ids.select(F.col("text_id").alias("_tid"))
    return rows.join(ids, rows["text_id"].eqNullSafe(ids["_tid"]), "left_anti")


def start_pseudo_base(spark: SparkSession, directory: str, train_ids: DataFrame, output: str,
                      checkpoint: str | None = None, once: bool = False, packed: bool = False) -> StreamingQuery:
    """Append new pseudo-base rows to ``output`` (Parquet).

    ``once=True`` processes what is there now and stops (availableNow).
    """
    checkpoint = checkpoint or shared_path(spark, "pseudo_base_stream_checkpoint")
    w = (pseudo_base_stream(spark, directory, train_ids, packed=packed).writeStream.format("parquet")
         .option("path", output).option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
