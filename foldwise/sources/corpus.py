"""Text-directory corpus: one ``*.txt`` file per row.

``text_id`` is the file name without directory and last extension
(``BB.02.txt`` -> ``BB.02``), ``full_text`` the content decoded as UTF-8
with universal newlines, targets null. The scan is a parallel file source
(many small files are packed into each task by size).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.config import TARGETS
from foldwise.functions.text import file_stem, universal_newlines


def empty_files(spark: SparkSession, directory: str, glob: str) -> list[str]:
    """Names of the matching zero-length files, from one listing of the folder
    by its own file system (the file sources list it on the driver as well)."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    pattern = jvm.org.apache.hadoop.fs.Path(directory.rstrip("/"), glob)
    found = pattern.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(pattern)
    return [str(f.getPath().toString()) for f in (found or []) if f.getLen() == 0 and f.isFile()]


def read_text_corpus(spark: SparkSession, directory: str, glob: str = "*.txt") -> DataFrame:
    """(text_id, full_text, targets...) for every matching file.

    The binary-file source skips zero-length files; their names are added
    with an empty text.
    """
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", "false").load(directory).select("path", "content"))
    text = F.decode(F.col("content"), "UTF-8")
    names = [(n, b"") for n in empty_files(spark, directory, glob)]
    if names:
        raw = raw.unionByName(spark.createDataFrame(names, "path STRING, content BINARY"))
    return raw.select(file_stem(F.col("path")).alias("text_id"),
                      universal_newlines(text).alias("full_text"),
                      *[F.lit(None).cast("double").alias(t) for t in TARGETS])


def pack_texts(df: DataFrame, directory: str, id_col: str, text_col: str, suffix: str = ".txt") -> None:
    """Write the files of ``write_text_files`` as rows (path, content) of a few
    Parquet files, so that no listing grows with the number of texts. As in a
    folder, every name is there once; rows that share an id give one of their
    texts (the greatest)."""
    path = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("None")), F.lit(suffix)).alias("path")
    content = F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("content")
    df.select(path, content).groupBy("path").agg(F.max("content").alias("content")).write.parquet(directory)


def write_text_files(df: DataFrame, directory: str, id_col: str, text_col: str, suffix: str = ".txt") -> None:
    """Write one UTF-8 file per row, named ``<id><suffix>`` (fixture helper).

    Runs inside the tasks, so ``directory`` must be a folder every executor
    mounts (the shared checkpoint folder when it is a POSIX path).
    """
    if "://" in directory and not directory.startswith("file://"):
        raise ValueError(f"write_text_files needs a mounted (POSIX) folder, got {directory!r}")
    target = directory[len("file:"):] if directory.startswith("file:") else directory
    target = "/" + target.lstrip("/") if directory.startswith("file:") else target

    def write_partition(rows):
        os.makedirs(target, exist_ok=True)
        for r in rows:
            with open(os.path.join(target, f"{r[id_col]}{suffix}"), "w", encoding="utf-8", newline="") as fh:
                fh.write(r[text_col] or "")

    df.select(id_col, text_col).foreachPartition(write_partition)
