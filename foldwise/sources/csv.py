"""CSV at the edges only (ingest once to Parquet, write submissions).

Options that make quoted text with commas, quotes, blank lines, CR/LF,
backslashes and leading/trailing blanks round-trip:
``quote='"'``, ``escape='"'`` (doubling, not backslash), ``multiLine``
on read, and no whitespace trimming on write. A ``multiLine`` CSV file is not
splittable, so each file is read by one task -- write many part files, or
convert to Parquet right after ingest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from foldwise.config import TARGETS

READ_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "FAILFAST"}
WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "false",
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

TRAIN_SCHEMA = StructType([StructField("text_id", StringType()), StructField("full_text", StringType())]
                          + [StructField(t, DoubleType()) for t in TARGETS])
TEST_SCHEMA = StructType([StructField("text_id", StringType()), StructField("full_text", StringType())])
SUBMISSION_SCHEMA = StructType([StructField("text_id", StringType())] + [StructField(t, DoubleType()) for t in TARGETS])


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Declared schema, never inferred: an id of digits stays a string."""
    return spark.read.schema(schema).options(**READ_OPTIONS).csv(path)


def read_train(spark, path):
    return read_csv(spark, path, TRAIN_SCHEMA)


def read_test(spark, path):
    return read_csv(spark, path, TEST_SCHEMA)


def read_sample_submission(spark, path):
    return read_csv(spark, path, SUBMISSION_SCHEMA)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**WRITE_OPTIONS).csv(path)


def ingest_csv(spark: SparkSession, src: str, schema: StructType, dest: str) -> DataFrame:
    """Read a CSV edge once and keep it as Parquet for every later job."""
    read_csv(spark, src, schema).write.mode("overwrite").parquet(dest)
    return spark.read.parquet(dest)
