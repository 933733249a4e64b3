"""Small helpers shared by the operators: tables, Arrow passes, fold marks."""

from __future__ import annotations

import binascii
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.tokens import text_chunks
from foldwise.session import delete_table, shared_path, short_lived_shuffles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (a null id counts as
    the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fold_numbers(ids: Iterable, folds: int) -> np.ndarray:
    return np.array([binascii.crc32(b"" if i is None else str(i).encode()) % folds for i in ids], dtype=np.int64)


def text_pass(df: DataFrame, work: Callable, schema: str, text: str = "text") -> DataFrame:
    """Run ``work(rows, data, begin) -> RecordBatch | None`` over runs of about
    one megabyte of text. ``rows`` is the slice of the record batch, ``data``
    and ``begin`` are the texts' bytes (``tokens.text_chunks``)."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, begin in text_chunks(batch.column(at)):
                out = work(batch.slice(a, b - a), data, begin)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
                                       for c, f in zip(columns, schema, strict=True)], schema=schema)


class Scratch:
    """Intermediate tables in the shared folder that go when the work is done:
    ``scratch(df, name)`` writes a table and reads it back, the end of the
    ``with`` block deletes all of them. Nothing lazy that reads them may
    outlive the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(shared_path(self.spark, name))
        with short_lived_shuffles(self.spark):
            df.write.parquet(self.paths[-1])
        return self.spark.read.parquet(self.paths[-1])

    def free(self, name: str) -> None:
        """Delete the tables written as ``name`` so far: all that reads them is done."""
        done = [p for p in self.paths if p.rsplit("/", 1)[1].rsplit("-", 1)[0] == name]
        self.paths = [p for p in self.paths if p not in done]
        for path in done:
            delete_table(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete_table(self.spark, path)
