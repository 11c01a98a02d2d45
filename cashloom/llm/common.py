"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import HEAVY_SHARE, lookup, saved, shared_dir

__all__ = ["HEAVY_SHARE", "PIECE_BYTES", "documents", "lookup", "pieces", "saved", "shared_dir", "small_batches", "whole_text"]

#: Bytes of input that an Arrow function turns into Python objects at once.
PIECE_BYTES = 4 << 20


def whole_text(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Have this session hand Arrow functions at most PIECE_BYTES at once (or one row): both the executors
    and their Python workers hold whole batches, whatever the texts' sizes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about PIECE_BYTES, or of one row where that is larger."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
