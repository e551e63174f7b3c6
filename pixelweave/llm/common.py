"""Shared plumbing: checkpointed tables, Arrow batch slicing, id hashing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workspace import cleanup, materialise, new_path

#: Words of every text contract: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Text bytes that one step of a vectorised kernel holds at a time.
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch between the JVM and Python.
ARROW_BYTES = 8 << 20


def tune_arrow(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


@contextmanager
def narrow_rows(spark: SparkSession) -> Iterator[None]:
    """For tables of numbers run within: batches bounded by their rows alone, as checking bytes after each row costs more than the row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str((1 << 31) - 1))
    try:
        yield
    finally:
        tune_arrow(spark)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def unit_hash(*cols: str, seed: int = 0) -> Column:
    """A seeded hash of columns as a double in [0, 1), alike on every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), 11) / F.lit(float(1 << 53))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(start, part) of a string column, each part about ``limit`` bytes or one row.

    Nulls become empty strings.
    """
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2] or pa.py_buffer(b"")
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(column))
        # an array of its own: some string kernels expect the first offset to be 0
        yield at, pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(ends[at : to + 1] - ends[at]), data.slice(int(ends[at]), int(ends[to] - ends[at])))
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string slice and the offsets of its rows."""
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for every run, one after another."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, lengths)


def pick(table: DataFrame, needed: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The ``needed`` columns by name, and ``keep`` as kept_0, kept_1, ..., whatever else the table holds.

    Columns are taken by place, so dots, blanks and names that differ in case
    only do no harm; a name that isn't there may be spelt in another case.
    """
    names = table.columns
    folded = [n.lower() for n in names]
    flat = table.toDF(*[f"p{k}" for k in range(len(names))])
    at = lambda n: F.col(f"p{names.index(n) if n in names else folded.index(n.lower())}")
    return flat.select(*[at(n).alias(n) for n in needed], *[at(c).alias(f"kept_{k}") for k, c in enumerate(keep)])


def named(keep: Sequence[str]) -> list[Column]:
    """The columns that ``pick`` kept, by their own names."""
    return [F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)]


def whole(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id as a number, text, and further columns by name."""
    return pick(docs, ["doc_id", "text", *extra]).withColumn("doc_id", F.col("doc_id").cast("long"))


__all__ = ["WORD_PATTERN", "cleanup", "held_out", "materialise", "named", "narrow_rows", "new_path", "pick", "ragged", "slices", "text_bytes", "tune_arrow", "unit_hash", "whole"]
