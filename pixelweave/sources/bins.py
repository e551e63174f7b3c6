"""BIN files: a count, then that many values, all little-endian.

The count has 8 bytes, a value 4: signed integers or floats. Files lie in a
folder, one per image, named by its id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"int": "<i4", "float": "<f4"}


def encode(values: np.ndarray, kind: str) -> bytes:
    return np.array([len(values)], "<u8").tobytes() + values.astype(KINDS[kind]).tobytes()


def decode(data: bytes, kind: str) -> np.ndarray:
    count = int(np.frombuffer(data, "<u8", 1)[0])
    if len(data) != 8 + 4 * count:
        raise ValueError(f"{count} values need {8 + 4 * count} bytes, not {len(data)}")
    return np.frombuffer(data, KINDS[kind], count, 8)


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (pafs.LocalFileSystem(), folder) if folder.startswith("/") else pafs.FileSystem.from_uri(folder)


def write_bins(rows: DataFrame, folder: str, kind: str) -> DataFrame:
    """A file for each image of ``(image_id, pos, value)``; returns (image_id, path, values)."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        store, base = _store(folder)
        image = int(pdf["image_id"].iloc[0])
        store.create_dir(base, recursive=True)
        part, path = f"{base}/_{image}.{uuid.uuid4().hex}", f"{base}/{image}.bin"
        with store.open_output_stream(part) as out:
            out.write(encode(pdf.sort_values("pos")["value"].to_numpy(), kind))
        store.move(part, path)
        return pd.DataFrame({"image_id": [image], "path": [f"{folder.rstrip('/')}/{image}.bin"], "values": [len(pdf)]})

    return rows.groupBy("image_id").applyInPandas(write, "image_id long, path string, values long")


def read_bins(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(image_id, pos, value) of all files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(F.regexp_extract("path", r"(-?\d+)\.bin$", 1).cast("long").alias("image_id"), "content")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = decode(data, kind)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), image)), pa.array(np.arange(len(found))), pa.array(found)], names=["image_id", "pos", "value"])

    return files.mapInArrow(values, f"image_id long, pos long, value {kind}")
