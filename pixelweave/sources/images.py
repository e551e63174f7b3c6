"""Image files as pixels, and pixels as image files."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bins import _store

#: Pixels of a batch that a decoded image is handed on in.
BATCH_PIXELS = 1 << 18
PIXELS = "image_id long, x int, y int, c0 int, c1 int, c2 int"


def encode_png(colour: np.ndarray) -> bytes:
    """A PNG of eight-bit red, green and blue from an array (height, width, 3)."""
    high, wide, _ = colour.shape
    lines = np.zeros((high, 1 + 3 * wide), np.uint8)  # every line begins with filter 0
    lines[:, 1:] = colour.reshape(high, 3 * wide)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def write_images(pixels: DataFrame, folder: str) -> DataFrame:
    """A PNG for each image of whole channels 0 to 255, named by its id; returns (image_id, path, pixels).

    Pixels that an image lacks are black.
    """

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        store, base = _store(folder)
        image = key[0].as_py()
        x, y = (rows.column(c).to_numpy() for c in ("x", "y"))
        colour = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        for k in range(3):
            colour[y, x, k] = rows.column(f"c{k}").to_numpy()
        store.create_dir(base, recursive=True)
        part, path = f"{base}/_{image}.{uuid.uuid4().hex}", f"{base}/{image}.png"
        with store.open_output_stream(part) as out:
            out.write(encode_png(colour))
        store.move(part, path)
        return pa.table({"image_id": pa.array([image], pa.int64()), "path": [f"{folder.rstrip('/')}/{image}.png"], "pixels": pa.array([len(x)], pa.int64())})

    return pixels.select("image_id", "x", "y", "c0", "c1", "c2").groupBy("image_id").applyInArrow(write, "image_id long, path string, pixels long")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of JPEG, PNG, BMP or GIF files, by Spark's image source.

    Files that don't decode give no pixels. A grey file repeats its channel; an
    alpha channel is left out. ``image_id`` is the file's name if that is a
    number, else a hash of its address.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    number = F.regexp_extract("origin", r"(?:^|/)(-?\d{1,18})\.[A-Za-z]+$", 1)
    rows = rows.where((F.col("width") > 0) & (F.col("height") > 0)).select(F.when(number != "", number.cast("long")).otherwise(F.xxhash64("origin")).alias("image_id"), "width", "nChannels", "data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, wide, channels, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(-1, channels)  # blue, green, red, and alpha after them
                for at in range(0, len(raw), BATCH_PIXELS):
                    part = raw[at : at + BATCH_PIXELS].astype(np.int32)
                    g = np.arange(at, at + len(part))
                    planes = [part[:, k if channels >= 3 else 0] for k in (2, 1, 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), image, np.int64)), pa.array((g % wide).astype(np.int32)), pa.array((g // wide).astype(np.int32)), *[pa.array(np.ascontiguousarray(p)) for p in planes]], names=["image_id", "x", "y", "c0", "c1", "c2"])

    return rows.mapInArrow(decode, PIXELS)
