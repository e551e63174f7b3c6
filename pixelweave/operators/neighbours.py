"""Neighbourhoods of pixels: square windows, left and upper neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, place, squared_distance


def gather(pixels: DataFrame, radius: int) -> DataFrame:
    """Adds ``near``: the pixels of the square window, clipped to the image.

    Two nested frames, along rows and then along columns, so the window is
    built from two sorts and no join, and out-of-range neighbours are absent.
    Images must be full: a row reaches a window through the pixel in its column.
    """
    along = W.partitionBy("image_id", "y").orderBy("x").rangeBetween(-radius, radius)
    down = W.partitionBy("image_id", "x").orderBy("y").rangeBetween(-radius, radius)
    rows = pixels.withColumn("row_", F.collect_list(F.struct("x", "y", *CHANNELS)).over(along))
    return rows.withColumn("near", F.flatten(F.collect_list("row_").over(down))).drop("row_")


def window_statistics(pixels: DataFrame, radius: int) -> DataFrame:
    """Count and channel sums of each pixel's window in full images, by the same nested frames without arrays."""
    along = W.partitionBy("image_id", "y").orderBy("x").rangeBetween(-radius, radius)
    down = W.partitionBy("image_id", "x").orderBy("y").rangeBetween(-radius, radius)
    rows = pixels.select("image_id", "x", "y", F.count("*").over(along).alias("n_"), *[F.sum(c).over(along).alias(f"{c}_") for c in CHANNELS])
    return rows.select("image_id", "x", "y", F.sum("n_").over(down).alias("n"), *[F.sum(f"{c}_").over(down).alias(f"sum_{c}") for c in CHANNELS])


def _beside(column: str, steps: int, left: bool) -> Column:
    """The value ``steps`` to the left (or up); null where there is no such pixel.

    A range frame of exactly that distance, so gaps in the raster stay gaps.
    """
    window = W.partitionBy("image_id", "y").orderBy("x") if left else W.partitionBy("image_id", "x").orderBy("y")
    return F.first(column).over(window.rangeBetween(-steps, -steps))


def adjacency(pixels: DataFrame, width: int, colours: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(image_id, a, b, d): each pixel, its left and its upper neighbour, and their squared distance."""
    own = F.struct(place(F.col("x"), F.col("y"), width).alias("g"), *colours)
    marked = pixels.withColumn("own", own)
    both = marked.withColumn("l", _beside("own", 1, True)).withColumn("u", _beside("own", 1, False))
    sides = both.select("image_id", "own", F.explode(F.array("l", "u")).alias("other")).where("other IS NOT NULL")
    d = squared_distance([F.col(f"own.{c}") for c in colours], [F.col(f"other.{c}") for c in colours])
    return sides.select("image_id", F.col("own.g").alias("a"), F.col("other.g").alias("b"), d.alias("d"))
