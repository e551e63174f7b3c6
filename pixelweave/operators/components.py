"""Connected components of pixels, per image.

Edges never leave an image, and most stay inside a tile of it. Each (image,
tile) is solved by a vectorised union-find over the runs of its rows; for
images of more than one tile the few links between tiles are solved by the
distributed star algorithm, so a tile is all that a task must hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.color import CHANNELS
from ..plans.components import connected_components
from ..plans.workspace import dealt, materialise
from .tiles import TILE, component_roots, fits, own_tile, smallest_reachable

ROOTS = "image_id long, g long, root long"


def _solve(key: tuple, rows: pa.Table) -> pa.Table:
    ends = np.concatenate([rows.column(c).to_numpy() for c in ("a", "b")])
    nodes, places = np.unique(ends, return_inverse=True)
    root = nodes[smallest_reachable(len(nodes), *places.reshape(2, -1))]
    return pa.table({"image_id": pa.array(np.full(len(nodes), key[0].as_py(), np.int64)), "g": nodes, "root": root})


def roots(edges: DataFrame, width: int, height: int, tile: int = TILE) -> DataFrame:
    """(image_id, g, root) of every node that has an edge (image_id, a, b); nodes are places in the raster."""
    edges = edges.select("image_id", "a", "b")
    if fits(width, height, tile):
        return edges.groupBy("image_id").applyInArrow(_solve, ROOTS)
    here, there = (F.struct(*own_tile(F.col(end), width, tile)) for end in ("a", "b"))
    tiled = edges.withColumn("tile", here).withColumn("inside", here == there)
    inside = tiled.where("inside").groupBy("image_id", "tile").applyInArrow(_solve, ROOTS)
    solved = materialise(inside, "tiles")
    across = tiled.where("NOT inside").select("image_id", "a", "b")
    for end in ("a", "b"):
        near = solved.select("image_id", F.col("g").alias(end), F.col("root").alias(f"{end}_root"))
        across = across.join(dealt(near), ["image_id", end], "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
    node = lambda c: F.struct("image_id", F.col(c).alias("g")).alias(c)
    joined = connected_components(across.select(node("a"), node("b")), "a", "b", materialise, dealt)
    joined = joined.select(F.col("node.image_id").alias("image_id"), F.col("node.g").alias("root"), F.col("component.g").alias("whole"))
    lifted = solved.join(dealt(joined), ["image_id", "root"], "left").select("image_id", "g", F.coalesce("whole", "root").alias("root"))
    alone = joined.select("image_id", F.col("root").alias("g"), F.col("whole").alias("root")).join(dealt(solved), ["image_id", "g"], "left_anti")
    return lifted.unionByName(alone)


def dense(rooted: DataFrame) -> DataFrame:
    """(image_id, g, label): labels 0, 1, ... in order of the components' first pixels.

    Ranks are taken over the distinct roots, not over the pixels.
    """
    ranks = rooted.where("g = root").select("image_id", "root", (F.row_number().over(W.partitionBy("image_id").orderBy("root")) - 1).cast("long").alias("label"))
    return rooted.join(dealt(ranks), ["image_id", "root"]).select("image_id", "g", "label")


def compact(labels: DataFrame) -> DataFrame:
    """Any labels (image_id, g, label) renumbered 0, 1, ... in their order; -1 stays unlabelled."""
    used = labels.where("label >= 0").select("image_id", "label").distinct()
    ranks = used.withColumn("dense", F.row_number().over(W.partitionBy("image_id").orderBy("label")) - 1)
    return labels.join(dealt(ranks), ["image_id", "label"], "left").select("image_id", "g", F.coalesce("dense", F.lit(-1)).cast("long").alias("label"))


def _numbered(pixels: DataFrame, width: int, height: int, near, colours: tuple[str, ...], seeds: DataFrame | None, tile: int) -> DataFrame:
    found = component_roots(pixels, width, height, near, colours, seeds, tile, ranked=True)
    return found.withColumnRenamed("root", "label") if fits(width, height, tile) else dense(found)


def label_equal(pixels: DataFrame, width: int, height: int, tile: int = TILE) -> DataFrame:
    """Components of equal colour."""
    return _numbered(pixels, width, height, lambda d: d == 0, CHANNELS, None, tile)


def label_range(pixels: DataFrame, width: int, height: int, colour_range: float, seeds: DataFrame | None = None, colours: tuple[str, ...] = CHANNELS, tile: int = TILE) -> DataFrame:
    """Components of neighbours closer than ``colour_range`` (squared, exclusive).

    ``seeds`` (image_id, g, label) ties each pixel to the pixel its label names.
    """
    return _numbered(pixels, width, height, lambda d: d < colour_range, colours, seeds, tile)


def region_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id").agg(F.countDistinct("label").alias("regions"))


def region_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id", "label").agg(F.count("*").alias("n"))


__all__ = ["TILE", "compact", "dense", "label_equal", "label_range", "region_counts", "region_sizes", "roots", "smallest_reachable"]
