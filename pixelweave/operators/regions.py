"""Region tables, their adjacency, and merging of similar neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, place
from ..plans.workspace import dealt, materialise
from .components import TILE, compact, roots
from .neighbours import adjacency
from .tiles import fits, smallest_reachable

MERGE_DISTANCE, MERGE_ROUNDS = 6.5, 5


def one_per_pixel(pixels: DataFrame, width: int) -> DataFrame:
    """(image_id, g, label): every pixel a region."""
    return pixels.select("image_id", place(F.col("x"), F.col("y"), width).alias("g")).withColumn("label", F.col("g"))


def region_table(pixels: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """(image_id, label, n, m0, m1, m2): size and mean colour."""
    own = pixels.select("image_id", place(F.col("x"), F.col("y"), width).alias("g"), *CHANNELS)
    means = [(F.sum(c).cast("double") / F.count("*")).alias(f"m{k}") for k, c in enumerate(CHANNELS)]
    return own.join(dealt(labels), ["image_id", "g"]).groupBy("image_id", "label").agg(F.count("*").alias("n"), *means)


def region_adjacency(pixels: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """(image_id, a, b): labels that touch along a side, a < b, each pair once."""
    edges = adjacency(pixels, width).select("image_id", "a", "b")
    for end in ("a", "b"):
        edges = edges.join(dealt(labels.select("image_id", F.col("g").alias(end), F.col("label").alias(f"l{end}"))), ["image_id", end])
    return edges.where("la != lb").select("image_id", F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()


def neighbour_sets(adjacent: DataFrame) -> DataFrame:
    """(image_id, label, neighbours): each region's sorted set."""
    both = adjacent.unionByName(adjacent.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("image_id", F.col("a").alias("label")).agg(F.array_sort(F.collect_set("b")).alias("neighbours"))


def merged_sets(left: str, right: str):
    """The sorted union of two sorted sets, each member once."""
    return F.array_sort(F.array_union(left, right))


def merge_round(pixels: DataFrame, labels: DataFrame, width: int, height: int, distance: float = MERGE_DISTANCE, tile: int = TILE) -> DataFrame:
    """Joins touching regions whose means are closer than ``distance``; labels stay in raster order."""
    table = region_table(pixels, labels, width)
    pairs = region_adjacency(pixels, labels, width)
    for end in ("a", "b"):
        pairs = pairs.join(dealt(table.select("image_id", F.col("label").alias(end), *[F.col(f"m{k}").alias(f"{end}{k}") for k in range(3)])), ["image_id", end])
    d = sum(((F.col(f"a{k}") - F.col(f"b{k}")) * (F.col(f"a{k}") - F.col(f"b{k}")) for k in range(3)), F.lit(0.0))
    edges = pairs.where(d < distance * distance).select("image_id", "a", "b")
    found = roots(edges, width, height, tile).select("image_id", F.col("g").alias("label"), "root")
    joined = labels.join(dealt(found), ["image_id", "label"], "left").select("image_id", "g", F.coalesce("root", "label").alias("label"))
    return compact(joined)


def _merge(rows: pa.Table, width: int, limit: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(g, label) of every row of an image whose regions start with one pixel each, as rounds of ``merge_round`` leave them.

    Copies of a pixel weigh as they do in that join: each meets the labels of all.
    """
    x, y = (rows.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
    left, top = x.min(), y.min()
    wide = x.max() - left + 1
    cells, at, copies = np.unique((y - top) * wide + x - left, return_inverse=True, return_counts=True)
    beside = np.flatnonzero((cells[1:] == cells[:-1] + 1) & (cells[1:] % wide != 0)) + 1
    above = np.searchsorted(cells, cells - wide)
    below = np.flatnonzero(cells[above] == cells - wide)
    a, b = np.concatenate([beside, below]), np.concatenate([beside - 1, above[below]])
    known, total = [], []
    for c in CHANNELS:
        column = rows.column(c)
        known.append(copies * np.bincount(at, column.is_valid().to_numpy()))
        total.append(copies * np.bincount(at, column.fill_null(0).to_numpy()))
    label, count = np.arange(len(cells)), None
    for _ in range(rounds):
        n = np.bincount(label, copies * copies)
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        p, q = label[a], label[b]
        d = np.zeros(len(p))
        for k in range(len(CHANNELS)):
            mean = np.where(np.bincount(label, known[k]) > 0, np.bincount(label, total[k]) / n, np.nan)  # nulls alone have no mean
            gap = mean[p] - mean[q]
            d += gap * gap
        near = d < limit  # never where a mean is missing
        label = np.unique(smallest_reachable(len(n), p[near], q[near]), return_inverse=True)[1][label]
        now = int(label.max()) + 1
        if now == count:
            break
        count = now
    return y * width + x, label[at]


def _merge_images(pixels: DataFrame, width: int, limit: float, rounds: int) -> DataFrame:
    """All rounds of an image in one group; (image_id, g, label)."""

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        g, label = _merge(rows, width, limit, rounds)
        return pa.table({"image_id": pa.array(np.full(len(g), key[0].as_py(), np.int64)), "g": g, "label": label})

    return pixels.select("image_id", "x", "y", *CHANNELS).groupBy("image_id").applyInArrow(solve, "image_id long, g long, label long")


def merge_regions(pixels: DataFrame, width: int, height: int, labels: DataFrame | None = None, distance: float = MERGE_DISTANCE, rounds: int = MERGE_ROUNDS, tile: int = TILE) -> DataFrame:
    """Rounds of merging until the number of regions stays, ``rounds`` at most; (image_id, g, label).

    An image that has settled is not changed by further rounds. One that fits a
    tile and starts with a region for every pixel is merged as a group. Else all
    images run together, by joins, until the last settles. Pixels without an
    image or a place are in no region.
    """
    pixels = pixels.where("image_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    if labels is None and rounds > 0 and fits(width, height, tile):
        return _merge_images(pixels, width, distance * distance, rounds)
    labels = materialise(labels if labels is not None else one_per_pixel(pixels, width), "labels")
    count = None
    for _ in range(rounds):
        labels = materialise(merge_round(pixels, labels, width, height, distance, tile), "labels")
        now = labels.select("image_id", "label").distinct().count()
        if now == count:
            break
        count = now
    return labels
