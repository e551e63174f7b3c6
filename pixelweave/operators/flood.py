"""Flooding: every pixel follows its most similar left or upper pixel to a root.

A parent lies before its pixel in raster order, so the links are a forest and a
tree's root is its smallest pixel. Tiles find links and follow them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.color import CHANNELS
from .tiles import TILE, flood_parents, flood_roots

LABEL_STEP = 10


def parents(pixels: DataFrame, width: int, radius: int, colour_range: float, height: int | None = None, tile: int = TILE, device: bool = False) -> DataFrame:
    """(image_id, g, p): p is the closest candidate if nearer than ``colour_range`` (exclusive), else g.

    Without a ``height`` images are tiled whatever their size.
    """
    return flood_parents(pixels, width, tile + 1 if height is None else height, radius, colour_range, CHANNELS, tile, device)


def initial(pixels: DataFrame, width: int) -> DataFrame:
    """Every pixel is its own label."""
    return pixels.selectExpr("image_id", f"CAST(y AS LONG) * {width} + x AS g").selectExpr("*", "g AS label")


def jump(links: DataFrame) -> DataFrame:
    """One pointer jump: each pixel's parent becomes its parent's parent."""
    up = links.selectExpr("image_id", "g AS p", "p AS next")
    return links.join(up, ["image_id", "p"]).selectExpr("image_id", "g", "next AS p")


def apply_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Each pixel takes the label of its parent."""
    named = labels.selectExpr("image_id", "g AS p", "label")
    return links.join(named, ["image_id", "p"]).select("image_id", "g", "label")


def flood(pixels: DataFrame, width: int, height: int, radius: int, colour_range: float, loops: int = 1, scale_by_loops: bool = False, step: int = LABEL_STEP, tile: int = TILE, device: bool = False) -> DataFrame:
    """(image_id, g, label): ``step`` times the root's place.

    A raster-order sweep reaches every root in its first pass, so more
    ``loops`` only matter with ``scale_by_loops``, which divides the range.
    ``device`` takes the tie and border rules of the graphics-card programs.
    """
    limit = colour_range / loops if scale_by_loops else colour_range
    found = flood_roots(pixels, width, height, radius, limit, CHANNELS, tile, device)
    return found.selectExpr("image_id", "g", f"root * {step} AS label")
