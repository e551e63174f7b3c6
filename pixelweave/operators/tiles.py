"""Kernels over tiles: the pixels of a tile as arrays, with a halo of its left and upper neighbours.

An image that fits a tile is one group. A larger one is dealt to tiles, and a
pixel that others to its right or below look back at is copied there as halo.
A kernel solves its tile alone; ``lift`` joins the few trees that cross a border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.workspace import dealt, materialise

TILE = 1024

#: One row per pixel (g, root), and one per link to another tile (root, other).
SOLVED = "image_id long, g long, root long, other long"


def fits(width: int, height: int, tile: int) -> bool:
    return width <= tile and height <= tile


def deal(pixels: DataFrame, reach: int, tile: int) -> DataFrame:
    """Adds tile_x and tile_y: a pixel's own tile, and those whose pixels look back at it within ``reach``."""
    both = lambda c: F.explode(F.sequence(F.floor(F.col(c) / tile), F.floor((F.col(c) + reach) / tile)))
    return pixels.withColumn("tile_x", both("x")).withColumn("tile_y", both("y"))


#: Numbers an image's tiles; Spark sorts one number much faster than three columns.
KEY = "tile_key"


def keyed(tiled: DataFrame) -> DataFrame:
    """Adds a hash of image_id, tile_x and tile_y to group by; ``each_tile`` takes those apart that share one."""
    return tiled.withColumn(KEY, F.xxhash64("image_id", "tile_x", "tile_y"))


def each_tile(*sides: pa.Table) -> Iterator[tuple[tuple[int, int, int], list[pa.Table]]]:
    """((image, tile_x, tile_y), rows of each side) for the tiles of the first that came together as one group."""
    names = ("image_id", "tile_x", "tile_y")
    ids = [np.stack([t.column(c).to_numpy() for c in names]) for t in sides]
    if ids[0].shape[1]:
        first = ids[0][:, :1]
        if all((x == first).all() for x in ids):
            yield tuple(int(v) for v in first[:, 0]), list(sides)
        else:
            for tile in np.unique(ids[0], axis=1).T:
                yield tuple(int(v) for v in tile), [t.filter(pa.array((x == tile[:, None]).all(axis=0))) for t, x in zip(sides, ids, strict=True)]


def own_tile(g: Column, width: int, tile: int) -> tuple[Column, Column]:
    """(tile_x, tile_y) of a place in the raster."""
    return F.floor((g % width) / tile).alias("tile_x"), F.floor(F.floor(g / width) / tile).alias("tile_y")


class Grid:
    """The pixels of one group as arrays over their bounding box."""

    def __init__(self, rows: pa.Table, width: int, colours: tuple[str, ...], corner: tuple[int, int] | None):
        x, y = (rows.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        self.left, self.top = (int(x.min()), int(y.min())) if len(x) else (0, 0)
        self.shape = (int(y.max()) - self.top + 1, int(x.max()) - self.left + 1) if len(x) else (0, 0)
        self.width = width
        at = (y - self.top) * self.shape[1] + (x - self.left)
        self.here = np.zeros(self.shape, bool)
        self.here.reshape(-1)[at] = True
        self.colour = np.zeros((len(colours), *self.shape))
        for k, c in enumerate(colours):
            self.colour[k].reshape(-1)[at] = rows.column(c).to_numpy()
        self.own = self.here
        if corner is not None:  # what lies before the tile's corner is halo
            self.own = self.here.copy()
            self.own[: max(0, corner[1] - self.top), :] = False
            self.own[:, : max(0, corner[0] - self.left)] = False

    def distance(self, dy: int, dx: int) -> np.ndarray:
        """Squared distance of each cell from the one ``dy`` above and ``dx`` to the left; not a number where either is missing."""
        h, w = self.shape
        total = np.zeros((h - dy, w - dx))
        for plane in self.colour:
            gap = plane[dy:, dx:] - plane[: h - dy, : w - dx]
            gap *= gap
            total += gap
        total[~(self.here[dy:, dx:] & self.here[: h - dy, : w - dx])] = np.nan
        return total

    def place(self, cells: np.ndarray) -> np.ndarray:
        """Places in the image's raster of cells of the box."""
        wide = max(1, self.shape[1])
        return (cells // wide + self.top) * self.width + cells % wide + self.left

    def cell(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, whether they hold a pixel) of places in the image's raster."""
        y, x = places // self.width - self.top, places % self.width - self.left
        inside = (y >= 0) & (x >= 0) & (y < self.shape[0]) & (x < self.shape[1])
        cells = np.where(inside, y * self.shape[1] + x, 0)
        return cells, inside & self.here.reshape(-1)[cells] if len(self.here.reshape(-1)) else inside


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 with edges a-b, the smallest node each is connected to."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        high, low = np.maximum(x, y), np.minimum(x, y)
        open_ = high != low
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def components(left: np.ndarray, up: np.ndarray, ties: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first cell of each cell's component; ``left`` and ``up`` say which cells join the one before or above.

    Rows are cut into runs first, so that only runs are joined.
    """
    wide = left.shape[1]
    begins = ~left.reshape(-1)
    run = np.cumsum(begins) - 1
    joined = np.flatnonzero(up.reshape(-1))
    a, b = run[joined], run[joined - wide]
    if len(a):  # two long runs meet in many cells
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b = a[fresh], b[fresh]
    if ties is not None:
        a, b = np.concatenate([a, run[ties[0]]]), np.concatenate([b, run[ties[1]]])
    first = np.flatnonzero(begins)
    return first[smallest_reachable(len(first), a, b)[run]]


def parents(grid: Grid, radius: int, limit: float, device: bool = False) -> np.ndarray:
    """Each cell's most similar cell to the left or above, if nearer than ``limit``; else itself.

    Candidates are visited farthest first, up before left, and a later one must
    be closer. With ``device``, the first of equals in raster order wins, and
    the image's first row and column are no candidates above or to the left.
    """
    h, w = grid.shape
    best = np.full(grid.shape, np.inf)
    cells = np.arange(h * w).reshape(grid.shape)
    link = cells.copy()
    for step in range(radius, 0, -1):
        for dy, dx in ((step, 0), (0, step)):
            if dy < h and dx < w:
                d, from_ = grid.distance(dy, dx), cells[: h - dy, : w - dx]
                closer = d < best[dy:, dx:]  # never for a missing cell
                if device:
                    closer |= (d == best[dy:, dx:]) & (from_ < link[dy:, dx:])
                    if dy and not grid.top:
                        closer[0] = False
                    if dx and not grid.left:
                        closer[:, 0] = False
                np.copyto(best[dy:, dx:], d, where=closer)
                np.copyto(link[dy:, dx:], from_, where=closer)
    return np.where(best < limit, link, cells).reshape(-1)


def _table(image: int, **columns: np.ndarray | None) -> pa.Table:
    n = next(len(c) for c in columns.values() if c is not None)
    return pa.table({"image_id": pa.array(np.full(n, image, np.int64)), **{k: pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for k, c in columns.items()}})


def _per_group(solve: Callable[..., pa.Table], whole: bool, tile: int) -> Callable[..., pa.Table]:
    """``solve`` (image, corner, rows, ...) as a function of Arrow groups: whole images, or tiles by ``KEY``."""

    def run(key: tuple, *sides: pa.Table) -> pa.Table:
        if whole:
            return solve(key[0].as_py(), None, *sides)
        found = [solve(image, (tile_x * tile, tile_y * tile), *own) for (image, tile_x, tile_y), own in each_tile(*sides)]
        return pa.concat_tables(found) if found else solve(0, None, *sides)

    return run


def _grouped(pixels: DataFrame, width: int, height: int, reach: int, tile: int):
    if fits(width, height, tile):
        return pixels.groupBy("image_id")
    return keyed(deal(pixels, reach, tile)).groupBy(KEY)


def flood_parents(pixels: DataFrame, width: int, height: int, radius: int, limit: float, colours: tuple[str, ...], tile: int = TILE, device: bool = False) -> DataFrame:
    """(image_id, g, p) of every pixel."""

    def solve(image: int, corner: tuple[int, int] | None, rows: pa.Table) -> pa.Table:
        grid = Grid(rows, width, colours, corner)
        own = np.flatnonzero(grid.own)
        return _table(image, g=grid.place(own), p=grid.place(parents(grid, radius, limit, device)[own]))

    grouped = _grouped(pixels.select("image_id", "x", "y", *colours), width, height, radius, tile)
    run = _per_group(solve, fits(width, height, tile), tile)
    return grouped.applyInArrow(lambda key, rows: run(key, rows), "image_id long, g long, p long")


def flood_roots(pixels: DataFrame, width: int, height: int, radius: int, limit: float, colours: tuple[str, ...], tile: int = TILE, device: bool = False) -> DataFrame:
    """(image_id, g, root) of every pixel: where its chain of parents ends."""

    def solve(image: int, corner: tuple[int, int] | None, rows: pa.Table) -> pa.Table:
        grid = Grid(rows, width, colours, corner)
        up = parents(grid, radius, limit, device)
        up[~grid.own.reshape(-1)] = np.flatnonzero(~grid.own)  # a chain that leaves the tile stops in the halo
        while not ((far := up[up]) == up).all():
            up = far
        own = np.flatnonzero(grid.own)
        root = grid.place(up[own])
        solved = _table(image, g=grid.place(own), root=root, other=None)
        beyond = np.unique(root[~grid.own.reshape(-1)[up[own]]])
        return pa.concat_tables([solved, _table(image, g=None, root=beyond, other=beyond)]) if len(beyond) else solved

    whole = fits(width, height, tile)
    run = _per_group(solve, whole, tile)
    solved = _grouped(pixels.select("image_id", "x", "y", *colours), width, height, radius, tile).applyInArrow(lambda key, rows: run(key, rows), SOLVED)
    return solved.select("image_id", "g", "root") if whole else lift(solved)


def component_roots(pixels: DataFrame, width: int, height: int, near: Callable[[np.ndarray], np.ndarray], colours: tuple[str, ...], seeds: DataFrame | None = None, tile: int = TILE, ranked: bool = False) -> DataFrame:
    """(image_id, g, root) of every pixel: the first pixel of its component.

    ``near`` says of squared distances which join. ``seeds`` (image_id, g,
    label) join a pixel to the one its label names, wherever that lies. With
    ``ranked``, components are numbered 0, 1, ... instead, in an image that fits a tile.
    """
    whole = fits(width, height, tile)

    def solve(image: int, corner: tuple[int, int] | None, rows: pa.Table, ties: pa.Table | None = None) -> pa.Table:
        grid = Grid(rows, width, colours, corner)
        left, up = np.zeros((2, *grid.shape), bool)
        if grid.shape[1] > 1:
            left[:, 1:] = near(grid.distance(0, 1))
        if grid.shape[0] > 1:
            up[1:] = near(grid.distance(1, 0))
        halo = ~grid.own & grid.here
        across = []  # (cell here, place in another tile)
        if halo.any():
            for side, dy, dx in ((left, 0, 1), (up, 1, 0)):
                over = np.zeros(grid.shape, bool)
                over[dy:, dx:] = halo[: grid.shape[0] - dy, : grid.shape[1] - dx]
                over &= side & grid.own
                cells = np.flatnonzero(over)
                across.append((cells, grid.place(cells - dy * grid.shape[1] - dx)))
                side[over] = False
                side[halo] = False
        pairs = None
        if ties is not None and len(ties):
            a, b = (ties.column(c).to_numpy().astype(np.int64) for c in ("g", "label"))
            (a_cell, a_here), (b_cell, b_here) = grid.cell(a), grid.cell(b)
            mine = grid.own.reshape(-1)
            a_here &= mine[a_cell]
            inside = a_here & b_here & mine[b_cell]
            pairs = a_cell[inside], b_cell[inside]
            far = a_here & ~inside
            across.append((a_cell[far], b[far]))
        root = components(left, up, pairs)
        own = np.flatnonzero(grid.own)
        if whole and ranked:
            return _table(image, g=grid.place(own), root=np.unique(root[own], return_inverse=True)[1], other=None)
        out = [_table(image, g=grid.place(own), root=grid.place(root[own]), other=None)]
        if across and not whole:
            cells, other = (np.concatenate([x[k] for x in across]) for k in (0, 1))
            links = np.unique(np.stack([grid.place(root[cells]), other]), axis=1)
            out.append(_table(image, g=None, root=links[0], other=links[1]))
        return pa.concat_tables(out)

    grouped = _grouped(pixels.select("image_id", "x", "y", *colours), width, height, 1, tile)
    run = _per_group(solve, whole, tile)
    if seeds is None:
        solved = grouped.applyInArrow(lambda key, rows: run(key, rows), SOLVED)
    else:
        ties = seeds.where("g != label").select("image_id", "g", "label")
        tied = ties.groupBy("image_id") if whole else keyed(ties.select("*", *own_tile(F.col("g"), width, tile))).groupBy(KEY)
        solved = grouped.cogroup(tied).applyInArrow(lambda key, rows, links: run(key, rows, links), SOLVED)
    return solved.select("image_id", "g", "root") if whole else lift(solved)


def lift(solved: DataFrame) -> DataFrame:
    """(image_id, g, root) over all tiles: trees that links join get their smallest root.

    A node is an image and a place, so any id does. Links to places without a pixel are ignored.
    """
    solved = materialise(solved, "tiles")
    pixels = solved.where("other IS NULL").select("image_id", "g", "root")
    ends = pixels.select("image_id", F.col("g").alias("other"), F.col("root").alias("beyond"))
    met = solved.where("other IS NOT NULL").select("image_id", "root", "other").distinct().join(dealt(ends), ["image_id", "other"])
    edges = met.select(F.struct("image_id", F.col("root").alias("g")).alias("a"), F.struct("image_id", F.col("beyond").alias("g")).alias("b"))
    joined = connected_components(edges, "a", "b", materialise, dealt)
    tops = joined.select(F.col("node.image_id").alias("image_id"), F.col("node.g").alias("root"), F.col("component.g").alias("top"))
    return pixels.join(dealt(tops), ["image_id", "root"], "left").select("image_id", "g", F.coalesce("top", "root").alias("root"))
