"""Mean-shift filter over a fixed square window.

The window stays at the original pixel, so it is gathered once and the steps
are projections over it. Sums are of whole numbers and divided once, which
makes a result independent of the order of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import gather
from .tiles import KEY, each_tile, keyed

MAX_STEPS, STOP_SHIFT, FIRST_SHIFT, LARGEST = 5, 3, 5, 16
#: Sides, without halo, of a tile and of the blocks it is worked through in.
TILE, BLOCK = 128, 64

_SUMS = "aggregate(near, named_struct('n', 0L, 's0', 0L, 's1', 0L, 's2', 0L, 'sx', 0L, 'sy', 0L), (a, p) -> IF((p.c0 * 100D / 255D - at.l) * (p.c0 * 100D / 255D - at.l) + (p.c1 - 128D - at.u) * (p.c1 - 128D - at.u) + (p.c2 - 128D - at.v) * (p.c2 - 128D - at.v) <= {limit}, named_struct('n', a.n + 1L, 's0', a.s0 + p.c0, 's1', a.s1 + p.c1, 's2', a.s2 + p.c2, 'sx', a.sx + p.x, 'sy', a.sy + p.y), a))"

# a window without a member (only rounding could empty it) leaves the state as it is
_MEANS = "IF(sums.n = 0, at, named_struct('l', sums.s0 * 100D / 255D / sums.n, 'u', CAST(sums.s1 AS DOUBLE) / sums.n - 128D, 'v', CAST(sums.s2 AS DOUBLE) / sums.n - 128D, 'x', CAST(floor(CAST(sums.sx AS DOUBLE) / sums.n) AS LONG) + 1L, 'y', CAST(floor(CAST(sums.sy AS DOUBLE) / sums.n) AS LONG) + 1L, 'shift', at.shift, 'steps', at.steps))"

_MOVED = "named_struct('l', m.l, 'u', m.u, 'v', m.v, 'x', m.x, 'y', m.y, 'shift', CAST((m.x - at.x) * (m.x - at.x) + (m.y - at.y) * (m.y - at.y) AS DOUBLE) + (m.l - at.l) * (m.l - at.l) + (m.u - at.u) * (m.u - at.u) + (m.v - at.v) * (m.v - at.v), 'steps', at.steps + 1)"


def start(pixels: DataFrame, radius: int) -> DataFrame:
    """The gathered window and the state before the first step."""
    state = f"named_struct('l', c0 * 100D / 255D, 'u', c1 - 128D, 'v', c2 - 128D, 'x', CAST(x AS LONG), 'y', CAST(y AS LONG), 'shift', {FIRST_SHIFT}D, 'steps', 0)"
    return gather(pixels, radius).select("image_id", "x", "y", "near", F.expr(state).alias("at"))


def step(state: DataFrame, colour_range: float) -> DataFrame:
    """One step for the pixels that still move; ``colour_range`` bounds the squared distance, inclusive."""
    sums = f"IF(at.shift > {STOP_SHIFT}, {_SUMS.format(limit=f'{float(colour_range)!r}D')}, NULL)"
    moving = state.withColumn("sums", F.expr(sums)).withColumn("m", F.expr(f"IF(sums IS NULL, NULL, {_MEANS})"))
    return moving.withColumn("at", F.expr(f"IF(m IS NULL, at, {_MOVED})")).drop("sums", "m")


def finish(state: DataFrame) -> DataFrame:
    """Filtered channels, not rounded, and the number of steps."""
    return state.select("image_id", "x", "y", F.expr("at.l * 255D / 100D").alias("f0"), F.expr("at.u + 128D").alias("f1"), F.expr("at.v + 128D").alias("f2"), F.col("at.steps").alias("iters"))


def clamped(value: int) -> int:
    """The programs know radii and loop counts from 1 to 16; anything else runs as 16."""
    return value if 1 <= value <= LARGEST else LARGEST


def with_halo(pixels: DataFrame, radius: int, tile: int) -> DataFrame:
    """Adds tile_x and tile_y; a pixel within ``radius`` of a tile is there, too, as its halo."""
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile)))
    return pixels.withColumn("tile_x", tiles("x")).withColumn("tile_y", tiles("y"))


def _window_sums(colour: np.ndarray, coded: np.ndarray, here: np.ndarray, corner: tuple[int, int], radius: int, limit: float, at: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, sums of the channels, x and y) over the windows of the pixels at y, x whose colours are ``at``.

    If the pixels fill a rectangle, each offset is a shifted view of the tile; else they are picked.
    """
    left, top = corner
    high, wide = (int(v.max() - v.min()) + 1 if len(v) else 0 for v in (y, x))
    whole = len(y) == high * wide  # then they lie in raster order
    if whole:
        at, y0, x0 = at.reshape(3, high, wide), int(y[0]) if len(y) else 0, int(x[0]) if len(x) else 0
    shape = (high, wide) if whole else (len(y),)
    n, sums = np.zeros(shape, np.int64), np.zeros((5, *shape))
    rows, columns = (y0 + np.arange(high)[:, None], x0 + np.arange(wide)[None, :]) if whole else (y, x)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            pick = (slice(y0 + dy, y0 + dy + high), slice(x0 + dx, x0 + dx + wide)) if whole else (y + dy, x + dx)
            gap = coded[0][pick] - at[0]
            d = gap * gap
            for k in (1, 2):
                gap = coded[k][pick] - at[k]
                d += gap * gap
            member = here[pick] & (d <= limit)
            n += member
            for k in range(3):
                sums[k] += colour[k][pick] * member
            sums[3] += member * (columns + (dx + left))
            sums[4] += member * (rows + (dy + top))
    return n.reshape(-1), sums.reshape(5, -1)


def _tile_filter(radius: int, colour_range: float, max_steps: int, tile: int, block: int):
    """All pixels of a tile, a block that caches hold at a time."""

    def one(image: int, tile_x: int, tile_y: int, rows: pa.Table) -> pa.Table:
        left, top, side = tile_x * tile - radius, tile_y * tile - radius, tile + 2 * radius
        x, y = (rows.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        at = (y - top) * side + (x - left)
        here, colour = np.zeros((side, side), bool), np.zeros((3, side, side))
        here.reshape(-1)[at] = True
        for k in range(3):
            colour[k].reshape(-1)[at] = rows.column(f"c{k}").to_numpy()
        found = [
            _block_filter(here[y0 : y0 + block + 2 * radius, x0 : x0 + block + 2 * radius], colour[:, y0 : y0 + block + 2 * radius, x0 : x0 + block + 2 * radius], (left + x0, top + y0), radius, colour_range, max_steps)
            for y0 in range(0, tile, block)
            for x0 in range(0, tile, block)
            if here[y0 + radius : y0 + block + radius, x0 + radius : x0 + block + radius].any()
        ]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, t) for t in ("i4", "i4", "f8", "f8", "f8", "i4")]
        return pa.table({"image_id": np.full(len(columns[0]), image, np.int64), **dict(zip(("x", "y", "f0", "f1", "f2", "iters"), columns, strict=True))})

    return lambda rows: pa.concat_tables([one(*place, own[0]) for place, own in each_tile(rows)])


def _block_filter(here: np.ndarray, colour: np.ndarray, corner: tuple[int, int], radius: int, colour_range: float, max_steps: int) -> tuple[np.ndarray, ...]:
    """(x, y, f0, f1, f2, iters) of a block's pixels: a pass over the window's offsets for each step, on those that still move."""
    left, top = corner
    high, wide = (n - 2 * radius for n in here.shape)
    coded = np.stack([colour[0] * 100.0 / 255.0, colour[1] - 128.0, colour[2] - 128.0])
    y, x = np.nonzero(here[radius : radius + high, radius : radius + wide])
    y, x = y + radius, x + radius
    at, px, py = coded[:, y, x], x + left, y + top
    shift, steps = np.full(len(x), float(FIRST_SHIFT)), np.zeros(len(x), np.int32)
    for _ in range(max_steps):
        go = np.flatnonzero(shift > STOP_SHIFT)
        if not len(go):
            break
        pick = np.arange(len(x)) if len(go) > len(x) // 3 else go  # views of all cost less than picking many
        n, sums = _window_sums(colour, coded, here, (left, top), radius, colour_range, at[:, pick], y[pick], x[pick])
        if len(pick) > len(go):
            n, sums = n[go], sums[:, go]
        go, sums, n = go[n > 0], sums[:, n > 0], n[n > 0]
        now = np.stack([sums[0] * 100.0 / 255.0 / n, sums[1] / n - 128.0, sums[2] / n - 128.0])
        to_x, to_y = np.floor(sums[3] / n).astype(np.int64) + 1, np.floor(sums[4] / n).astype(np.int64) + 1
        gap = now - at[:, go]
        shift[go] = (to_x - px[go]) ** 2 + (to_y - py[go]) ** 2 + gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]
        at[:, go], px[go], py[go] = now, to_x, to_y
        steps[go] += 1
    return (x + left).astype(np.int32), (y + top).astype(np.int32), at[0] * 255.0 / 100.0, at[1] + 128.0, at[2] + 128.0, steps


def mean_shift(pixels: DataFrame, radius: int, colour_range: float, max_steps: int = MAX_STEPS, engine: str | None = None, tile: int = TILE) -> DataFrame:
    """(image_id, x, y, f0, f1, f2, iters) of every pixel.

    ``engine`` "windows" stays in the JVM, holds a window per pixel and needs
    full images; "tiles" works on tiles with a halo, whose memory hardly grows
    with the radius, and takes images with gaps. Both give the same numbers; by
    default tiles run, being faster. A radius outside 1 to 16 runs as 16.
    """
    radius = clamped(radius)
    if (engine or "tiles") == "tiles":
        block = max(min(BLOCK, tile), 2 * radius)
        tile = -(-tile // block) * block
        spread = with_halo(pixels.select("image_id", "x", "y", "c0", "c1", "c2"), radius, tile)
        return keyed(spread).groupBy(KEY).applyInArrow(_tile_filter(radius, float(colour_range), max_steps, tile, block), "image_id long, x int, y int, f0 double, f1 double, f2 double, iters int")
    state = start(pixels, radius)
    for _ in range(max_steps):
        state = step(state, colour_range)
    return finish(state)
