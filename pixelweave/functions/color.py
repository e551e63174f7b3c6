"""Column expressions over pixels: colour coding, distances, places, label colours.

Channels are integers 0 to 255 in columns c0, c1, c2. The L, U, V coding only
rescales them; there is no conversion between colour spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("c0", "c1", "c2")
# fixed values: the multiplier and the channel masks and shifts of the label colours
HASH_FACTOR, WORD = 0x01234567, 0xFFFFFFFF
RED_MASK, RED_SHIFT, GREEN_MASK, GREEN_SHIFT, BLUE_MASK = 0xFF0000, 4, 0xFF00, 2, 0xFF


def luv_encode(c0: Column, c1: Column, c2: Column) -> tuple[Column, Column, Column]:
    return c0 * F.lit(100.0) / F.lit(255.0), c1 - F.lit(128.0), c2 - F.lit(128.0)


def luv_decode(lum: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    return lum * F.lit(255.0) / F.lit(100.0), u + F.lit(128.0), v + F.lit(128.0)


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    """Sum of squared differences; never rooted."""
    total = None
    for x, y in zip(a, b, strict=True):
        part = (x - y) * (x - y)
        total = part if total is None else total + part
    return total


def same_colour(a: list[Column], b: list[Column]) -> Column:
    equal = F.lit(True)
    for x, y in zip(a, b, strict=True):
        equal = equal & (x == y)
    return equal


def place(x: Column, y: Column, width: int) -> Column:
    """Raster index, so that raster order is numeric order."""
    return y.cast("long") * width + x


def coordinates(g: Column, width: int) -> tuple[Column, Column]:
    return (g % width).cast("int"), F.floor(g / width).cast("int")


def label_colour(label: Column) -> tuple[Column, Column, Column]:
    """Three channels from a label, in unsigned 32-bit arithmetic."""
    t = (label.cast("long") * F.lit(HASH_FACTOR)).bitwiseAND(F.lit(WORD))
    return (
        F.shiftright(t.bitwiseAND(F.lit(RED_MASK)), RED_SHIFT),
        F.shiftright(t.bitwiseAND(F.lit(GREEN_MASK)), GREEN_SHIFT),
        t.bitwiseAND(F.lit(BLUE_MASK)),
    )
