"""Pixel tables ``(image_id, x, y, c0, c1, c2)`` from tables, scenes and image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_WIDTH, FRAME_HEIGHT = 40, 25
EVENT_CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
EMBEDDING_WIDTH = 64
SCENE_WIDTH, SCENE_HEIGHT, SCENE_SQUARES, SCENE_SIDE = 640, 480, 10, 20


def event_raster(events: DataFrame, width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT) -> DataFrame:
    """A frame for every ``width * height`` events, a pixel an event."""
    area = width * height
    kind = F.lit(0)
    for name, code in EVENT_CODES.items():
        kind = F.when(F.col("event_type") == name, code).otherwise(kind)
    return events.select(
        F.floor(F.col("event_id") / area).cast("long").alias("image_id"),
        (F.col("event_id") % width).cast("int").alias("x"),
        F.floor((F.col("event_id") % area) / width).cast("int").alias("y"),
        F.floor(F.least(F.col("value"), F.lit(255.0))).cast("int").alias("c0"),
        (F.col("user_id") % 256).cast("int").alias("c1"),
        kind.cast("int").alias("c2"),
    )


def quantised(pixels: DataFrame, step: int) -> DataFrame:
    """Grey pixels: all channels are the first one's step."""
    grey = F.floor(F.col("c0") / step).cast("int")
    return pixels.select("image_id", "x", "y", grey.alias("c0"), grey.alias("c1"), grey.alias("c2"))


def embedding_raster(embeddings: DataFrame) -> DataFrame:
    """One image: a row for every three vectors, a channel a vector, a column a dimension."""
    cells = embeddings.select("vec_id", F.posexplode("embedding").alias("x", "value"))
    shade = F.least(F.greatest(F.floor((F.col("value").cast("double") + 0.5) * 256), F.lit(0)), F.lit(255)).cast("int")
    pixels = cells.groupBy(F.floor(F.col("vec_id") / 3).cast("int").alias("y"), "x").agg(*[F.max(F.when(F.col("vec_id") % 3 == k, shade)).alias(f"c{k}") for k in range(3)])
    return pixels.where("c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL").select(F.lit(0).cast("long").alias("image_id"), "x", "y", "c0", "c1", "c2")


def square_corners(squares: int, width: int, height: int, side: int) -> list[tuple[int, int, int, int]]:
    """(rank, left, top, side): places from multiplications modulo a prime, the same on any machine."""
    out = []
    for i in range(squares):
        draw = [(i + 1) * f % 10_007 for f in (7_919, 6_101, 3_571)]
        out.append((i, draw[0] % width, draw[1] % height, 1 + draw[2] % side))
    return out


def square_scene(spark: SparkSession, width: int = SCENE_WIDTH, height: int = SCENE_HEIGHT, squares: int = SCENE_SQUARES, side: int = SCENE_SIDE) -> DataFrame:
    """Squares of value (i + 1) * 10 on black, clipped to the scene; a later one covers an earlier one.

    A square's pixels are generated from its own corners, so nothing is compared
    with every pixel of the scene.
    """
    corners = spark.createDataFrame(square_corners(squares, width, height, side), "i int, left int, top int, side int")
    drawn = corners.select("i", "top", "side", F.explode(F.expr("sequence(left, left + side - 1)")).alias("x")).select("i", "x", F.explode(F.expr("sequence(top, top + side - 1)")).alias("y"))
    drawn = drawn.where((F.col("x") < width) & (F.col("y") < height)).groupBy("x", "y").agg(((F.max("i") + 1) * 10).alias("value"))
    grid = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    value = F.coalesce("value", F.lit(0)).cast("int")
    return grid.join(drawn, ["x", "y"], "left").select(F.lit(0).cast("long").alias("image_id"), "x", "y", value.alias("c0"), value.alias("c1"), value.alias("c2"))


def hashed_raster(spark: SparkSession, images: int, width: int, height: int, patch: int = 8, noise: int = 12) -> DataFrame:
    """Images of patches in hashed colours with hashed noise: deterministic pixels at any size, for timing."""
    area = width * height
    pixels = spark.range(images * area).select(F.floor(F.col("id") / area).cast("long").alias("image_id"), (F.col("id") % width).cast("int").alias("x"), F.floor((F.col("id") % area) / width).cast("int").alias("y"), "id")
    channel = lambda k: (F.pmod(F.xxhash64("image_id", F.floor(F.col("x") / patch), F.floor(F.col("y") / patch), F.lit(k)), F.lit(256 - noise)) + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(noise))).cast("int")
    return pixels.select("image_id", "x", "y", *[channel(k).alias(f"c{k}") for k in range(3)])


def check_channels(pixels: DataFrame) -> DataFrame:
    """Per image: whether it has pixels and each has three channels, as the programs require."""
    full = F.col("c0").isNotNull() & F.col("c1").isNotNull() & F.col("c2").isNotNull()
    return pixels.groupBy("image_id").agg(F.count("*").alias("pixels"), F.min(full.cast("int")).alias("three_channels"))
