"""The whole chain: filter, flood, components, colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.color import label_colour
from ..operators.components import label_range
from ..operators.flood import flood
from ..operators.meanshift import mean_shift

FLOOD_LOOPS, FLOOD_RADIUS = 6, 4


def filtered_pixels(pixels: DataFrame, radius: int, colour_range: float) -> DataFrame:
    done = mean_shift(pixels, radius, colour_range)
    return done.select("image_id", "x", "y", *[F.col(f"f{k}").alias(f"c{k}") for k in range(3)])


def colour_labels(labels: DataFrame) -> DataFrame:
    r, g, b = label_colour(F.col("label"))
    return labels.select(*labels.columns, r.alias("r"), g.alias("g_"), b.alias("b")).withColumnRenamed("g_", "green").withColumnRenamed("r", "red").withColumnRenamed("b", "blue")


def segment(pixels: DataFrame, width: int, height: int, radius: int, colour_range: float, connect_range: float, seeded: bool = False) -> DataFrame:
    """(image_id, g, label, red, green, blue); ``seeded`` lets flooding tie pixels, as the frame loop does."""
    smooth = filtered_pixels(pixels, radius, colour_range)
    seeds = None
    if seeded:
        seeds = flood(smooth, width, height, FLOOD_RADIUS, connect_range, FLOOD_LOOPS, scale_by_loops=True, step=1)
    return colour_labels(label_range(smooth, width, height, connect_range, seeds))


def region_report(labels: DataFrame) -> DataFrame:
    """What the programs log: pixels and regions of each image."""
    return labels.groupBy("image_id").agg(F.count("*").alias("pixels"), F.countDistinct("label").alias("regions"))


def run_metrics(labels: DataFrame) -> dict[str, int]:
    """Images, pixels and regions that a run counts as it passes, for a log; the labels are computed once."""
    seen = Observation("segment")
    report = region_report(labels).observe(seen, F.count("*").alias("images"), F.coalesce(F.sum("pixels"), F.lit(0)).alias("pixels"), F.coalesce(F.sum("regions"), F.lit(0)).alias("regions"))
    report.write.format("noop").mode("overwrite").save()
    return seen.get


__all__ = ["colour_labels", "filtered_pixels", "region_report", "run_metrics", "segment"]
