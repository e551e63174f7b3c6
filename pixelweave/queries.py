"""Queries over rasters built from the tables; their SQL is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.color import coordinates, label_colour, luv_decode, luv_encode, place, same_colour
from .operators import compare, components, flood, meanshift, neighbours, regions
from .oracles import oracle_sql
from .plans.segment import filtered_pixels, region_report, run_metrics, segment
from .plans.workspace import materialise, new_path
from .sources import bins, images, rasters
from .streaming.frames import frame_regions

WIDTH, HEIGHT = rasters.FRAME_WIDTH, rasters.FRAME_HEIGHT
WINDOW, BALL = 2, 2500.0
FLOOD_RADIUS, FLOOD_RANGE = 4, 1.0
GREY_STEP, CONNECT = 64, 300.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.event_raster(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _grey(spark: SparkSession, sf_dir: str, step: int = GREY_STEP) -> DataFrame:
    return rasters.quantised(_events(spark, sf_dir), step)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def raster_scan(spark, sf_dir):
    g = place(F.col("x"), F.col("y"), WIDTH)
    scan = _events(spark, sf_dir).withColumn("g", g)
    x, y = coordinates(F.col("g"), WIDTH)
    return scan.withColumn("x_back", x).withColumn("y_back", y)


def embedding_scan(spark, sf_dir):
    return rasters.embedding_raster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def square_scene(spark, sf_dir):
    return rasters.square_scene(spark).select("x", "y", F.col("c0").alias("value"))


def channel_check(spark, sf_dir):
    return rasters.check_channels(_events(spark, sf_dir))


def luv_code(spark, sf_dir):
    lum, u, v = luv_encode(F.col("c0"), F.col("c1"), F.col("c2"))
    return _rounded(_events(spark, sf_dir).select("image_id", "x", "y", lum.alias("l"), u.alias("u"), v.alias("v")), "l", "u", "v")


def luv_roundtrip(spark, sf_dir):
    coded = luv_encode(F.col("c0"), F.col("c1"), F.col("c2"))
    back = luv_decode(*coded)
    return _rounded(_events(spark, sf_dir).select("image_id", "x", "y", *[c.alias(f"f{k}") for k, c in enumerate(back)]), "f0", "f1", "f2")


def window_gather_stats(spark, sf_dir):
    return neighbours.window_statistics(_events(spark, sf_dir), WINDOW)


def window_gather(spark, sf_dir):
    near = neighbours.gather(_events(spark, sf_dir), WINDOW)
    return near.select("image_id", "x", "y", F.size("near").alias("n"), F.aggregate("near", F.lit(0).cast("long"), lambda a, p: a + p["c0"] * (p["x"] + 1) + p["c1"] * (p["y"] + 1)).alias("moment"))


def mean_shift_step(spark, sf_dir):
    state = meanshift.step(meanshift.start(_events(spark, sf_dir), WINDOW), BALL)
    return _rounded(state.select("image_id", "x", "y", "at.l", "at.u", "at.v", F.col("at.x").alias("to_x"), F.col("at.y").alias("to_y"), "at.shift"), "l", "u", "v", "shift")


def mean_shift_filter(spark, sf_dir):
    return _rounded(meanshift.mean_shift(_events(spark, sf_dir), WINDOW, BALL), "f0", "f1", "f2")


def mean_shift_wide(spark, sf_dir):
    """The window and ball of the filter's own test script."""
    return _rounded(meanshift.mean_shift(_events(spark, sf_dir), 13, 100.0), "f0", "f1", "f2")


def mean_shift_iterations(spark, sf_dir):
    return meanshift.mean_shift(_events(spark, sf_dir), WINDOW, BALL).groupBy("iters").agg(F.count("*").alias("pixels"))


def flood_parent(spark, sf_dir):
    return flood.parents(_grey(spark, sf_dir), WIDTH, FLOOD_RADIUS, FLOOD_RANGE, HEIGHT)


def flood_device(spark, sf_dir):
    """Parents by the tie and border rules of the graphics-card programs."""
    return flood.parents(_grey(spark, sf_dir), WIDTH, FLOOD_RADIUS, FLOOD_RANGE, HEIGHT, device=True)


def flood_tiled(spark, sf_dir):
    """The same labels as flood_labels, found in 8-by-8 tiles and joined across their borders."""
    return flood.flood(_grey(spark, sf_dir), WIDTH, HEIGHT, FLOOD_RADIUS, FLOOD_RANGE, tile=8)


def flood_labels(spark, sf_dir):
    return flood.flood(_grey(spark, sf_dir), WIDTH, HEIGHT, FLOOD_RADIUS, FLOOD_RANGE)


def flood_scaled(spark, sf_dir):
    return flood.flood(_grey(spark, sf_dir, 16), WIDTH, HEIGHT, FLOOD_RADIUS, 24.0, loops=6, scale_by_loops=True, step=1)


def flood_jump(spark, sf_dir):
    grey = _grey(spark, sf_dir)
    return flood.apply_links(flood.initial(grey, WIDTH), flood.jump(flood.parents(grey, WIDTH, FLOOD_RADIUS, FLOOD_RANGE, HEIGHT)))


def cc_edges(spark, sf_dir):
    return neighbours.adjacency(_events(spark, sf_dir), WIDTH)


def colour_matches(spark, sf_dir):
    edges = neighbours.adjacency(_grey(spark, sf_dir), WIDTH)
    return edges.groupBy("image_id").agg(F.sum(same_colour([F.col("d")], [F.lit(0)]).cast("int")).alias("matches"), F.count("*").alias("edges"))


def _exact(spark, sf_dir):
    return components.label_equal(_grey(spark, sf_dir), WIDTH, HEIGHT)


def _range(spark, sf_dir):
    return components.label_range(_grey(spark, sf_dir, 32), WIDTH, HEIGHT, 4.0)


def cc_exact(spark, sf_dir):
    return _exact(spark, sf_dir)


def cc_range(spark, sf_dir):
    return _range(spark, sf_dir)


def cc_seeded(spark, sf_dir):
    grey = _grey(spark, sf_dir)
    return components.label_range(grey, WIDTH, HEIGHT, 1.0, flood.flood(grey, WIDTH, HEIGHT, FLOOD_RADIUS, FLOOD_RANGE, step=1))


def cc_seeded_tiled(spark, sf_dir):
    """The same components as cc_seeded, in tiles."""
    grey = _grey(spark, sf_dir)
    return components.label_range(grey, WIDTH, HEIGHT, 1.0, flood.flood(grey, WIDTH, HEIGHT, FLOOD_RADIUS, FLOOD_RANGE, step=1), tile=16)


def cc_tiled(spark, sf_dir):
    """The same components as cc_exact, solved in 8-by-8 tiles and joined across their edges."""
    return components.label_equal(_grey(spark, sf_dir), WIDTH, HEIGHT, tile=8)


def region_count(spark, sf_dir):
    return components.region_counts(_exact(spark, sf_dir))


def region_sizes(spark, sf_dir):
    return components.region_sizes(_exact(spark, sf_dir))


def region_table(spark, sf_dir):
    return _rounded(regions.region_table(_events(spark, sf_dir), _exact(spark, sf_dir), WIDTH), "m0", "m1", "m2")


def region_adjacency(spark, sf_dir):
    return regions.region_adjacency(_grey(spark, sf_dir), _exact(spark, sf_dir), WIDTH)


def region_neighbours(spark, sf_dir):
    found = regions.neighbour_sets(regions.region_adjacency(_grey(spark, sf_dir), _exact(spark, sf_dir), WIDTH))
    own = F.concat_ws(",", F.transform(regions.merged_sets("neighbours", F.array("label")), lambda x: x.cast("string")))
    return found.select("image_id", "label", F.size("neighbours").alias("degree"), own.alias("with_itself"))


def region_merge_round(spark, sf_dir):
    grey = _grey(spark, sf_dir, 1)
    return regions.merge_round(grey, regions.one_per_pixel(grey, WIDTH), WIDTH, HEIGHT)


def region_merge(spark, sf_dir):
    return regions.merge_regions(_grey(spark, sf_dir, 1), WIDTH, HEIGHT)


def dense_relabel(spark, sf_dir):
    return components.compact(flood_labels(spark, sf_dir))


def color_labels(spark, sf_dir):
    r, g, b = label_colour(F.col("label"))
    return _exact(spark, sf_dir).select("image_id", "g", "label", r.alias("red"), g.alias("green"), b.alias("blue"))


def _filtered_values(spark, sf_dir):
    pixels = _events(spark, sf_dir)
    return meanshift.mean_shift(pixels, WINDOW, BALL).join(pixels, ["image_id", "x", "y"]).select(F.round("f0", 6).alias("test"), F.col("c0").alias("ref"))


def float_diff_grades(spark, sf_dir):
    return _rounded(compare.difference_grades(_filtered_values(spark, sf_dir)), "share")


def size_check(spark, sf_dir):
    return compare.same_size(_range(spark, sf_dir), _exact(spark, sf_dir))


def _label_pairs(spark, sf_dir):
    ref = _exact(spark, sf_dir).select("image_id", "g", F.col("label").alias("ref"))
    return _range(spark, sf_dir).select("image_id", "g", F.col("label").alias("test")).join(ref, ["image_id", "g"]).drop("g")


def label_contingency(spark, sf_dir):
    return compare.contingency(_label_pairs(spark, sf_dir))


def label_overlap_grades(spark, sf_dir):
    return _rounded(compare.overlap_grades(compare.contingency(_label_pairs(spark, sf_dir))), "share")


def segment_pipeline(spark, sf_dir):
    return segment(_events(spark, sf_dir), WIDTH, HEIGHT, WINDOW, BALL, CONNECT)


def segment_seeded(spark, sf_dir):
    return segment(_events(spark, sf_dir), WIDTH, HEIGHT, WINDOW, BALL, CONNECT, seeded=True)


def segment_report(spark, sf_dir):
    return region_report(segment(_events(spark, sf_dir), WIDTH, HEIGHT, WINDOW, BALL, CONNECT))


def segment_metrics(spark, sf_dir):
    seen = run_metrics(segment(_events(spark, sf_dir), WIDTH, HEIGHT, WINDOW, BALL, CONNECT))
    return spark.createDataFrame([(seen["images"], seen["pixels"], seen["regions"])], "images long, pixels long, regions long")


def image_roundtrip(spark, sf_dir):
    """Frames as PNG files, and their pixels read back."""
    folder = new_path(spark, "png")
    materialise(images.write_images(_events(spark, sf_dir), folder), "png-files")
    return images.read_images(spark, folder)


def image_components(spark, sf_dir):
    """Components of equal colour, straight from image files."""
    folder = new_path(spark, "png")
    materialise(images.write_images(_grey(spark, sf_dir), folder), "png-files")
    return components.label_equal(images.read_images(spark, folder), WIDTH, HEIGHT)


def frame_stream(spark, sf_dir):
    return frame_regions(spark, spark.read.parquet(f"{sf_dir}/events.parquet"), rasters.event_raster, WIDTH, HEIGHT, WINDOW, BALL, CONNECT)


def bin_roundtrip(spark, sf_dir):
    rows = _events(spark, sf_dir).select("image_id", place(F.col("x"), F.col("y"), WIDTH).alias("pos"), F.col("c1").alias("value"))
    folder = new_path(spark, "bin")
    materialise(bins.write_bins(rows, folder, "int"), "bin-files")
    return bins.read_bins(spark, folder, "int")


def filtered_bins(spark, sf_dir):
    """Filtered channels as planar float files: all of channel 0, then 1, then 2."""
    area = WIDTH * HEIGHT
    smooth = filtered_pixels(_events(spark, sf_dir), WINDOW, BALL)
    g = place(F.col("x"), F.col("y"), WIDTH)
    planes = smooth.select("image_id", F.explode(F.array(*[F.struct((g + k * area).alias("pos"), F.col(f"c{k}").alias("value")) for k in range(3)])).alias("p")).select("image_id", "p.pos", "p.value")
    folder = new_path(spark, "bin")
    materialise(bins.write_bins(planes, folder, "float"), "bin-files")
    return bins.read_bins(spark, folder, "float").select("image_id", "pos", F.round(F.col("value").cast("double"), 2).alias("value"))


_ALL = (raster_scan, embedding_scan, square_scene, channel_check, luv_code, luv_roundtrip, window_gather, window_gather_stats, mean_shift_step, mean_shift_filter, mean_shift_wide, mean_shift_iterations, flood_parent, flood_device, flood_tiled, flood_labels, flood_scaled, flood_jump, cc_edges, colour_matches, cc_exact, cc_range, cc_seeded, cc_seeded_tiled, cc_tiled, region_count, region_sizes, region_table, region_adjacency, region_neighbours, region_merge_round, region_merge, dense_relabel, color_labels, float_diff_grades, size_check, label_contingency, label_overlap_grades, segment_pipeline, segment_seeded, segment_report, segment_metrics, image_roundtrip, image_components, frame_stream, bin_roundtrip, filtered_bins)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


__all__ = ["oracle_sql", "queries"]
