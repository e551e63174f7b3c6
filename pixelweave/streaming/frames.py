"""Frame streams: frames are independent, so each is segmented once it is complete.

A micro-batch may hold parts of frames. Those wait in a table beside the sink,
which the next batch reads; what never completes is segmented when the stream ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.segment import region_report, segment
from ..plans.workspace import materialise, new_path


def frame_source(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Frame rows from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class FrameStream:
    """Segments the frames of a stream into ``sink``, a folder for each batch, replaced if a batch is retried."""

    def __init__(self, raster: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, width: int, height: int, radius: int, colour_range: float, connect_range: float):
        self.raster, self.sink, self.checkpoint, self.area = raster, sink, checkpoint, width * height
        self.how = (width, height, radius, colour_range, connect_range)
        self.last = -1

    def _waiting(self, number: int) -> str:
        return f"{self.sink}-waiting/batch={number}"

    def _segment(self, pixels: DataFrame, name: str) -> None:
        segment(pixels, *self.how, seeded=True).write.mode("overwrite").parquet(f"{self.sink}/batch={name}")

    def batch(self, rows: DataFrame, number: int) -> None:
        pixels = self.raster(rows)
        if number:
            pixels = pixels.unionByName(rows.sparkSession.read.schema(pixels.schema).parquet(self._waiting(number - 1)))
        pixels = materialise(pixels, "frames")
        complete = pixels.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") >= self.area).select("image_id")
        pixels.join(complete, "image_id", "left_anti").write.mode("overwrite").parquet(self._waiting(number))
        self._segment(pixels.join(complete, "image_id", "left_semi"), str(number))
        self.last = number

    def run(self, frames: DataFrame) -> None:
        """Works through what the source holds now, and ends."""
        query = frames.writeStream.foreachBatch(self.batch).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if self.last >= 0:
            rest = frames.sparkSession.read.parquet(self._waiting(self.last))
            if not rest.isEmpty():
                self._segment(rest, str(self.last + 1))


def frame_regions(spark: SparkSession, table: DataFrame, raster: Callable[[DataFrame], DataFrame], width: int, height: int, radius: int, colour_range: float, connect_range: float, files: int = 4, files_per_batch: int = 2) -> DataFrame:
    """Streams a stored table through ``FrameStream`` in several batches; (image_id, pixels, regions)."""
    base = new_path(spark, "stream")
    table.repartition(files).write.parquet(f"{base}/frames")
    stream = FrameStream(raster, f"{base}/out", f"{base}/checkpoint", width, height, radius, colour_range, connect_range)
    stream.run(frame_source(spark, f"{base}/frames", table.schema, files_per_batch))
    return region_report(spark.read.parquet(f"{base}/out").drop("batch"))
