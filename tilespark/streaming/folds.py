"""Folds that keep up with a growing acquisition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.operators.frames import project


def frame_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Frames as they arrive, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_projection(stream: DataFrame, keys, how: str = "max") -> DataFrame:
    """Pixel-wise fold of all frames so far; the state is one value per pixel."""
    return project(stream, keys, how)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over what is there and returns its result table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def windowed_counts(events: DataFrame, time: str, keys, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums in tumbling windows (an extension: the array model has no event time)."""
    src = events.withWatermark(time, late) if late else events
    return src.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, keys, gap: str, late: str | None = None) -> DataFrame:
    """Counts in sessions (an extension)."""
    src = events.withWatermark(time, late) if late else events
    return src.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
