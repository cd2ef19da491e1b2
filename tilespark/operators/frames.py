"""Folds over frames, and lookups of frames by their axes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}


def project(df: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Pixel-wise fold: (keys..., y, x, v).  Partial folds are combined before the shuffle;
    only folds that do not depend on the frames' order are offered."""
    return df.groupBy(*keys, "y", "x").agg(FOLDS[how]("v").alias("v"))


def range_sum(df: DataFrame, keys: Sequence[str], frame: str, start: int, stop: int, wrap_bits: int | None = None) -> DataFrame:
    """Sum of the frames from ``start`` to before ``stop``; ``wrap_bits`` wraps like an
    unsigned integer of that width."""
    out = df.where((F.col(frame) >= start) & (F.col(frame) < stop)).groupBy(*keys, "y", "x").agg(F.sum("v").alias("v"))
    return out if wrap_bits is None else out.withColumn("v", F.pmod("v", F.lit(1 << wrap_bits)))


def rasterise(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of events (keys..., y, x) per pixel."""
    return events.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("v"))


def read_frame(df: DataFrame, axes: dict) -> DataFrame:
    """The frames whose axes are exactly these; ``axes`` is a map column."""
    out = df.where(F.size("axes") == len(axes))
    for k, v in axes.items():
        out = out.where(F.col("axes").getItem(k) == v)
    return out


def axes_names(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.map_keys("axes")).alias("name")).distinct()


def axis_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.col("axes").getItem(name).alias("value")).where("value is not null").distinct()


def has_frames(keys: DataFrame, frames: DataFrame, on: Sequence[str]) -> DataFrame:
    return keys.join(frames, list(on), "left_semi")


def missing_frames(keys: DataFrame, frames: DataFrame, on: Sequence[str]) -> DataFrame:
    return keys.join(frames, list(on), "left_anti")


def read_many(keys: DataFrame, frames: DataFrame, on: Sequence[str], must: Sequence[str] = ()) -> DataFrame:
    """Frames in the order of ``keys.ordinal``; a key without a frame raises where one of
    the columns ``must`` would be null."""
    out = keys.join(frames, list(on), "left")
    for c in must:
        out = out.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit("no such frame"))).otherwise(F.col(c)))
    return out


def stack(df: DataFrame, keys: Sequence[str], frame: str, payload: str) -> DataFrame:
    """Payloads of a source as one array in frame order; a source of many frames belongs in
    rows instead."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(frame, payload))).alias("s"))
    return packed.select(*keys, F.transform("s", lambda x: x[payload]).alias("frames"))


def quality(df: DataFrame, keys: Sequence[str], a: str, b: str, peak: float) -> DataFrame:
    """Largest error, mean squared error and signal-to-noise ratio of two columns."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*keys).agg(F.max(F.abs(d)).alias("max_abs_error"), F.avg(d * d).alias("mse"))
    return out.withColumn("psnr", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(float(peak) ** 2) / F.col("mse"))))


def values(payload: str, dtype: str) -> Column:
    """The numbers of a payload column, as doubles."""
    from pyspark.sql.functions import arrow_udf

    def unpack(payload: pa.Array, dtype: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.frombuffer(v, t).astype(np.float64) for v, t in zip(payload.to_pylist(), dtype.to_pylist())], pa.list_(pa.float64()))

    unpack.__annotations__ = {"payload": pa.Array, "dtype": pa.Array, "return": pa.Array}
    return arrow_udf(unpack, "array<double>")(payload, dtype)


def payload_cells(df: DataFrame, width: Column, keep: Sequence[str], samples: int = 1) -> DataFrame:
    """(keep..., y, x, c, v) of rows (payload, dtype) that hold pixels row by row."""
    out = df.select(*keep, width.alias("w"), F.posexplode(values("payload", "dtype")).alias("pos", "v"))
    pixel = F.floor(F.col("pos") / samples)
    return out.select(*out.columns[:-3], F.floor(pixel / F.col("w")).cast("int").alias("y"), (pixel % F.col("w")).cast("int").alias("x"), (F.col("pos") % samples).cast("int").alias("c"), "v")


def fold(df: DataFrame, reducer, fan_in: int = 16) -> DataFrame:
    """One row (dtype, payload): the frames of ``df`` (dtype, payload) folded by any function
    of two arrays that neither order nor grouping matters to.

    Tasks fold their own frames; then ``fan_in`` results at a time are folded, so that no
    task ever meets more than that.  No frames give no row.
    """

    def run(batches):
        held = None
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(data, kind)
                held = x if held is None else reducer(held, x)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"dtype": [held.dtype.str[1:]], "payload": pa.array([held.tobytes()], pa.binary())})

    schema = "dtype string, payload binary"
    out = df.select("dtype", "payload")
    parts = out.rdd.getNumPartitions()
    out = out.mapInArrow(run, schema)
    while parts > 1:
        parts = -(-parts // fan_in)
        out = out.repartition(parts).mapInArrow(run, schema)
    return out


def frame_count(df: DataFrame, source: Sequence[str]) -> DataFrame:
    """How many frames each source has."""
    return df.groupBy(*source).agg(F.count(F.lit(1)).alias("frames"))


def iter_frames(df: DataFrame, order: str):
    """The frames of a source one after the other, a partition at a time on the driver."""
    yield from df.orderBy(order).toLocalIterator(prefetchPartitions=True)
