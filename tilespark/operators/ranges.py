"""Byte ranges: coalescing, sizes, and chunks within shards."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def coalesce_ranges(df: DataFrame, keys: Sequence[str], max_gap: int, max_size: int | None = None) -> DataFrame:
    """``df`` (keys..., offset, length, ...) with ``run``, ``run_start`` and ``run_end``.

    Ranges of one key in the order of their offsets, of equal ones the longer first, join
    while the gap between them is at most ``max_gap`` (an overlap is one too).  A cap on
    the size of a run makes runs depend on all before them; then one pass over each key's
    sorted ranges settles them, batch by batch, so a key (a file) need not fit in memory.
    """
    end = F.col("offset") + F.col("length")
    order = Window.partitionBy(*keys).orderBy("offset", F.desc("length"))
    if max_size is None:
        reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        begins = F.when(F.col("offset") - reach <= max_gap, 0).otherwise(1)
        out = df.withColumn("__b", begins).withColumn("run", F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__b")
    else:
        ranges = df.select(*keys, F.col("offset").cast("long"), F.col("length").cast("long")).distinct()
        ranges = ranges.repartition(*keys).sortWithinPartitions(*keys, "offset", F.desc("length"))

        def fold(batches):
            last, run, start, stop = None, 0, 0, 0
            for batch in batches:
                values, runs = [c.to_pylist() for c in batch.columns], []
                for *key, at, n in zip(*values):
                    if key == last and at - stop <= max_gap and max(stop, at + n) - start <= max_size:
                        stop = max(stop, at + n)
                    else:
                        run = run + 1 if key == last else 0
                        last, start, stop = key, at, at + n
                    runs.append(run)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64())], names=[*batch.schema.names, "run"])

        schema = T.StructType([*ranges.schema.fields, T.StructField("run", T.LongType())])
        out = df.join(ranges.mapInArrow(fold, schema), [*keys, "offset", "length"])
    whole = Window.partitionBy(*keys, "run")
    return out.withColumn("run_start", F.min("offset").over(whole)).withColumn("run_end", F.max(end).over(whole))


def shard_of(chunk: Sequence[Column], chunks_per_shard: Sequence[int]) -> tuple[list[Column], Column]:
    """A chunk's shard, and its number within it, row by row."""
    shard = [F.floor(c / n).cast("int") for c, n in zip(chunk, chunks_per_shard)]
    inner: Column = F.lit(0)
    for c, n in zip(chunk, chunks_per_shard):
        inner = inner * n + F.pmod(c, F.lit(n))
    return shard, inner.cast("int")
