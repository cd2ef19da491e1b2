"""What several operators share: the folder for intermediate tables, joins whose
broadcast side is measured first, and connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join with no more rows than this may be broadcast (rows of a few
#: integers: some tens of MB in an executor).  Beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch on its way back from Python.  The executor holds a batch outside its
#: heap in one piece, and what large pieces leave behind there does not go back to the system.
BATCH_BYTES = 1 << 20


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of ``taken`` has."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def settled(value: Column) -> Column:
    """The same value.  A filter on what depends on it stays behind it, as a test of random
    numbers can not be moved; else Spark writes the value out again wherever the filter uses it.
    (One random number against a constant would be optimised away.)"""
    return F.when(F.rand(0) + F.rand(1) > -1, value)


def let_go() -> None:
    """Gives freed memory of a Python worker back; workers outlive the stage they began in."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def parted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``BATCH_BYTES`` (one row at least)."""
    rows = max(1, batch.num_rows * BATCH_BYTES // max(BATCH_BYTES, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function whose batches are small, and that gives its memory back when its
    task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            for batch in run(batches):
                yield from parted(batch)
        finally:
            let_go()

    return wrapped


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Only where it is unset and Spark runs on
    one machine (tests) a temporary folder is taken and set; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tilespark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lineage is cut there and a lost
    executor costs no recomputation.  What is left of them goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        if self.n == 1:
            root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more, and lets shuffle files of finished
        jobs go: Spark removes them when the driver collects what refers to them."""
        for df in tables:
            if entry := self.paths.pop(id(df), None):
                self._delete(entry[1])
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        """Deletes all tables."""
        self.paths.clear()
        self._delete(self.root)


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``limit`` rows."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def components(scratch: Scratch, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of ``edges``; the component is the smallest node
    that can be reached.

    Min-label propagation with pointer jumping, so the rounds grow with the logarithm
    of the diameter.  Labels travel along edges by join and are combined by a partial
    ``min`` before each shuffle; a hub's edges are split by adaptive skew handling.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = scratch.table(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = scratch.table(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.u, "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        step = scratch.table(step)
        jump = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = step.join(jump, step.label == jump.n2, "left").select("node", "was", F.least("label", F.coalesce("l2", "label")).alias("label"))
        new = scratch.table(new)
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
