"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()

#: Rows and bytes of an Arrow batch on its way to Python.  Spark's own 10,000 rows are tens of
#: MB of text, which the executor holds outside its heap, twice while a buffer grows.  Beyond
#: the 4 MB of the allocator's chunks a buffer is a piece of its own, so a batch stays well below.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "1m"}


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application, unless the workers'
    ``PYTHONPATH`` has it already.  Arrow batches stay small unless the session names a size."""
    for name, size in ARROW_BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, size)
    if _ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tilespark"), "zip", _ROOT, "tilespark")
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` for files that tasks write and read by path;
    it goes when the driver ends.  Only on one machine may that setting be missing."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tilespark-")
    path = f"{root.removeprefix('file://').removeprefix('file:').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
