"""Entry points: read, write and open containers by name, suffix or first bytes."""

from __future__ import annotations

import builtins

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.registry import CODECS, BackendUnavailable, Codec, codec_for_bytes, codec_for_path, get_codec, has_codec, list_codecs, register_codec, resolve_codec
from tilespark.operators import frames, pyramid
from tilespark.sources import acquisitions, containers, czi, microscopy, storage, tiff, zarr

__all__ = ["BackendUnavailable", "Codec", "codec_for_bytes", "codec_for_path", "get_codec", "has_codec", "info", "list_codecs", "open", "open_pyramid", "read", "read_region", "reduce_files", "reduce_frames", "register_codec", "resolve_codec", "write"]

_SUFFIX = {e: c.name for c in reversed(CODECS) for e in c.extensions} | {".hdr": "hdr", ".fits": "fits", ".fit": "fits", ".index": "ndtiff", ".svs": "tiff", ".ndpi": "tiff", ".scn": "tiff", ".qptiff": "tiff", ".zarr": "zarr"}


def _format(path: str, fmt: str | None) -> str:
    if fmt:
        return get_codec(fmt).name if has_codec(fmt) else fmt.lower()
    for suffix, name in _SUFFIX.items():
        if path.rstrip("/").lower().endswith(suffix):
            return name
    raise ValueError(f"no format for {path!r}; pass format=")


def read(spark: SparkSession, path: str, *, format: str | None = None, **options) -> DataFrame:
    """Rows of a container: tiles, chunks, frames or units.  Nothing is read before an
    action, so this is ``open`` as well."""
    kind = _format(path, format)
    if kind in ("tiff", "zarr"):
        containers.register(spark)
        return spark.read.format(kind).options(**options).option("path", path).load()
    readers = {"fits": containers.read_fits, "ndtiff": containers.read_ndtiff_index, "czi": czi.read_czi, "eer": czi.read_eer, "lif": acquisitions.read_lif, "nd2": microscopy.read_nd2, "oib": microscopy.read_oib, "vsi": microscopy.read_vsi, **dict.fromkeys(("png", "bmp", "qoi", "gif", "hdr"), containers.read_images)}
    if kind in readers:
        return readers[kind](spark, path)
    raise BackendUnavailable(f"{kind}: no backend installed")


open = read


def open_pyramid(spark: SparkSession, path: str, *, format: str | None = None) -> DataFrame:
    """Tiles of all levels of a TIFF, Zarr or CZI pyramid."""
    kind = _format(path, format)
    if kind not in ("tiff", "zarr", "czi"):
        raise ValueError(f"{kind} has no pyramids")
    return read(spark, path, format=kind)


def levels(path: str, format: str | None = None) -> list[tuple[int, ...]]:
    """Shapes of the levels, full resolution first."""
    if _format(path, format) == "zarr":
        return [a.shape for a in zarr.open_pyramid(path)] if zarr.multiscales(path) else [zarr.open_array(path).shape]
    return [p.shape[:2] for p in tiff.pyramid_levels(tiff.read_pages(tiff.file_reader(path)))]


def read_region(path: str, level: int, y: tuple, x: tuple, format: str | None = None) -> np.ndarray:
    """Pixels of a box of one level; only the tiles that it meets are read."""
    if _format(path, format) == "zarr":
        array = (zarr.open_pyramid(path) if zarr.multiscales(path) else [zarr.open_array(path)])[level]
        box = pyramid.clip(*y, array.shape[-2]), pyramid.clip(*x, array.shape[-1])
        return array.read(*[slice(None)] * (len(array.shape) - 2), *(slice(*b) for b in box))
    read_at = tiff.file_reader(path)
    page = tiff.pyramid_levels(tiff.read_pages(read_at))[level]
    return tiff.read_region(read_at, page, pyramid.clip(*y, page.shape[0]), pyramid.clip(*x, page.shape[1]))


def write(path: str, x: np.ndarray, *, format: str | None = None, **options) -> None:
    """One array into a file of its format."""
    kind = _format(path, format)
    if kind == "tiff":
        tiff.write_tiff(path, [x], **options)
    elif kind == "zarr":
        zarr.write_array(path, x, options.pop("chunks", x.shape), **options)
    else:
        data = containers.fits_encode([x]) if kind == "fits" else None
        if data is None:
            codec = get_codec(kind)
            if codec.encode is None:
                raise BackendUnavailable(f"{kind}: no backend installed")
            data = codec.encode([x] if kind == "gif" else x, **options)
        with builtins.open(path, "wb") as f:
            f.write(data)


def reduce_frames(df: DataFrame, how: str = "max") -> DataFrame:
    """Element-wise fold of the frames of rows (payload, dtype) of one shape: (pos, v).
    Each frame is unpacked on its executor and folded before the shuffle."""
    fold = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}[how]
    return df.select(F.posexplode(frames.values("payload", "dtype")).alias("pos", "v")).groupBy("pos").agg(fold("v").alias("v"))


def reduce_files(spark: SparkSession, path: str, reducer, *, format: str | None = None) -> DataFrame:
    """One row (dtype, payload): all frames of files, folded by a function of two arrays."""
    return frames.fold(read(spark, path, format=format), reducer)


def info(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, level, height, width, samples, dtype, compression, tiles) of the
    directories of TIFF files, from their heads alone; files are dealt over the tasks."""
    import pyarrow as pa

    files = spark.createDataFrame([(f,) for f in storage.list_files(path)] or [], "path string")

    def run(batches):
        for batch in batches:
            for f in batch.column(0).to_pylist():
                rows = []
                for n, k, p in tiff.read_pages(tiff.file_reader(f)):
                    (h, w, c), (th, tw) = p.shape, p.tile_shape
                    rows.append({"path": f, "page": n, "level": k, "height": h, "width": w, "samples": c, "dtype": p.dtype.str[1:], "compression": p.one(tiff.COMPRESSION, 1), "tiles": -(-h // th) * -(-w // tw)})
                yield pa.RecordBatch.from_pylist(rows)

    return files.mapInArrow(run, "path string, page long, level long, height long, width long, samples long, dtype string, compression long, tiles long")
