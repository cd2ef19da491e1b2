"""Containers whose files are read whole by Spark's ``binaryFile``: FITS, NDTiff indexes and
still images.  They work on any store that Spark reads."""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import images
from tilespark.functions.arraycodecs import rgbe_file_decode
from tilespark.sources.tiff import write_tiff

_BITPIX = {8: "u1", 16: "i2", 32: "i4", 64: "i8", -32: "f4", -64: "f8"}


def _cards(data: bytes, at: int) -> tuple[dict, int]:
    head: dict = {}
    while True:
        block = data[at : at + 2880]
        if len(block) < 2880:
            raise ValueError("truncated FITS header")
        at += 2880
        for k in range(0, 2880, 80):
            card = block[k : k + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return head, at
            if card[8:10] == "= ":
                value = card[10:].strip()
                if value.startswith("'"):
                    head[key] = value[1:].split("'")[0].rstrip()
                    continue
                value = value.split("/")[0].strip()
                try:
                    head[key] = {"T": True, "F": False}[value] if value in ("T", "F") else int(value) if value.lstrip("+-").isdigit() else float(value.replace("D", "E"))
                except ValueError:
                    head[key] = value


def fits_hdus(data: bytes):
    """(header, pixels or None) of each unit.  A zero of half the range with scale 1 means
    unsigned integers; any other scaling gives doubles."""
    at = 0
    while at < len(data):
        head, at = _cards(data, at)
        shape = tuple(head[f"NAXIS{k}"] for k in range(head.get("NAXIS", 0), 0, -1))
        dtype = np.dtype(_BITPIX[head["BITPIX"]])
        count = int(np.prod(shape)) if shape else 0
        size = (count * head.get("GCOUNT", 1) + head.get("PCOUNT", 0)) * dtype.itemsize
        x = None
        if count and head.get("XTENSION", "IMAGE") == "IMAGE":
            x = np.frombuffer(data, dtype.newbyteorder(">"), count, at).reshape(shape).astype(dtype)
            scale, zero = head.get("BSCALE", 1), head.get("BZERO", 0)
            if scale == 1 and dtype.kind == "i" and zero == 2 ** (8 * dtype.itemsize - 1):
                x = (x.view(f"u{dtype.itemsize}") ^ np.array(zero, f"u{dtype.itemsize}")).astype(f"u{dtype.itemsize}")
            elif scale == 1 and dtype == np.uint8 and zero == -128:
                x = (x ^ np.uint8(128)).view(np.int8)
            elif scale != 1 or zero != 0:
                x = x * float(scale) + float(zero)
        yield head, x
        at += -(-size // 2880) * 2880


def fits_encode(arrays: list[np.ndarray]) -> bytes:
    out = []
    for k, x in enumerate(arrays):
        zero = 0
        if x.dtype.kind == "u" and x.dtype.itemsize > 1:
            zero = 2 ** (8 * x.dtype.itemsize - 1)
            x = (x ^ x.dtype.type(zero)).view(f"i{x.dtype.itemsize}")
        elif x.dtype == np.int8:
            x, zero = x.view(np.uint8) ^ np.uint8(128), -128
        bitpix = next(b for b, d in _BITPIX.items() if np.dtype(d) == x.dtype)
        cards = [("SIMPLE", "T") if not k else ("XTENSION", "'IMAGE   '"), ("BITPIX", bitpix), ("NAXIS", x.ndim), *((f"NAXIS{i + 1}", n) for i, n in enumerate(x.shape[::-1]))]
        cards += [("PCOUNT", 0), ("GCOUNT", 1)] if k else []
        cards += [("BZERO", zero), ("BSCALE", 1)] if zero else []
        text = "".join(f"{a:<8}= {b!s:>20}".ljust(80) for a, b in cards) + "END".ljust(80)
        body = x.astype(x.dtype.newbyteorder(">")).tobytes()
        out += [text.ljust(-(-len(text) // 2880) * 2880).encode(), body.ljust(-(-len(body) // 2880) * 2880, b"\0")]
    return b"".join(out)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parse(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """Applies ``rows(path, content)`` to each file; a file's rows go out as they come."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = list(rows(p, content.as_py()))
                if found:
                    yield pa.RecordBatch.from_pylist(found)

    return _files(spark, path).mapInArrow(run, schema)


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """(path, hdu, shape, dtype, payload) of the image units of FITS files."""

    def rows(p, data):
        for k, (_, x) in enumerate(fits_hdus(data)):
            if x is not None:
                yield {"path": p, "hdu": k, "shape": list(x.shape), "dtype": x.dtype.str[1:], "payload": x.tobytes()}

    return _parse(spark, path, "path string, hdu long, shape array<long>, dtype string, payload binary", rows)


def ndtiff_index(data: bytes):
    """Entries of an NDTiff index; a negative length ends it."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<i", data, at)
        if n < 0:
            break
        axes = json.loads(data[at + 4 : at + 4 + n])
        at += 4 + n
        (n,) = struct.unpack_from("<i", data, at)
        name = data[at + 4 : at + 4 + n].decode()
        at += 4 + n
        numbers = struct.unpack_from("<8I", data, at)
        at += 32
        yield axes, name, numbers


def ndtiff_encode(entries) -> bytes:
    out = []
    for axes, name, numbers in entries:
        a, b = json.dumps(axes).encode(), name.encode()
        out.append(struct.pack("<i", len(a)) + a + struct.pack("<i", len(b)) + b + struct.pack("<8I", *numbers))
    return b"".join(out)


def read_ndtiff_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, axes, filename, pixel_offset, width, height, pixel_type, pixel_compression,
    metadata_offset, metadata_length, metadata_compression)."""
    names = ("pixel_offset", "width", "height", "pixel_type", "pixel_compression", "metadata_offset", "metadata_length", "metadata_compression")

    def rows(p, data):
        for k, (axes, name, numbers) in enumerate(ndtiff_index(data)):
            yield {"path": p, "ordinal": k, "axes": json.dumps(axes, sort_keys=True), "filename": name, **dict(zip(names, numbers))}

    out = _parse(spark, path, "path string, ordinal long, axes string, filename string, " + ", ".join(f"{n} long" for n in names), rows)
    return out.withColumn("axes", F.from_json("axes", "map<string,string>"))


_IMAGES = {"png": images.png_decode, "bmp": images.bmp_decode, "qoi": images.qoi_decode, "hdr": rgbe_file_decode}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, height, width, channels, dtype, payload) of PNG, BMP, QOI, GIF and
    Radiance files, recognised by their first bytes."""

    def rows(p, data):
        if data[:3] == b"GIF":
            found = images.gif_frames(data)[0]
        else:
            kind = {b"\x89P": "png", b"BM": "bmp", b"qo": "qoi", b"#?": "hdr"}.get(data[:2])
            if kind is None:
                raise ValueError(f"{p}: unknown image")
            found = [_IMAGES[kind](data)]
        for k, x in enumerate(found):
            yield {"path": p, "frame": k, "height": x.shape[0], "width": x.shape[1], "channels": 1 if x.ndim == 2 else x.shape[2], "dtype": x.dtype.str[1:], "payload": x.tobytes()}

    return _parse(spark, path, "path string, frame long, height long, width long, channels long, dtype string, payload binary", rows)


def write_frames(df: DataFrame, folder: str, compression: int = 50000) -> list[str]:
    """Writes rows (frame, height, width, dtype, payload) as one TIFF each into a local or
    mounted folder, on the executors; returns nothing but the files' names."""

    def run(batches):
        for batch in batches:
            names = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["payload"], r["dtype"]).reshape(r["height"], r["width"])
                name = f"{folder}/frame-{r['frame']:08d}.tif"
                write_tiff(name, [x], compression=compression)
                names.append(name)
            yield pa.RecordBatch.from_pydict({"name": names})

    return sorted(r.name for r in df.select("frame", "height", "width", "dtype", "payload").mapInArrow(run, "name string").collect())


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("tiff")`` and ``format("zarr")`` known."""
    from tilespark.sources.tiff import TiffSource
    from tilespark.sources.zarr import ZarrSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    spark.dataSource.register(ZarrSource)


