"""CZI (ZISRAW) sub-blocks and electron-event (EER) frames, from files that Spark reads whole."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.arraycodecs import byteshuffle_decode, byteshuffle_encode, eer_events
from tilespark.functions.bytecodecs import zstd_decode, zstd_encode
from tilespark.functions.registry import BackendUnavailable
from tilespark.sources.containers import _parse
from tilespark.sources.tiff import read_pages

# Pixel types (type, samples).
PIXELS = {0: ("u1", 1), 1: ("u2", 1), 2: ("f4", 1), 3: ("u1", 3), 4: ("u2", 3), 8: ("f4", 3), 9: ("u1", 4), 12: ("i4", 1)}


def _entry(data: bytes, at: int) -> tuple[dict, int]:
    schema, kind, place, _, compression, pyramid, _, n = struct.unpack_from("<2siqiiB5si", data, at)
    if schema != b"DV":
        raise ValueError("unknown directory entry")
    dims = {}
    for k in range(n):
        name, start, size, _, stored = struct.unpack_from("<4siifi", data, at + 32 + 20 * k)
        dims[name.rstrip(b"\0").decode()] = (start, size, stored or size)
    return {"pixel_type": kind, "place": place, "compression": compression, "pyramid": pyramid, "dims": dims}, at + 32 + 20 * n


def czi_entries(data: bytes) -> list[dict]:
    """The sub-block directory."""
    if data[:10] != b"ZISRAWFILE":
        raise ValueError("not a CZI")
    (directory,) = struct.unpack_from("<q", data, 32 + 52)
    (count,) = struct.unpack_from("<i", data, directory + 32)
    at, out = directory + 32 + 128, []
    for _ in range(count):
        entry, at = _entry(data, at)
        out.append(entry)
    return out


def czi_metadata(data: bytes) -> str:
    (place,) = struct.unpack_from("<q", data, 32 + 60)
    if not place:
        return ""
    (size,) = struct.unpack_from("<i", data, place + 32)
    return data[place + 32 + 256 : place + 32 + 256 + size].decode("utf-8", "replace")


def czi_pixels(data: bytes, entry: dict) -> np.ndarray:
    """Pixels (h, w, samples) of a sub-block as stored; colours in the order red, green, blue."""
    at = entry["place"] + 32
    meta, _, size = struct.unpack_from("<iiq", data, at)
    _, end = _entry(data, at + 16)
    start = at + max(256, end - at) + meta
    raw = data[start : start + size]
    dtype, samples = PIXELS[entry["pixel_type"]]
    if entry["compression"] == 5:
        raw = zstd_decode(raw)
    elif entry["compression"] == 6:
        head = raw[0]
        shuffled = head >= 3 and raw[1] == 1 and raw[2] & 1
        raw = zstd_decode(raw[head:])
        raw = byteshuffle_decode(raw, np.dtype(dtype).itemsize) if shuffled else raw
    elif entry["compression"] != 0:
        raise BackendUnavailable(f"sub-block compression {entry['compression']}: no backend installed")
    h, w = (entry["dims"][k][2] for k in "YX")
    x = np.frombuffer(raw, f"<{dtype}", h * w * samples).reshape(h, w, samples)
    return x if samples == 1 else x[..., [2, 1, 0, 3][:samples]]


def czi_encode(blocks: list[tuple[np.ndarray, dict]], compression: int = 0, metadata: str = "<ImageDocument/>") -> bytes:
    """Blocks are pixels (h, w[, 3]) with their dimensions {name: (start, size)}; a size
    larger than the pixels makes the block a pyramid level."""

    def segment(name: bytes, body: bytes) -> bytes:
        size = -(-len(body) // 32) * 32
        return struct.pack("<16sqq", name, size, len(body)) + body.ljust(size, b"\0")

    out, at, entries = [], 32 + 512, []
    for x, dims in blocks:
        kind = next(k for k, v in PIXELS.items() if v == (x.dtype.str[1:], 1 if x.ndim == 2 else x.shape[2]))
        pixels = np.ascontiguousarray(x if x.ndim == 2 else x[..., [2, 1, 0, 3][: x.shape[2]]])
        raw = pixels.tobytes()
        if compression == 5:
            raw = zstd_encode(raw)
        elif compression == 6:
            raw = bytes((3, 1, 1)) + zstd_encode(byteshuffle_encode(raw, x.dtype.itemsize))
        stored = {"Y": x.shape[0], "X": x.shape[1]}
        level = any(dims[k][1] != stored[k] for k in stored)
        entry = struct.pack("<2siqiiB5si", b"DV", kind, at, 0, compression, 2 if level else 0, b"", len(dims))
        entry += b"".join(struct.pack("<4siifi", k.encode(), a, n, 0.0, stored.get(k, 0)) for k, (a, n) in dims.items())
        entries.append(entry)
        body = struct.pack("<iiq", 0, 0, len(raw)) + entry
        out.append(segment(b"ZISRAWSUBBLOCK", body.ljust(max(256, len(body)), b"\0") + raw))
        at += len(out[-1])
    text = metadata.encode()
    out.append(segment(b"ZISRAWMETADATA", struct.pack("<ii", len(text), 0).ljust(256, b"\0") + text))
    directory = at + len(out[-1])
    out.append(segment(b"ZISRAWDIRECTORY", struct.pack("<i", len(entries)).ljust(128, b"\0") + b"".join(entries)))
    head = struct.pack("<iiii16s16siqqiq", 1, 0, 0, 0, b"", b"", 0, directory, at, 0, 0)
    return segment(b"ZISRAWFILE", head.ljust(512, b"\0")) + b"".join(out)


def read_czi(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry, y0, x0, h, w, stored_h, stored_w, scale, samples, dtype, axes, payload) of
    all sub-blocks; ``scale`` is 1 at full resolution."""

    def rows(p, data):
        for k, e in enumerate(czi_entries(data)):
            (y0, h, sh), (x0, w, sw) = e["dims"]["Y"], e["dims"]["X"]
            x = czi_pixels(data, e)
            axes = [{"key": a, "value": s} for a, (s, _, _) in e["dims"].items() if a not in "YX"]
            yield {"path": p, "entry": k, "y0": y0, "x0": x0, "h": h, "w": w, "stored_h": sh, "stored_w": sw, "scale": h / sh, "samples": x.shape[2], "dtype": x.dtype.str[1:], "axes": axes, "payload": x.tobytes()}

    longs = ", ".join(f"{c} long" for c in ("entry", "y0", "x0", "h", "w", "stored_h", "stored_w"))
    out = _parse(spark, path, f"path string, {longs}, scale double, samples long, dtype string, axes array<struct<key:string,value:long>>, payload binary", rows)
    return out.withColumn("axes", F.map_from_entries("axes"))


def read_eer(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, y, x) of the electrons in event frames; counting them by pixel gives
    images.  Compression codes 65000 and 65001 fix the widths of codes, 65002 has them in tags."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                for n, _, page in read_pages(lambda a, n: data[a : a + n]):  # noqa: B023
                    h, w, _ = page.shape
                    widths = {65000: (8, 2), 65001: (7, 2), 65002: (page.one(65007, 7), page.one(65008, 2))}[page.one(259)]
                    raw = b"".join(data[a : a + size] for *_, a, size in page.segments())
                    ys, xs = eer_events(raw, *widths, w, h)
                    yield pa.RecordBatch.from_pydict({"path": pa.array([p] * len(ys), pa.string()), "frame": pa.array([n] * len(ys), pa.int64()), "y": pa.array(ys, pa.int64()), "x": pa.array(xs, pa.int64())})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, frame long, y long, x long")
