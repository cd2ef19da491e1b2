"""NDTiff acquisitions, LIF memory blocks and DICOMweb responses."""

from __future__ import annotations

import json
import os
import re
import struct
import urllib.request
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.arraycodecs import dicomrle_decode
from tilespark.functions.bytecodecs import DECODE, ENCODE
from tilespark.functions.registry import SEGMENT_CODES, BackendUnavailable
from tilespark.operators.filters import lead_sizes
from tilespark.sources.containers import _parse, ndtiff_encode, read_ndtiff_index
from tilespark.sources.tiff import file_reader

# NDTiff pixel types (type, samples).
NDTIFF_PIXELS = {0: ("u1", 1), 1: ("u2", 1), 2: ("u1", 3), 3: ("u2", 1), 4: ("u2", 1), 5: ("u2", 1), 6: ("u2", 1)}


#: NDTiff's marks behind the head of a file, its version, and a tag of its own.
_INDEX_MARK, _SUMMARY_MARK, _VERSION, _META_TAG = 483729, 2355492, 3, 51123


class _Stack:
    """A data file: a TIFF whose directories stand before their pixels and metadata."""

    def __init__(self, path: str, summary: bytes):
        self.file = open(path, "wb")  # noqa: SIM115
        self.file.write(struct.pack("<2sHIIIII", b"II", 42, 0, _INDEX_MARK, _VERSION, _SUMMARY_MARK, len(summary)) + summary)
        self.link = 4  # where the place of the next directory goes

    def size(self) -> int:
        return self.file.tell()

    def add(self, x: np.ndarray, raw: bytes, compression: int, meta: bytes) -> int:
        """Writes a frame; returns the place of its pixels."""
        f, samples = self.file, 1 if x.ndim == 2 else x.shape[2]
        f.write(bytes(f.tell() % 2))
        at, bits = f.tell(), 8 * x.dtype.itemsize
        f.seek(self.link)
        f.write(struct.pack("<I", at))
        f.seek(at)
        tags = 11
        extra = at + 2 + 12 * tags + 4
        pixels = extra + (2 * samples if samples > 2 else 0)
        pixels += pixels % 2
        wide = struct.pack(f"<{samples}H", *[bits] * samples) if samples <= 2 else struct.pack("<I", extra)
        entries = [
            (256, 4, 1, x.shape[1]),
            (257, 4, 1, x.shape[0]),
            (258, 3, samples, wide.ljust(4, b"\0")),
            (259, 3, 1, compression),
            (262, 3, 1, 2 if samples == 3 else 1),
            (273, 4, 1, pixels),
            (277, 3, 1, samples),
            (278, 4, 1, x.shape[0]),
            (279, 4, 1, len(raw)),
            (339, 3, 1, 1),
            (_META_TAG, 2, len(meta), pixels + len(raw) if len(meta) > 4 else meta.ljust(4, b"\0")),
        ]
        f.write(struct.pack("<H", tags))
        for tag, kind, count, value in entries:
            f.write(struct.pack("<HHI", tag, kind, count) + (value if isinstance(value, bytes) else struct.pack("<I", value)))
        self.link = f.tell()
        f.write(struct.pack("<I", 0))
        f.write(struct.pack(f"<{samples}H", *[bits] * samples) if samples > 2 else b"")
        f.write(bytes(pixels - f.tell()) + raw + meta)
        return pixels


def write_ndtiff(folder: str, frames, *, compression: int = 1, limit: int = 4_000_000_000, summary: dict | None = None) -> None:
    """Writes (axes, pixels) and their index as they come; a data file that would grow beyond
    ``limit`` is followed by another.  The index ends with a negative length."""
    os.makedirs(folder, exist_ok=True)
    number, out, head = 0, None, json.dumps(summary or {}).encode()
    with open(f"{folder}/NDTiff.index", "wb") as index:
        for axes, x in frames:
            name = SEGMENT_CODES[compression]
            raw = x.tobytes() if name == "none" else ENCODE[name](x.tobytes(), None)
            meta = json.dumps(axes).encode()
            if out is None or out.size() + len(raw) + len(meta) > limit:
                if out:
                    out.file.close()
                number += 1
                file = "NDTiffStack.tif" if number == 1 else f"NDTiffStack_{number - 1}.tif"
                out = _Stack(f"{folder}/{file}", head)
            kind = 2 if x.ndim == 3 else 1 if x.dtype.itemsize == 2 else 0
            at = out.add(x, raw, compression, meta)
            index.write(ndtiff_encode([(axes, file, (at, x.shape[1], x.shape[0], kind, 0 if name == "none" else compression, at + len(raw), len(meta), 0))]))
        index.write(struct.pack("<i", -1))
    if out:
        out.file.close()


def read_ndtiff(spark: SparkSession, folder: str) -> DataFrame:
    """The index of an acquisition with decoded pixels (``payload``, ``dtype``, ``samples``).
    A filter on the axes prunes frames before their bytes are read; each frame is one range
    read of a local or mounted file."""
    index = read_ndtiff_index(spark, f"{folder}/NDTiff.index")
    return ndtiff_frames(index, folder)


def ndtiff_frames(index: DataFrame, folder: str) -> DataFrame:
    index = lead_sizes(index, "filename", "pixel_offset", F.col("metadata_offset") + F.col("metadata_length"), "stored")
    index = index.withColumn("stored", F.least("stored", F.col("metadata_offset") - F.col("pixel_offset")))
    cols = index.select("ordinal", "axes", "filename", "pixel_offset", "width", "height", "pixel_type", "pixel_compression", "stored")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                types, samples, payload = [], [], []
                for r in rows.drop_columns(["axes"]).to_pylist():
                    raw = file_reader(f"{folder}/{r['filename']}")(r["pixel_offset"], r["stored"])
                    if r["pixel_compression"]:
                        raw = DECODE[SEGMENT_CODES[r["pixel_compression"]]](raw)
                    dtype, n = NDTIFF_PIXELS[r["pixel_type"]]
                    types.append(dtype)
                    samples.append(n)
                    payload.append(bytes(raw)[: r["width"] * r["height"] * n * np.dtype(dtype).itemsize])
                out = pa.RecordBatch.from_arrays([*rows.columns, pa.array(types), pa.array(samples, pa.int64()), pa.array(payload, pa.binary())], names=[*rows.schema.names, "dtype", "samples", "payload"])
                yield out.select(["ordinal", "axes", "width", "height", "dtype", "samples", "payload"])

    return cols.mapInArrow(run, "ordinal long, axes map<string,string>, width long, height long, dtype string, samples long, payload binary")


def ndtiff_pyramid(folder: str) -> list[tuple[int, str]]:
    """(factor, folder) of the levels of a multi-resolution acquisition, by their names."""
    out = []
    for name in sorted(os.listdir(folder)):
        if name == "Full resolution":
            out.append((1, f"{folder}/{name}"))
        elif m := re.fullmatch(r"Downsampled_x(\d+)", name):
            out.append((int(m[1]), f"{folder}/{name}"))
    return sorted(out)


def lif_parts(data: bytes) -> tuple[str, dict[str, tuple[int, int]]]:
    """The XML header, and place and size of each memory block."""

    def head(at: int) -> int:
        magic, _, test = struct.unpack_from("<IIB", data, at)
        if magic != 0x70 or test != 0x2A:
            raise ValueError("not a LIF")
        return at + 9

    at = head(0)
    (n,) = struct.unpack_from("<I", data, at)
    xml = data[at + 4 : at + 4 + 2 * n].decode("utf-16-le")
    at += 4 + 2 * n
    blocks = {}
    while at < len(data):
        at = head(at)
        size, _, n = struct.unpack_from("<QBI", data, at)
        name = data[at + 13 : at + 13 + 2 * n].decode("utf-16-le")
        at += 13 + 2 * n
        blocks[name] = (at, size)
        at += size
    return xml, blocks


def lif_encode(xml: str, blocks: dict[str, bytes]) -> bytes:
    def part(body: bytes) -> bytes:
        return struct.pack("<IIB", 0x70, len(body) + 1, 0x2A) + body

    out = [part(struct.pack("<I", len(xml)) + xml.encode("utf-16-le"))]
    for name, raw in blocks.items():
        out.append(part(struct.pack("<QBI", len(raw), 0x2A, len(name)) + name.encode("utf-16-le")) + raw)
    return b"".join(out)


def lif_images(data: bytes):
    """(name, pixels) of the images, slowest dimension first as their byte increments order
    them."""
    xml, blocks = lif_parts(data)
    for element in ElementTree.fromstring(xml).iter("Element"):
        image, memory = element.find("./Data/Image"), element.find("./Memory")
        if image is None or memory is None or memory.get("MemoryBlockID") not in blocks:
            continue
        bits = int(image.find(".//ChannelDescription").get("Resolution", "8"))
        axes = [(int(d.get("BytesInc")), int(d.get("NumberOfElements"))) for d in image.iter("DimensionDescription")]
        channels = [int(c.get("BytesInc", "0")) for c in image.iter("ChannelDescription")]
        if len(channels) > 1:
            axes.append((channels[1] - channels[0], len(channels)))
        shape = [n for _, n in sorted(axes, reverse=True)]
        at, size = blocks[memory.get("MemoryBlockID")]
        kind = "<u1" if bits <= 8 else "<u2"
        yield element.get("Name"), np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)


def read_lif(spark: SparkSession, path: str) -> DataFrame:
    """(path, image, name, shape, dtype, payload) of the images of LIF files."""

    def rows(p, data):
        for k, (name, x) in enumerate(lif_images(data)):
            yield {"path": p, "image": k, "name": name, "shape": list(x.shape), "dtype": x.dtype.str[1:], "payload": x.tobytes()}

    return _parse(spark, path, "path string, image long, name string, shape array<long>, dtype string, payload binary", rows)


def multipart(body: bytes, content_type: str) -> list[tuple[dict[str, str], bytes]]:
    """Headers and content of the parts of a multipart/related response."""
    found = re.search(r'boundary=(?:"([^"]+)"|([^;\s]+))', content_type)
    if not found:
        raise ValueError("no boundary in the content type")
    mark = b"--" + (found[1] or found[2]).encode()
    out = []
    for part in (b"\r\n" + body).split(b"\r\n" + mark)[1:]:
        if part.startswith(b"--"):
            break
        head, _, content = part.partition(b"\r\n\r\n")
        fields = (line.split(b":", 1) for line in head.split(b"\r\n") if b":" in line)
        out.append(({a.strip().decode().lower(): b.strip().decode() for a, b in fields}, content))
    if not out:
        raise ValueError("no parts")
    return out


# DICOM transfer syntaxes and the codecs of their frames; lossless JPEG
# (1.2.840.10008.1.2.4.70) has none.
TRANSFER_SYNTAXES = {
    "1.2.840.10008.1.2": "none",
    "1.2.840.10008.1.2.1": "none",
    "1.2.840.10008.1.2.4.50": "jpeg",
    "1.2.840.10008.1.2.4.51": "jpeg",
    "1.2.840.10008.1.2.4.80": "jpegls",
    "1.2.840.10008.1.2.4.81": "jpegls",
    "1.2.840.10008.1.2.4.90": "jpeg2k",
    "1.2.840.10008.1.2.4.91": "jpeg2k",
    "1.2.840.10008.1.2.4.201": "htj2k",
    "1.2.840.10008.1.2.4.202": "htj2k",
    "1.2.840.10008.1.2.4.203": "htj2k",
    "1.2.840.10008.1.2.5": "dicomrle",
}


def decode_frame(data: bytes, syntax: str, shape: tuple[int, ...], dtype) -> np.ndarray:
    """A frame of a DICOMweb response."""
    codec = TRANSFER_SYNTAXES.get(syntax)
    if codec is None:
        raise ValueError(f"unsupported transfer syntax {syntax}")
    if codec == "none":
        return np.frombuffer(data, np.dtype(dtype).newbyteorder("<"), int(np.prod(shape))).reshape(shape).astype(dtype)
    if codec == "dicomrle":
        return dicomrle_decode(data, shape, dtype)
    raise BackendUnavailable(f"{codec}: no backend installed")


class DicomwebClient:
    """Frames and instances of a DICOMweb server (WADO-RS and QIDO-RS).  ``fetch(url, accept)``
    gives (content type, body); by default it asks over HTTP."""

    def __init__(self, base: str, fetch=None):
        self.base, self.fetch = base.rstrip("/"), fetch or http_get

    def get_frame(self, study: str, series: str, instance: str, frame: int, shape: tuple[int, ...], dtype) -> np.ndarray:
        """Pixels of a frame; frames count from 1."""
        url = f"{self.base}/studies/{study}/series/{series}/instances/{instance}/frames/{frame}"
        kind, body = self.fetch(url, 'multipart/related; type="application/octet-stream"; transfer-syntax=*')
        head, data = multipart(body, kind)[0]
        found = re.search(r'transfer-syntax="?([0-9.]+)', head.get("content-type", ""))
        return decode_frame(data, found[1] if found else "1.2.840.10008.1.2.1", shape, dtype)

    def list_instances(self, study: str, series: str) -> list[str]:
        """The UIDs of a series, as the server orders them."""
        _, body = self.fetch(f"{self.base}/studies/{study}/series/{series}/instances", "application/dicom+json")
        return [x["00080018"]["Value"][0] for x in json.loads(body or b"[]")]


def http_get(url: str, accept: str) -> tuple[str, bytes]:
    request = urllib.request.Request(url, headers={"Accept": accept})
    with urllib.request.urlopen(request, timeout=60) as answer:
        return answer.headers.get("Content-Type", ""), answer.read()


def read_dicomweb(frames: DataFrame, base: str) -> DataFrame:
    """(study, series, instance, frame, payload) of rows (study, series, instance, frame,
    height, width, dtype); every task asks the server for its own rows."""

    def run(batches):
        client = DicomwebClient(base)
        for batch in batches:
            for r in batch.to_pylist():
                x = client.get_frame(r["study"], r["series"], r["instance"], r["frame"], (r["height"], r["width"]), r["dtype"])
                yield pa.RecordBatch.from_pylist([{**{k: r[k] for k in ("study", "series", "instance", "frame")}, "payload": x.tobytes()}])

    asked = frames.select("study", "series", "instance", F.col("frame").cast("long").alias("frame"), "height", "width", "dtype")
    return asked.mapInArrow(run, "study string, series string, instance string, frame long, payload binary")
