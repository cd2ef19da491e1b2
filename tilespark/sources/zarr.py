"""Zarr arrays, versions 2 and 3, with shards: chunks as rows, and a writer."""

from __future__ import annotations

import itertools
import json
import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, InputPartition

from tilespark.functions.arraycodecs import byteshuffle_decode, byteshuffle_encode, delta_decode, delta_encode
from tilespark.functions.bytecodecs import DECODE, ENCODE
from tilespark.functions.checksums import crc32c
from tilespark.functions.registry import BackendUnavailable
from tilespark.sources import storage
from tilespark.sources.tiff import Pruning

# Codec names of Zarr and numcodecs, and those of the codecs here.
_NAMES = {"zstd": "zstd", "gzip": "gzip", "zlib": "deflate", "lz4": "lz4", "bz2": "bz2", "lzma": "lzma", "brotli": "brotli"}
_ABSENT = 2**64 - 1


def _checked(data: bytes) -> bytes:
    """What stands before its checksum."""
    if len(data) < 4 or struct.unpack("<I", data[-4:])[0] != crc32c(data[:-4]):
        raise ValueError("wrong checksum")
    return data[:-4]


def _summed(data: bytes) -> bytes:
    return data + struct.pack("<I", crc32c(data))


@dataclass
class Array:
    """An array of either version; ``codecs`` and ``filters`` hold (name, configuration)."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    fill: float
    codecs: list[tuple[str, dict]]
    separator: str = "."
    prefix: str = ""
    inner: tuple[int, ...] | None = None
    inner_codecs: tuple[tuple[str, dict], ...] = ()
    order: str = "C"
    filters: tuple[tuple[str, dict], ...] = ()
    index_checked: bool = True
    index_first: bool = False

    def key(self, index: tuple[int, ...]) -> str:
        return self.prefix + self.separator.join(map(str, index))

    def grid(self):
        return itertools.product(*(range(-(-s // c)) for s, c in zip(self.shape, self.chunks)))

    def _array(self, data: bytes, codecs, shape) -> np.ndarray:
        axes = list(range(len(shape)))
        for name, config in codecs:
            if name == "transpose":
                axes = [axes[k] for k in config["order"]]
        for name, _ in reversed(codecs):
            if name == "crc32c":
                data = _checked(data)
            elif name in _NAMES:
                data = DECODE[_NAMES[name]](data)
            elif name != "transpose":
                raise BackendUnavailable(f"{name}: no backend installed")
        for name, config in reversed(self.filters):
            if name == "delta":
                kind = np.dtype(config["dtype"])
                data = delta_decode(np.frombuffer(data, np.dtype(config.get("astype", kind))).astype(kind)).tobytes()
            elif name == "shuffle":
                data = byteshuffle_decode(data, config.get("elementsize", 4))
            else:
                raise BackendUnavailable(f"filter {name}: not known")
        flat = np.frombuffer(data, self.dtype)
        if self.order == "F":
            return flat.reshape(shape[::-1]).transpose()
        return flat.reshape([shape[k] for k in axes]).transpose(np.argsort(axes))

    def pieces(self, index: tuple[int, ...], box: tuple[slice, ...]):
        """(place within the chunk, pixels) of what is stored of a box of a chunk.  Of a shard
        its index is read, and the inner chunks that the box meets."""
        try:
            source = storage.open_source(f"{self.path}/{self.key(index)}")
            stored = source.size()
        except FileNotFoundError:
            return
        if self.inner is None:
            yield tuple(slice(0, c) for c in self.chunks), self._array(source.read_at(0, stored), self.codecs, self.chunks)
            return
        per = [c // i for c, i in zip(self.chunks, self.inner)]
        size = 16 * int(np.prod(per)) + 4 * self.index_checked
        table = source.read_at(0 if self.index_first else stored - size, size)
        table = np.frombuffer(_checked(table) if self.index_checked else table, "<u8").reshape(*per, 2)
        wanted = [w for w in itertools.product(*(range(b.start // i, -(-b.stop // i)) for b, i in zip(box, self.inner))) if table[w][0] != _ABSENT]
        data = source.read_many([(int(table[w][0]), int(table[w][1])) for w in wanted])
        for w, part in zip(wanted, data):
            yield tuple(slice(k * i, (k + 1) * i) for k, i in zip(w, self.inner)), self._array(part, self.inner_codecs, self.inner)

    def chunk(self, index: tuple[int, ...]) -> np.ndarray | None:
        """A whole chunk (a shard counts as one), or None if it is not stored."""
        out = None
        for place, part in self.pieces(index, tuple(slice(0, c) for c in self.chunks)):
            if out is None:
                out = np.full(self.chunks, self.fill, self.dtype)
            out[place] = part
        if out is None and self.inner is not None and storage.exists(f"{self.path}/{self.key(index)}"):
            return np.full(self.chunks, self.fill, self.dtype)
        return out

    def read(self, *region) -> np.ndarray:
        """A region by slices of step 1; missing chunks hold the fill value."""
        box = [(region[k] if k < len(region) and region[k] is not None else slice(None)).indices(s) for k, s in enumerate(self.shape)]
        if any(step != 1 for _, _, step in box):
            raise ValueError("steps other than 1")
        out = np.full([max(0, b - a) for a, b, _ in box], self.fill, self.dtype)
        if not out.size:
            return out
        for index in itertools.product(*(range(a // c, (b - 1) // c + 1) for (a, b, _), c in zip(box, self.chunks))):
            base = [i * c for i, c in zip(index, self.chunks)]
            inside = tuple(slice(max(a - o, 0), min(b - o, c)) for (a, b, _), o, c in zip(box, base, self.chunks))
            for place, part in self.pieces(index, inside):
                lo = [max(i.start, p.start) for i, p in zip(inside, place)]
                hi = [min(i.stop, p.stop) for i, p in zip(inside, place)]
                to = tuple(slice(x + o - a, y + o - a) for x, y, o, (a, _, _) in zip(lo, hi, base, box))
                out[to] = part[tuple(slice(x - p.start, y - p.start) for x, y, p in zip(lo, hi, place))]
        return out


def _chain(codecs: list[dict]) -> list[tuple[str, dict]]:
    return [(c["name"], c.get("configuration", {})) for c in codecs if c["name"] not in ("bytes", "sharding_indexed")]


def _fill(value, dtype: np.dtype):
    """Numbers, and the strings that stand for some of them."""
    if value is None:
        return 0
    return float(value.replace("Infinity", "inf")) if isinstance(value, str) and dtype.kind == "f" else value


def open_array(path: str) -> Array:
    """An array of version 3 or 2 in a local folder, a store that Arrow opens, or on a server."""
    path = path.rstrip("/")
    if storage.exists(f"{path}/zarr.json"):
        meta = json.loads(storage.read_all(f"{path}/zarr.json"))
        encoding = meta.get("chunk_key_encoding", {"name": "default"})
        separator = encoding.get("configuration", {}).get("separator", "/" if encoding["name"] == "default" else ".")
        codecs = meta["codecs"]
        shard = next((c["configuration"] for c in codecs if c["name"] == "sharding_indexed"), None)
        order = "<"
        for c in (shard or {}).get("codecs", []) + codecs:
            if c["name"] == "bytes" and c.get("configuration", {}).get("endian") == "big":
                order = ">"
        dtype = np.dtype(meta["data_type"]).newbyteorder(order)
        index = [c["name"] for c in (shard or {}).get("index_codecs", [])]
        if set(index) - {"bytes", "crc32c"}:
            raise BackendUnavailable(f"index of a shard in {index}")
        return Array(
            path,
            tuple(meta["shape"]),
            tuple(meta["chunk_grid"]["configuration"]["chunk_shape"]),
            dtype,
            _fill(meta.get("fill_value"), dtype),
            _chain(codecs),
            separator,
            "c" + separator if encoding["name"] == "default" else "",
            tuple(shard["chunk_shape"]) if shard else None,
            tuple(_chain(shard["codecs"])) if shard else (),
            index_checked="crc32c" in index,
            index_first=(shard or {}).get("index_location", "end") == "start",
        )
    meta = json.loads(storage.read_all(f"{path}/.zarray"))
    codec, dtype = meta.get("compressor"), np.dtype(meta["dtype"])
    filters = tuple((f["id"], f) for f in meta.get("filters") or ())
    return Array(path, tuple(meta["shape"]), tuple(meta["chunks"]), dtype, _fill(meta.get("fill_value"), dtype), [(codec["id"], codec)] if codec else [], meta.get("dimension_separator", "."), order=meta.get("order", "C"), filters=filters)


def write_array(path: str, x: np.ndarray, chunks: tuple[int, ...], *, version: int = 3, codec: str | None = "zstd", inner: tuple[int, ...] | None = None, fill: float = 0, order: str = "C", filters: tuple[dict, ...] = (), checksum: bool = False) -> None:
    """Writes an array; chunks that hold only the fill value are not stored.  ``order`` and
    ``filters`` (delta, shuffle) are those of version 2, ``checksum`` that of version 3."""
    os.makedirs(path, exist_ok=True)
    coder = (lambda b: ENCODE[_NAMES[codec]](b, None)) if codec else bytes

    def packed(part: np.ndarray) -> bytes:
        data = (part.transpose() if order == "F" else part).tobytes()
        for f in filters:
            if f["id"] == "delta":
                data = delta_encode(np.frombuffer(data, f["dtype"])).tobytes()
            elif f["id"] == "shuffle":
                data = byteshuffle_encode(data, f.get("elementsize", 4))
            else:
                raise BackendUnavailable(f"filter {f['id']}: not known")
        data = coder(data)
        return _summed(data) if checksum else data

    if version == 2:
        meta = {"zarr_format": 2, "shape": x.shape, "chunks": chunks, "dtype": x.dtype.str, "compressor": {"id": codec} if codec else None, "fill_value": fill, "order": order, "filters": list(filters) or None}
        name = ".zarray"
    else:
        if order != "C" or filters:
            raise ValueError("order and filters are those of version 2")
        chain = [{"name": "bytes", "configuration": {"endian": "little"}}, *([{"name": codec}] if codec else []), *([{"name": "crc32c"}] if checksum else [])]
        if inner:
            chain = [{"name": "sharding_indexed", "configuration": {"chunk_shape": inner, "codecs": chain, "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}]}}]
        meta = {"zarr_format": 3, "node_type": "array", "shape": x.shape, "data_type": x.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": chain}
        name = "zarr.json"
    with open(f"{path}/{name}", "w") as f:
        json.dump(meta, f)
    array = open_array(path)
    for index in array.grid():
        part = np.full(chunks, fill, x.dtype)
        own = x[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks))]
        part[tuple(map(slice, own.shape))] = own
        if (part == fill).all():
            continue
        if inner and version == 3:
            body, table, at = [], [], 0
            for where in itertools.product(*(range(c // i) for c, i in zip(chunks, inner))):
                piece = part[tuple(slice(w * i, (w + 1) * i) for w, i in zip(where, inner))]
                if (piece == fill).all():
                    table += [_ABSENT] * 2
                    continue
                body.append(packed(piece))
                table += [at, len(body[-1])]
                at += len(body[-1])
            data = b"".join(body) + _summed(struct.pack(f"<{len(table)}Q", *table))
        else:
            data = packed(part)
        target = os.path.join(path, *array.key(index).split("/"))
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            f.write(data)


def write_pyramid(path: str, levels: list[np.ndarray], chunks: tuple[int, ...], axes: str = "yx", **options) -> None:
    """An OME-Zarr group of levels, full resolution first."""
    os.makedirs(path, exist_ok=True)
    for k, x in enumerate(levels):
        write_array(f"{path}/{k}", x, chunks, version=2, **options)
    scale = [{"path": str(k), "coordinateTransformations": [{"type": "scale", "scale": [max(1, round(a / b)) for a, b in zip(levels[0].shape, x.shape)]}]} for k, x in enumerate(levels)]
    with open(f"{path}/.zattrs", "w") as f:
        json.dump({"multiscales": [{"version": "0.4", "axes": [{"name": a} for a in axes], "datasets": scale}]}, f)
    with open(f"{path}/.zgroup", "w") as f:
        json.dump({"zarr_format": 2}, f)


def multiscales(path: str) -> list[dict] | None:
    """The datasets of a group's first pyramid, full resolution first; None without one."""
    if storage.exists(f"{path}/.zattrs"):
        meta = json.loads(storage.read_all(f"{path}/.zattrs"))
    elif storage.exists(f"{path}/zarr.json"):
        attributes = json.loads(storage.read_all(f"{path}/zarr.json")).get("attributes", {})
        meta = attributes.get("ome", attributes)
    else:
        return None
    return meta["multiscales"][0]["datasets"] if meta.get("multiscales") else None


def open_pyramid(path: str) -> list[Array]:
    sets = multiscales(path.rstrip("/"))
    if sets is None:
        raise ValueError(f"{path} is no pyramid")
    return [open_array(f"{path.rstrip('/')}/{d['path']}") for d in sets]


def level_downscale(shapes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """How many times smaller each level is than the first, at least 1; halves go to the even
    number."""
    return [tuple(max(1, round(a / b)) for a, b in zip(shapes[0], shape)) for shape in shapes]


@dataclass
class Chunks(InputPartition):
    path: str
    level: int
    which: list[tuple[int, ...]]


class ZarrReader(Pruning):
    columns = ("level", "c0", "c1", "c2", "c3", "c4")

    def _levels(self):
        path = self.options["path"]
        return [open_array(path)] if multiscales(path.rstrip("/")) is None else open_pyramid(path)

    def partitions(self):
        size, out = int(self.options.get("chunksPerPartition", 16)), []
        for k, array in enumerate(self._levels()):
            own = [i for i in array.grid() if self.keep({"level": k, **{f"c{j}": (i[j] if j < len(i) else 0) for j in range(5)}})]
            out += [Chunks(array.path, k, own[a : a + size]) for a in range(0, len(own), size)]
        return out or [Chunks("", 0, [])]

    def read(self, part):
        if not part.which:
            return
        array = open_array(part.path)
        kind, little = array.dtype.str[1:], array.dtype.newbyteorder("<")
        for i in part.which:
            x = array.chunk(i)
            data = np.full(array.chunks, array.fill, array.dtype) if x is None else x
            row = {"level": part.level, **{f"c{j}": (i[j] if j < len(i) else 0) for j in range(5)}, "shape": list(array.chunks), "dtype": kind, "stored": x is not None, "payload": data.astype(little).tobytes()}
            yield pa.RecordBatch.from_pylist([row], ZARR_ARROW)


ZARR_ARROW = pa.schema([("level", pa.int32()), *((f"c{j}", pa.int32()) for j in range(5)), ("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("stored", pa.bool_()), ("payload", pa.binary())])


class ZarrSource(DataSource):
    """``spark.read.format("zarr").load(path)``: one row per chunk of an array or of all
    levels of an OME-Zarr group; chunks that are not stored hold the fill value."""

    @classmethod
    def name(cls):
        return "zarr"

    def schema(self):
        return "level int, c0 int, c1 int, c2 int, c3 int, c4 int, shape array<int>, dtype string, stored boolean, payload binary"

    def reader(self, schema):
        return ZarrReader(self.options)
