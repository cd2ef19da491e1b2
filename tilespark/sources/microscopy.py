"""ND2, OIB and VSI containers: frames as rows, read by range on the executors.

Every file is one task's: its directory is read first, then the frames one by one, so a
file need not fit in memory.  The writers make the same structures for tests and exports.
"""

from __future__ import annotations

import configparser
import re
import struct
import zlib
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilespark.functions.registry import BackendUnavailable
from tilespark.sources import storage
from tilespark.sources.tiff import tiff_arrays, tiff_bytes

FRAMES = pa.schema([("path", pa.string()), ("frame", pa.int64()), ("height", pa.int64()), ("width", pa.int64()), ("channels", pa.int64()), ("dtype", pa.string()), ("axes", pa.map_(pa.string(), pa.int64())), ("payload", pa.binary())])


def _read(spark: SparkSession, path: str, frames) -> DataFrame:
    """``frames(path)`` gives (axes, pixels); files are dealt over the tasks."""
    files = storage.list_files(path)
    if not files:
        raise FileNotFoundError(path)
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files))

    def run(batches):
        for batch in batches:
            for f in batch.column(0).to_pylist():
                for k, (axes, x) in enumerate(frames(f)):
                    row = {"path": f, "frame": k, "height": x.shape[0], "width": x.shape[1], "channels": 1 if x.ndim == 2 else x.shape[2], "dtype": x.dtype.str[1:], "axes": list(axes.items()), "payload": x.tobytes()}
                    yield pa.RecordBatch.from_pylist([row], FRAMES)

    return listed.mapInArrow(run, "path string, frame long, height long, width long, channels long, dtype string, axes map<string,long>, payload binary")


# --- ND2 ------------------------------------------------------------------------------
# The mark of a chunk, and the names of the map of chunks.
_CHUNK, _MAP, _MAP_END = b"\xda\xce\xbe\x0a", b"ND2 FILEMAP SIGNATURE NAME 0001!", b"ND2 CHUNK MAP SIGNATURE 0000001!"


def _nd2_chunk(source: storage.Source, at: int) -> tuple[int, int]:
    """Place and size of a chunk's data."""
    mark, name, size = struct.unpack("<4sIQ", source.read_at(at, 16))
    if mark != _CHUNK:
        raise ValueError("damaged ND2")
    return at + 16 + name, size


def nd2_map(source: storage.Source) -> dict[str, int]:
    """Where each chunk begins."""
    if source.read_at(0, 4) != _CHUNK:
        raise ValueError("not an ND2 of version 3")
    end, at = struct.unpack("<32sQ", source.read_at(source.size() - 40, 40))
    if end not in (_MAP, _MAP_END):
        raise ValueError("damaged ND2")
    body = source.read_at(*_nd2_chunk(source, at))
    out = {}
    for m in re.finditer(rb"(?s)([^!]*!)(.{16})", body):
        if m[1] == _MAP_END:
            break
        out[m[1].decode("latin-1")] = struct.unpack("<QQ", m[2])[0]
    return out


def nd2_attributes(source: storage.Source, chunks: dict[str, int]) -> dict[str, int]:
    """Sizes and layout of the frames."""
    root = ElementTree.fromstring(source.read_at(*_nd2_chunk(source, chunks["ImageAttributes!"])).decode())
    return {e.tag: int(e.get("value")) for e in root.iter() if re.fullmatch(r"-?\d+", e.get("value", ""))}


def nd2_frames(path):
    """(axes, pixels) of the frames, in order."""
    source = storage.open_source(path)
    chunks = nd2_map(source)
    info = nd2_attributes(source, chunks)
    bits, samples, height, width = info.get("uiBpcInMemory", 16), info.get("uiComp", 1), info["uiHeight"], info["uiWidth"]
    dtype = np.dtype("u1" if bits <= 8 else "<u2" if bits <= 16 else "<f4")
    row = info.get("uiWidthBytes") or width * samples * dtype.itemsize
    packing = info.get("eCompression", 0)
    if packing not in (0, 2, 0xFFFFFFFF):
        raise BackendUnavailable(f"ND2 compression {packing}: no backend installed")
    for k in range(info.get("uiSequenceCount", 1)):
        at, size = _nd2_chunk(source, chunks[f"ImageDataSeq|{k}!"])
        raw = source.read_at(at + 8, size - 8)  # behind a time stamp
        raw = zlib.decompress(raw) if packing == 0 else raw
        lines = np.frombuffer(raw, np.uint8, height * row).reshape(height, row)[:, : width * samples * dtype.itemsize]
        x = np.ascontiguousarray(lines).view(dtype).reshape(height, width, samples)
        yield {"sequence": k}, x[..., 0] if samples == 1 else x


def nd2_encode(frames: list[np.ndarray], packed: bool = True) -> bytes:
    x = frames[0]
    height, width, samples = *x.shape[:2], 1 if x.ndim == 2 else x.shape[2]
    fields = {"uiWidth": width, "uiWidthBytes": width * samples * x.dtype.itemsize, "uiHeight": height, "uiComp": samples, "uiBpcInMemory": 8 * x.dtype.itemsize, "uiBpcSignificant": 8 * x.dtype.itemsize, "uiSequenceCount": len(frames), "eCompression": 0 if packed else 2}
    xml = "<variant><no_name>" + "".join(f'<{k} value="{v}"/>' for k, v in fields.items()) + "</no_name></variant>"
    chunks = [(b"ND2 FILE SIGNATURE CHUNK NAME01!", b"Ver3.0"), (b"ImageAttributes!", xml.encode())]
    chunks += [(f"ImageDataSeq|{k}!".encode(), bytes(8) + (zlib.compress(f.tobytes()) if packed else f.tobytes())) for k, f in enumerate(frames)]
    out, at, listed = [], 0, b""
    for name, data in chunks:
        out.append(struct.pack("<4sIQ", _CHUNK, len(name), len(data)) + name + data)
        listed += name + struct.pack("<QQ", at, len(out[-1]))
        at += len(out[-1])
    listed += _MAP_END
    out.append(struct.pack("<4sIQ", _CHUNK, len(_MAP), len(listed)) + _MAP + listed)
    return b"".join(out) + struct.pack("<32sQ", _MAP_END, at)


def read_nd2(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, nd2_frames)


# --- compound files and OIB -----------------------------------------------------------
_OLE, _END, _FREE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFE, 0xFFFFFFFF


class Compound:
    """Streams of a compound file (OLE2), by their paths."""

    def __init__(self, source: storage.Source):
        self.source = source
        head = source.read_at(0, 512)
        if head[:8] != _OLE:
            raise ValueError("not a compound file")
        big, small = struct.unpack_from("<HH", head, 30)
        self.sector, self.mini = 1 << big, 1 << small
        _, first_dir, _, self.cutoff, first_mini, _, more, n_more = struct.unpack_from("<8I", head, 44)
        tables = list(struct.unpack_from("<109I", head, 76))
        for _ in range(n_more):
            block = struct.unpack(f"<{self.sector // 4}I", self._sector(more))
            tables += block[:-1]
            more = block[-1]
        self.next = np.frombuffer(b"".join(self._sector(t) for t in tables if t != _FREE), "<u4")
        self.next_mini = np.frombuffer(self._chain(first_mini), "<u4")
        raw = self._chain(first_dir)
        entries = [raw[k : k + 128] for k in range(0, len(raw), 128)]
        self.streams: dict[str, tuple[int, int]] = {}
        self.root = b""
        start, size = struct.unpack_from("<IQ", entries[0], 116)
        self.root = self._chain(start)[:size]
        todo = [(struct.unpack_from("<I", entries[0], 76)[0], "")]
        while todo:
            k, folder = todo.pop()
            if k >= len(entries):
                continue
            e = entries[k]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le")
            left, right, child = struct.unpack_from("<III", e, 68)
            todo += [(left, folder), (right, folder)]
            if e[66] == 1:
                todo.append((child, f"{folder}{name}/"))
            elif e[66] == 2:
                self.streams[folder + name] = struct.unpack_from("<IQ", e, 116)

    def _sector(self, k: int) -> bytes:
        return self.source.read_at((k + 1) * self.sector, self.sector)

    def _chain(self, k: int) -> bytes:
        out, seen = [], 0
        while k < _END and seen <= len(self.next):
            out.append(k)
            k, seen = int(self.next[k]), seen + 1
        return b"".join(self.source.read_many([((k + 1) * self.sector, self.sector) for k in out], 0))

    def read(self, path: str) -> bytes:
        k, size = self.streams[path]
        if size >= self.cutoff:
            return self._chain(k)[:size]
        out = []
        while k < _END and len(out) <= len(self.next_mini):
            out.append(self.root[k * self.mini : (k + 1) * self.mini])
            k = int(self.next_mini[k])
        return b"".join(out)[:size]


def compound_encode(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams, some of them in storages of one level."""
    sector, mini = 512, 64
    folders = sorted({p.split("/")[0] for p in streams if "/" in p})
    fat: list[int] = []
    body: list[bytes] = []

    def put(data: bytes) -> int:
        n = -(-len(data) // sector)
        if not n:
            return _END
        first = len(fat)
        fat.extend([*range(first + 1, first + n), _END])
        body.append(data.ljust(n * sector, b"\0"))
        return first

    small: list[bytes] = []
    mini_fat: list[int] = []
    places: dict[str, int] = {}
    for p, data in streams.items():
        if len(data) >= 4096:
            places[p] = put(data)
        else:
            n = -(-len(data) // mini)
            places[p] = len(mini_fat) if n else _END
            mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + n), _END] if n else []
            small.append(data.ljust(n * mini, b"\0"))
    entries: list[tuple[str, int, int, int, int, int]] = []  # name, kind, next, child, start, size
    number = {f: 1 + k for k, f in enumerate(folders)}
    number |= {p: 1 + len(folders) + k for k, p in enumerate(streams)}
    top = [*folders, *(p for p in streams if "/" not in p)]
    chains = {"": top} | {f: [p for p in streams if p.startswith(f + "/")] for f in folders}
    after = {a: number[b] for chain in chains.values() for a, b in zip(chain, chain[1:])}
    held = b"".join(small)
    entries.append(("Root Entry", 5, _FREE, number[top[0]] if top else _FREE, put(held), len(held)))
    entries += [(f, 1, after.get(f, _FREE), number[chains[f][0]], 0, 0) for f in folders]
    entries += [(p.rpartition("/")[2], 2, after.get(p, _FREE), _FREE, places[p], len(d)) for p, d in streams.items()]
    raw = []
    for name, kind, right, child, start, size in entries:
        text = name.encode("utf-16-le")
        raw.append(struct.pack("<64sHBBIII36xIQ", text, len(text) + 2, kind, 1, _FREE, right, child, start, size))
    first_mini = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) * 4 // sector) * sector, b"\xff"))
    first_dir = put(b"".join(raw))
    # the head lists 109 tables; blocks that are chained by their last number list the others
    per, tables, more = sector // 4, 1, 0
    while len(fat) + tables + more > tables * per:
        tables += 1
        more = -(-max(0, tables - 109) // (per - 1))
    where = list(range(len(fat), len(fat) + tables))
    fat += [0xFFFFFFFD] * tables + [0xFFFFFFFC] * more
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(tables * sector, b"\xff")
    n_mini = -(-len(mini_fat) * 4 // sector)
    first_more = where[-1] + 1
    blocks = []
    for k in range(more):
        own = where[109 + k * (per - 1) : 109 + (k + 1) * (per - 1)]
        own += [_FREE] * (per - 1 - len(own))
        blocks.append(struct.pack(f"<{per}I", *own, first_more + k + 1 if k + 1 < more else _END))
    head = struct.pack("<8s16xHHHHH6xIIIIIIIII", _OLE, 62, 3, 0xFFFE, 9, 6, 0, tables, first_dir, 0, 4096, first_mini, n_mini, first_more if more else _END, more)
    return b"".join([head, struct.pack("<109I", *where[:109], *[_FREE] * (109 - len(where[:109]))), *body, table, *blocks])


def _text(data: bytes) -> str:
    return data.decode("utf-16-le", "replace").lstrip("﻿")


def oib_frames(path):
    """(axes, pixels) of the planes: channel, depth and time from 0, the channel slowest."""
    ole = Compound(storage.open_source(path))
    own = {p.rpartition("/")[2]: p for p in ole.streams}
    names, main = {}, None
    for line in _text(ole.read(own["OibInfo.txt"])).splitlines():
        key, _, value = line.partition("=")
        if key == "MainFileName":
            main = value.strip()
        elif re.fullmatch(r"Stream\d+", key):
            names[value.strip()] = key
    parser = configparser.ConfigParser(interpolation=None, strict=False, delimiters=("=",), comment_prefixes=(), allow_no_value=True)
    parser.optionxform = str
    parser.read_string(_text(ole.read(own[main])))
    sizes = {}
    for section in parser.sections():
        if re.fullmatch(r"Axis \d+ Parameters Common", section):
            code, size = (parser[section].get(k, "").strip().strip('"') for k in ("AxisCode", "MaxSize"))
            if code and size.isdigit() and int(size):
                sizes[code] = int(size)
    planes = {}
    for name, stream in names.items():
        if m := re.search(r"s_C(\d+)(?:Z(\d+))?(?:T(\d+))?\.tif$", name):
            planes[tuple(int(v or 1) - 1 for v in m.groups())] = stream
    for (c, z, t), stream in sorted(planes.items()):
        if c < sizes.get("C", 1) and z < sizes.get("Z", 1) and t < sizes.get("T", 1):
            yield {"c": c, "z": z, "t": t}, tiff_arrays(ole.read(own[stream]))[0]


def oib_encode(planes: dict[tuple[int, int, int], np.ndarray]) -> bytes:
    """Planes by channel, depth and time."""
    h, w = next(iter(planes.values())).shape
    sizes = {"X": w, "Y": h} | {k: 1 + max(p[i] for p in planes) for i, k in enumerate("CZT")}
    ini = "".join(f'[Axis {i} Parameters Common]\r\nAxisCode="{k}"\r\nMaxSize={n}\r\n' for i, (k, n) in enumerate(sizes.items()))
    info, streams = "[OibSaveInfo]\r\nMainFileName=Stream00000\r\nStorage00001=image.oif.files\r\nStream00000=image.oif\r\n", {}
    for k, ((c, z, t), x) in enumerate(planes.items(), 1):
        late = f"T{t + 1:03d}" if sizes["T"] > 1 else ""
        info += f"Stream{k:05d}=Storage00001/s_C{c + 1:03d}Z{z + 1:03d}{late}.tif\r\n"
        streams[f"Storage00001/Stream{k:05d}"] = tiff_bytes([x])
    return compound_encode({"OibInfo.txt": ("﻿" + info).encode("utf-16-le"), "Stream00000": ("﻿" + ini).encode("utf-16-le"), **streams})


def read_oib(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, oib_frames)


def list_streams(spark: SparkSession, path: str) -> DataFrame:
    """(path, stream, size) of the streams of compound files."""
    files = spark.createDataFrame([(f,) for f in storage.list_files(path)], "path string")

    def run(batches):
        for batch in batches:
            for f in batch.column(0).to_pylist():
                ole = Compound(storage.open_source(f))
                yield pa.RecordBatch.from_pylist([{"path": f, "stream": p, "size": n} for p, (_, n) in sorted(ole.streams.items())])

    return files.mapInArrow(run, "path string, stream string, size long")


# --- VSI and its ETS companions -------------------------------------------------------
_ETS_DATA = 292  # behind two heads


def ets_head(source: storage.Source) -> tuple[int, int, int, int]:
    """(width, height, components, place of the index, which ends the planes)."""
    head = source.read_at(0, _ETS_DATA)
    if head[:4] != b"SIS\0" or head[64:68] != b"ETS\0":
        raise ValueError("not an ETS")
    (components,), (width, height) = struct.unpack_from("<I", head, 72), struct.unpack_from("<II", head, 92)
    return width, height, components, struct.unpack_from("<Q", head, 32)[0]


def ets_planes(path):
    """The planes of 16 bits, one after the other."""
    source = storage.open_source(path)
    width, height, _, end = ets_head(source)
    size = 2 * width * height
    if not size or (end - _ETS_DATA) % size:
        raise ValueError("no whole number of planes")
    for at in range(_ETS_DATA, end, size):
        yield np.frombuffer(source.read_at(at, size), "<u2").reshape(height, width)


def ets_encode(planes: np.ndarray) -> bytes:
    body = planes.astype("<u2").tobytes()
    head = struct.pack("<4sIII6Q", b"SIS\0", 64, 3, 6, 64, 228, _ETS_DATA + len(body), 4, 0, 0)
    own = struct.pack("<4sII16xII", b"ETS\0", 0x30001, 1, planes.shape[2], planes.shape[1])
    return head + own.ljust(228, b"\0") + body + struct.pack("<I", 1)


def vsi_companions(path: str) -> list[str]:
    """The files of planes beside an index, stack by stack."""
    folder, _, name = path.rpartition("/")
    return storage.list_files(f"{folder}/_{name.rpartition('.')[0]}_/stack*/frame_t_*.ets")


def vsi_frames(path):
    """(axes, pixels) of all planes of an index's companions; without any, of the index's own
    pages."""
    files = vsi_companions(path)
    for k, f in enumerate(files):
        for n, x in enumerate(ets_planes(f)):
            yield {"file": k, "plane": n}, x
    if not files:
        for n, x in enumerate(tiff_arrays(storage.read_all(path))):
            yield {"file": 0, "plane": n}, x


def read_vsi(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, vsi_frames)
