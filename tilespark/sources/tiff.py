"""TIFF and BigTIFF: pages, tiles and strips as rows, and a writer of tiled pyramids.

The reader plans on the driver from headers alone, row by row and column by column of the
tiles; partitions are runs of tiles, and comparisons on ``page``, ``level``, ``plane``,
``ty``, ``tx``, ``y0`` and ``x0`` drop tiles before any of their bytes are read.
"""

from __future__ import annotations

import io
import itertools
import math
import os
import shutil
import struct
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tilespark.functions import arraycodecs
from tilespark.functions.bytecodecs import DECODE, ENCODE
from tilespark.functions.registry import SEGMENT_CODES, BackendUnavailable
from tilespark.sources import storage

# Field types (struct letters), and tags.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SUB_IFDS, SAMPLE_FORMAT = 322, 323, 324, 325, 330, 339


@dataclass
class Page:
    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if self.tags.get(tag) else default

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.one(HEIGHT), self.one(WIDTH), self.one(SAMPLES, 1)

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}[self.one(SAMPLE_FORMAT, 1)]
        return np.dtype(f"{kind}{self.one(BITS, 8) // 8}")

    @property
    def description(self) -> str:
        return b"".join(self.tags.get(DESCRIPTION, ())).rstrip(b"\0").decode("utf-8", "replace")

    @property
    def tiled(self) -> bool:
        return TILE_OFFSETS in self.tags

    @property
    def tile_shape(self) -> tuple[int, int]:
        if self.tiled:
            return self.one(TILE_HEIGHT), self.one(TILE_WIDTH)
        return min(self.one(ROWS_PER_STRIP, self.one(HEIGHT)), self.one(HEIGHT)), self.one(WIDTH)

    @property
    def grid(self) -> tuple[int, int, int]:
        """Planes, and rows and columns of tiles."""
        (height, width, samples), (th, tw) = self.shape, self.tile_shape
        return samples if self.one(PLANAR, 1) == 2 else 1, -(-height // th), -(-width // tw)

    def segment(self, plane: int, ty: int, tx: int) -> tuple[int, ...]:
        """(plane, ty, tx, y0, x0, h, w, offset, size) of a tile or strip."""
        (height, width, _), (th, tw), (_, rows, cols) = self.shape, self.tile_shape, self.grid
        k = (plane * rows + ty) * cols + tx
        offset = self.tags[TILE_OFFSETS if self.tiled else STRIP_OFFSETS][k]
        size = self.tags[TILE_SIZES if self.tiled else STRIP_SIZES][k]
        return plane, ty, tx, ty * th, tx * tw, min(th, height - ty * th), min(tw, width - tx * tw), offset, size

    def segments(self):
        """All tiles or strips."""
        for where in itertools.product(*map(range, self.grid)):
            yield self.segment(*where)

    def decode(self, data: bytes, h: int, w: int) -> np.ndarray:
        """Pixels (h, w, samples) of a stored tile or strip."""
        code = self.one(COMPRESSION, 1)
        name = SEGMENT_CODES.get(code)
        if name != "none":
            if name not in DECODE:
                raise BackendUnavailable(f"segment code {code}: no backend installed")
            data = DECODE[name](data)
        samples = 1 if self.one(PLANAR, 1) == 2 else self.shape[2]
        th, tw = self.tile_shape
        th = th if self.tiled else h
        shape = (th, tw, samples)
        dtype = self.dtype
        if self.one(PREDICTOR, 1) == 3:
            return arraycodecs.predictor3_decode(data[: th * tw * samples * dtype.itemsize], dtype, shape)[:h, :w]
        x = np.frombuffer(data, dtype.newbyteorder(self.order), th * tw * samples).reshape(shape).astype(dtype)
        return (arraycodecs.predictor2_decode(x) if self.one(PREDICTOR, 1) == 2 else x)[:h, :w]


class Directories:
    """The directories of a file, each found by its place; the first bytes tell how they are
    written."""

    def __init__(self, read_at):
        self.read_at = read_at
        head = read_at(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = struct.unpack(f"{order or '<'}H", head[2:4])[0]
        if order is None or kind not in (42, 43):
            raise ValueError("not a TIFF")
        big = kind == 43
        self.order = order
        self.first = struct.unpack_from(f"{order}{'Q' if big else 'I'}", head, 8 if big else 4)[0]
        self.count, self.entry, self.word = ("Q", 20, "Q") if big else ("H", 12, "I")

    def at(self, place: int) -> tuple[Page, int]:
        """The directory at a place, and the place of the next one."""
        order, word, read_at = self.order, self.word, self.read_at
        n = struct.unpack(order + self.count, read_at(place, struct.calcsize(self.count)))[0]
        place += struct.calcsize(self.count)
        raw = read_at(place, n * self.entry + struct.calcsize(word))
        page = Page(order)
        for k in range(n):
            tag, kind = struct.unpack_from(f"{order}HH", raw, k * self.entry)
            size = struct.unpack_from(order + word, raw, k * self.entry + 4)[0]
            letters = TYPES.get(kind, "B")
            length = size * (1 if letters == "s" else struct.calcsize("=" + letters))
            room = struct.calcsize(word)
            value = k * self.entry + 4 + room
            data = raw[value : value + length] if length <= room else read_at(struct.unpack_from(order + word, raw, value)[0], length)
            page.tags[tag] = (bytes(data),) if letters == "s" else struct.unpack(order + letters * size, data)
        return page, struct.unpack_from(order + word, raw, n * self.entry)[0]

    def __iter__(self):
        """(page, level, place, Page) of all; those in SubIFDs are levels of their page."""
        at, number, seen = self.first, 0, set()
        while at and at not in seen:
            seen.add(at)
            page, after = self.at(at)
            yield number, 0, at, page
            for k, sub in enumerate(page.tags.get(SUB_IFDS, ()), 1):
                yield number, k, sub, self.at(sub)[0]
            number, at = number + 1, after


def read_pages(read_at) -> list[tuple[int, int, Page]]:
    """(page, level, Page) of all directories; those in SubIFDs are levels of their page."""
    return [(number, level, page) for number, level, _, page in Directories(read_at)]


def pyramid_levels(pages: list[tuple[int, int, Page]]) -> list[Page]:
    """Full resolution first: SubIFDs of the first page, or else the reduced pages after it
    (labels, masks and pages of other shapes are left out), largest first."""
    base = pages[0][2]
    levels = [p for n, k, p in pages if n == 0 and k]
    if not levels:
        levels = [p for n, k, p in pages[1:] if not k and p.one(SUBFILE, 0) & 1 and not p.one(SUBFILE, 0) & 4 and p.shape[2] == base.shape[2]]
    return [base, *sorted(levels, key=lambda p: -p.shape[0] * p.shape[1])]


def read_region(read_at, page: Page, y: tuple[int, int], x: tuple[int, int]) -> np.ndarray:
    """Pixels of a box; only the tiles that it meets are read, and predictors are undone."""
    out = np.zeros((y[1] - y[0], x[1] - x[0], page.shape[2]), page.dtype)
    for plane, _, _, y0, x0, h, w, at, n in page.segments():
        a, b, c, d = max(y[0], y0), min(y[1], y0 + h), max(x[0], x0), min(x[1], x0 + w)
        if a < b and c < d and n:
            tile = page.decode(read_at(at, n), h, w)[a - y0 : b - y0, c - x0 : d - x0]
            channels = slice(plane, plane + 1) if page.one(PLANAR, 1) == 2 else slice(None)
            out[a - y[0] : b - y[0], c - x[0] : d - x[0], channels] = tile
    return out


def tiff_bytes(pages: list, **options) -> bytes:
    out = io.BytesIO()
    write_tiff(out, pages, **options)
    return out.getvalue()


def tiff_arrays(data: bytes) -> list[np.ndarray]:
    """The pages of a file in memory, without levels; one channel is no axis."""
    read_at = storage.BytesSource(bytes(data)).read_at
    out = [read_region(read_at, p, (0, p.shape[0]), (0, p.shape[1])) for _, k, p in read_pages(read_at) if not k]
    return [x[..., 0] if x.shape[2] == 1 else x for x in out]


def write_tiff(path, pages: list, *, tile: tuple[int, int] | None = None, compression: int = 1, level: int | None = None, predictor: int = 1, big: bool = False, subifds: bool = True, description: str = "") -> None:
    """Writes pages to a file or anything that can be written to; an entry that is a list is a
    pyramid, full resolution first, whose other levels become SubIFDs, or reduced pages of
    their own after it.  What cannot seek gets the file once it is whole."""
    if not isinstance(path, (str, bytes, os.PathLike)):
        with tempfile.SpooledTemporaryFile(1 << 26) as held:
            _write(held, pages, tile, compression, level, predictor, big, subifds, description)
            held.seek(0)
            shutil.copyfileobj(held, path)
        return
    with open(path, "wb") as f:
        _write(f, pages, tile, compression, level, predictor, big, subifds, description)


def _write(f, pages: list, tile, compression: int, level, predictor: int, big: bool, subifds: bool, description: str) -> None:
    word, count = ("Q", "Q") if big else ("I", "H")
    f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
    link = 8 if big else 4

    def directory(x: np.ndarray, reduced: bool, subs: int) -> tuple[int, int, int]:
        """Writes tiles and directory; returns its place, that of its link and of its SubIFDs."""
        x = x[..., None] if x.ndim == 2 else x
        h, w, c = x.shape
        th, tw = tile or (min(h, 64), w)
        offsets, sizes = [], []
        for y0 in range(0, h, th):
            for x0 in range(0, w, tw):
                part = x[y0 : y0 + th, x0 : x0 + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                part = part.astype(part.dtype.newbyteorder("<"))
                if predictor == 3:
                    data = arraycodecs.predictor3_encode(part)
                else:
                    data = (arraycodecs.predictor2_encode(part) if predictor == 2 else part).tobytes()
                name = SEGMENT_CODES[compression]
                data = data if name == "none" else ENCODE[name](data, level)
                offsets.append(f.tell())
                sizes.append(len(data))
                f.write(data + b"\0" * (len(data) % 2))
        kind = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
        tags = [(SUBFILE, "I", [int(reduced)]), (WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [x.dtype.itemsize * 8] * c), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [2 if c >= 3 else 1]), (SAMPLES, "H", [c]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor]), (SAMPLE_FORMAT, "H", [kind] * c)]
        if description and not reduced:
            tags.append((DESCRIPTION, "s", description.encode() + b"\0"))
        if tile:
            tags += [(TILE_WIDTH, "I", [tw]), (TILE_HEIGHT, "I", [th]), (TILE_OFFSETS, word, offsets), (TILE_SIZES, word, sizes)]
        else:
            tags += [(ROWS_PER_STRIP, "I", [th]), (STRIP_OFFSETS, word, offsets), (STRIP_SIZES, word, sizes)]
        if subs:
            tags.append((SUB_IFDS, word, [0] * subs))
        codes = {"s": 2, "H": 3, "I": 4, "Q": 16}
        entries, room, sub_at = [], struct.calcsize(word), 0
        for tag, letter, values in sorted(tags):
            data = bytes(values) if letter == "s" else struct.pack(f"<{len(values)}{letter}", *values)
            head = struct.pack(f"<HH{word}", tag, codes[letter], len(values))
            if len(data) <= room:
                entries.append((head, data.ljust(room, b"\0"), tag))
            else:
                f.write(b"\0" * (f.tell() % 2))
                if tag == SUB_IFDS:
                    sub_at = f.tell()
                entries.append((head, struct.pack("<" + word, f.tell()), tag))
                f.write(data)
        f.write(b"\0" * (f.tell() % 2))
        at = f.tell()
        f.write(struct.pack("<" + count, len(entries)))
        for head, data, tag in entries:
            if tag == SUB_IFDS and not sub_at:
                sub_at = f.tell() + len(head)
            f.write(head + data)
        next_at = f.tell()
        f.write(b"\0" * room)
        return at, next_at, sub_at

    def patch(place: int, value: int) -> None:
        end = f.tell()
        f.seek(place)
        f.write(struct.pack("<" + word, value))
        f.seek(end)

    for p in pages:
        levels = p if isinstance(p, list) else [p]
        at, next_at, sub_at = directory(levels[0], False, len(levels) - 1 if subifds else 0)
        patch(link, at)
        link = next_at
        for k, x in enumerate(levels[1:]):
            at, next_at, _ = directory(x, True, 0)
            if subifds:
                patch(sub_at + k * struct.calcsize(word), at)
            else:
                patch(link, at)
                link = next_at


def ome_xml(axes: str, shape: tuple[int, ...], dtype: np.dtype, channels: list[str] = (), size_um: dict[str, float] | None = None) -> str:
    """Minimal OME metadata for a TIFF description."""
    from xml.sax.saxutils import quoteattr

    sizes = dict.fromkeys("XYZCT", 1) | dict(zip(axes, shape))
    kind = {"u1": "uint8", "i1": "int8", "u2": "uint16", "i2": "int16", "u4": "uint32", "i4": "int32", "f4": "float", "f8": "double"}[np.dtype(dtype).str[1:]]
    attrs = "".join(f' Size{k}="{v}"' for k, v in sizes.items())
    attrs += "".join(f' PhysicalSize{k}="{v!r}" PhysicalSize{k}Unit="µm"' for k, v in (size_um or {}).items())
    names = "".join(f"<Channel ID={quoteattr(f'Channel:0:{i}')} Name={quoteattr(c)}/>" for i, c in enumerate(channels))
    return f'<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0"><Pixels ID="Pixels:0" DimensionOrder="XYZCT" Type="{kind}"{attrs}>{names}<TiffData/></Pixels></Image></OME>'


def file_reader(path: str):
    """Reads of byte ranges of a file on this machine, in a store or on a server."""
    return storage.open_source(path).read_at


_OPS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class Pruning(DataSourceReader):
    """Keeps the comparisons on some integer columns and applies them while planning."""

    columns: tuple[str, ...] = ()

    def __init__(self, options):
        self.options = options
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _OPS and name in self.columns:
                self.tests.append((name, type(f), f.value))
            yield f  # Spark checks all rows again

    def keep(self, row: dict) -> bool:
        return all(_OPS[op](row[name], value) for name, op, value in self.tests)

    def keep_one(self, column: str, value: int) -> bool:
        return all(_OPS[op](value, wanted) for name, op, wanted in self.tests if name == column)

    def keep_each(self, count: int, *names: tuple[str, int]) -> Sequence[int]:
        """Of the places along an axis those that may be asked for; ``names`` are the columns
        that tell of it, each with the width of a place."""
        own = [(op, value, width) for column, op, value in self.tests for name, width in names if column == name]
        kept = [k for k in range(count) if all(_OPS[op](k * width, value) for op, value, width in own)]
        # a range needs no more room than its ends
        return range(kept[0], kept[-1] + 1) if kept and kept[-1] - kept[0] + 1 == len(kept) else kept


#: Where ``tilesPerPartition`` is not given: tiles of a directory in a partition, and how many
#: small tiles, of some directories or files, share one while their pixels stay within these bytes.
TILES, SHARED_TILES, SHARED_BYTES = 64, 512, 1 << 20
#: Rows that go to Spark at once, and bytes of their pixels.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 20


@dataclass
class Run:
    """A run of the tiles of the directory at ``place`` that may be asked for: numbers ``first``
    to ``last`` of planes, rows and columns."""

    path: str
    page: int
    level: int
    place: int
    axes: tuple[Sequence[int], Sequence[int], Sequence[int]]
    first: int
    last: int


@dataclass
class Tiles(InputPartition):
    runs: list[Run]


class TiffReader(Pruning):
    columns = ("page", "level", "plane", "ty", "tx", "y0", "x0")

    def _runs(self, size: int):
        """The runs of at most ``size`` tiles, with the bytes of their pixels."""
        for path in storage.list_files(self.options["path"]):
            for number, level, place, page in Directories(file_reader(path)):
                if self.keep_one("page", number) and self.keep_one("level", level):
                    (planes, rows, cols), (th, tw) = page.grid, page.tile_shape
                    axes = self.keep_each(planes, ("plane", 1)), self.keep_each(rows, ("ty", 1), ("y0", th)), self.keep_each(cols, ("tx", 1), ("x0", tw))
                    total = math.prod(map(len, axes))
                    tile = th * tw * page.dtype.itemsize * (page.shape[2] // planes)
                    for a in range(0, total, size):
                        last = min(total, a + size)
                        yield Run(path, number, level, place, axes, a, last), (last - a) * tile

    def partitions(self):
        own = self.options.get("tilesPerPartition")
        size = int(own or TILES)
        out, tiles, held = [Tiles([])], 0, 0
        for run, n in self._runs(size):
            tiles, held = tiles + run.last - run.first, held + n
            if tiles > size and (own or tiles > SHARED_TILES or held > SHARED_BYTES) and out[-1].runs:
                out.append(Tiles([]))
                tiles, held = run.last - run.first, n
            out[-1].runs.append(run)
        return out

    def read(self, part):
        path, rows, held = None, [], 0
        for run in part.runs:
            if run.path != path:
                path = run.path
                read_at = file_reader(path)
                directories = Directories(read_at)
            page, _ = directories.at(run.place)
            planes, ys, xs = run.axes
            for k in range(run.first, run.last):
                k, col = divmod(k, len(xs))
                where = planes[k // len(ys)], ys[k % len(ys)], xs[col]
                plane, ty, tx, y0, x0, h, w, at, n = page.segment(*where)
                pixels = page.decode(read_at(at, n), h, w)
                row = {"path": path, "page": run.page, "level": run.level, "plane": plane, "ty": ty, "tx": tx, "y0": y0, "x0": x0}
                row |= {"h": h, "w": w, "samples": pixels.shape[2], "dtype": page.dtype.str[1:], "payload": pixels.tobytes()}
                rows.append(row)
                held += len(row["payload"])
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, TIFF_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, TIFF_ARROW)


TIFF_ARROW = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("page", "level", "plane", "ty", "tx", "y0", "x0", "h", "w", "samples")), ("dtype", pa.string()), ("payload", pa.binary())])


class TiffSource(DataSource):
    """``spark.read.format("tiff").load(path)``: one row per tile with its decoded pixels.
    Options: ``path`` (a pattern of files, or a URL), ``tilesPerPartition``."""

    @classmethod
    def name(cls):
        return "tiff"

    def schema(self):
        return "path string, page int, level int, plane int, ty int, tx int, y0 int, x0 int, h int, w int, samples int, dtype string, payload binary"

    def reader(self, schema):
        return TiffReader(self.options)
