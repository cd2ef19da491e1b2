"""Byte ranges of files, wherever they are: local and mounted files, the stores that Arrow
opens (``s3://``, ``gs://``, ``hdfs://`` ...), HTTP servers, and bytes in memory.

Everything here runs where a task runs, so a container's pixels are read by range on the
executors.  Stores that only Spark reads are reached through ``binaryFile`` instead.
"""

from __future__ import annotations

import fnmatch
import glob
import os
import urllib.error
import urllib.parse
import urllib.request
from collections import OrderedDict

#: Bytes that a remote source reads at once at least, and how many such blocks it keeps.
BLOCK, BLOCKS = 1 << 16, 64


def merge(ranges: list[tuple[int, int]], max_gap: int = 0, max_size: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Runs (offset, length) that cover the ranges, and each range's (run, place in it).

    Ranges join in the order of their offsets, of equal ones the longer first, while the
    gap between them is at most ``max_gap`` and the run stays within ``max_size``.
    """
    runs: list[list[int]] = []
    place: list[tuple[int, int]] = [(0, 0)] * len(ranges)
    for k in sorted(range(len(ranges)), key=lambda i: (ranges[i][0], -ranges[i][1])):
        at, n = ranges[k]
        if runs:
            start, end = runs[-1]
            if at - end <= max_gap and (max_size is None or max(end, at + n) - start <= max_size):
                runs[-1][1] = max(end, at + n)
                place[k] = (len(runs) - 1, at - start)
                continue
        runs.append([at, at + n])
        place[k] = (len(runs) - 1, 0)
    return [(a, b - a) for a, b in runs], place


class Source:
    """Reads of byte ranges, with counts of requests and bytes."""

    def __init__(self):
        self.requests = self.bytes_read = 0

    def size(self) -> int:
        raise NotImplementedError

    def _read(self, at: int, n: int) -> bytes:
        raise NotImplementedError

    def read_at(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes; fewer at the end."""
        data = self._read(at, n)
        self.requests += 1
        self.bytes_read += len(data)
        return data

    def read_many(self, ranges: list[tuple[int, int]], max_gap: int = 4096, max_size: int | None = 1 << 26) -> list[bytes]:
        """The ranges in their order; near ones are read together."""
        runs, place = merge(ranges, max_gap, max_size)
        data = [self.read_at(at, n) for at, n in runs]
        return [data[k][at : at + n] for (k, at), (_, n) in zip(place, ranges)]

    def stats(self) -> dict[str, int]:
        return {"requests": self.requests, "bytes_read": self.bytes_read}


class BytesSource(Source):
    def __init__(self, data: bytes):
        super().__init__()
        self.data = data

    def size(self) -> int:
        return len(self.data)

    def _read(self, at: int, n: int) -> bytes:
        return bytes(self.data[at : at + n])


class FileSource(Source):
    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self.file = open(path, "rb")  # noqa: SIM115

    def size(self) -> int:
        return os.fstat(self.file.fileno()).st_size

    def _read(self, at: int, n: int) -> bytes:
        return os.pread(self.file.fileno(), n, at)


class _Blocks(Source):
    """A remote source: small reads take whole blocks, and the last ones are kept."""

    def __init__(self):
        super().__init__()
        self.kept: OrderedDict[int, bytes] = OrderedDict()

    def _fetch(self, at: int, n: int) -> bytes:
        raise NotImplementedError

    def _block(self, k: int) -> bytes:
        if k not in self.kept:
            data = self._fetch(k * BLOCK, BLOCK)
            self.requests += 1
            self.bytes_read += len(data)
            self.kept[k] = data
            if len(self.kept) > BLOCKS:
                self.kept.popitem(last=False)
        self.kept.move_to_end(k)
        return self.kept[k]

    def read_at(self, at: int, n: int) -> bytes:
        if n <= 0:
            return b""
        if n > 4 * BLOCK:
            data = self._fetch(at, n)
            self.requests += 1
            self.bytes_read += len(data)
            return data
        first, last = at // BLOCK, (at + n - 1) // BLOCK
        data = b"".join(self._block(k) for k in range(first, last + 1))
        return data[at - first * BLOCK : at - first * BLOCK + n]


class ArrowSource(_Blocks):
    def __init__(self, uri: str):
        from pyarrow import fs

        super().__init__()
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def _fetch(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size() - at)), at) if at < self.size() else b""


class HttpSource(_Blocks):
    """An HTTP server that answers range requests; one that does not gives the whole file."""

    def __init__(self, url: str, timeout: float = 60.0):
        super().__init__()
        self.url, self.timeout = url, timeout

    def _open(self, **headers: str):
        try:
            return urllib.request.urlopen(urllib.request.Request(self.url, headers=headers), timeout=self.timeout)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise FileNotFoundError(self.url) from e
            raise

    def size(self) -> int:
        with self._open(Range="bytes=0-0") as answer:
            total = answer.headers.get("Content-Range", "").rpartition("/")[2]
            return int(total) if total.isdigit() else int(answer.headers["Content-Length"])

    def _fetch(self, at: int, n: int) -> bytes:
        try:
            with self._open(Range=f"bytes={at}-{at + n - 1}") as answer:
                data = answer.read()
                return data if answer.status == 206 else data[at : at + n]
        except urllib.error.HTTPError as e:
            if e.code == 416:  # beyond the end
                return b""
            raise


def local_path(path: str) -> str | None:
    """The path of a local file; None if another store has it."""
    scheme = urllib.parse.urlsplit(path).scheme
    if scheme == "file":
        return urllib.parse.unquote(urllib.parse.urlsplit(path).path)
    return path if len(scheme) < 2 else None


def open_source(path: str | bytes) -> Source:
    """A source for a path, a URL, or bytes.  A file that is not there raises
    ``FileNotFoundError``."""
    if isinstance(path, bytes):
        return BytesSource(path)
    if (local := local_path(path)) is not None:
        return FileSource(local)
    return HttpSource(path) if path.startswith(("http://", "https://")) else ArrowSource(path)


def exists(path: str) -> bool:
    if (local := local_path(path)) is not None:
        return os.path.exists(local)
    try:
        open_source(path).size()
    except FileNotFoundError:
        return False
    return True


def read_all(path: str) -> bytes:
    source = open_source(path)
    return source.read_at(0, source.size())


def list_files(pattern: str) -> list[str]:
    """The files of a pattern, sorted.  HTTP servers list nothing: a URL stands for itself."""
    if (local := local_path(pattern)) is not None:
        return sorted(glob.glob(local))
    if pattern.startswith(("http://", "https://")) or not any(c in pattern for c in "*?["):
        return [pattern]
    from pyarrow import fs

    folder, _, name = pattern.rpartition("/")
    store, path = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(path))
    return sorted(f"{folder}/{f.base_name}" for f in found if fnmatch.fnmatch(f.base_name, name))
