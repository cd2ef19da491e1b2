"""Byte ranges over files, HTTP and Arrow's stores, and containers that are read through them."""

import functools
import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from tilespark import api
from tilespark.functions import registry
from tilespark.functions.checksums import crc32c
from tilespark.operators import frames
from tilespark.sources import acquisitions, storage, tiff, zarr

RND = np.random.default_rng(4)


class Handler(BaseHTTPRequestHandler):
    """Files below a folder, by range; counts the bytes that it sends."""

    def __init__(self, folder, sent, *args):
        self.folder, self.sent = folder, sent
        super().__init__(*args)

    def do_GET(self):
        try:
            with open(f"{self.folder}{self.path}", "rb") as f:
                data = f.read()
        except (FileNotFoundError, IsADirectoryError):
            self.send_error(404)
            return
        total, asked = len(data), self.headers.get("Range")
        if asked:
            a, b = asked.removeprefix("bytes=").split("-")
            if int(a) >= total:
                self.send_error(416)
                return
            data = data[int(a) : int(b) + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{int(a) + len(data) - 1}/{total}")
        else:
            self.send_response(200)
        if "/frames/" in self.path:
            self.send_header("Content-Type", 'multipart/related; boundary="b"')
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.sent.append(len(data))
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture
def server(tmp_path):
    sent = []
    http = ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Handler, str(tmp_path), sent))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", sent
    http.shutdown()


@pytest.mark.parametrize(
    "ranges,gap,size,runs",
    [
        ([], 0, None, []),
        ([(0, 100), (100, 100), (200, 100)], 0, None, [(0, 300)]),
        ([(0, 100), (150, 50)], 50, None, [(0, 200)]),
        ([(0, 100), (151, 50)], 50, None, [(0, 100), (151, 50)]),
        ([(0, 10), (0, 100)], 0, 50, [(0, 100), (0, 10)]),
        ([(300, 5), (0, 10), (20, 10)], 10, 25, [(0, 10), (20, 10), (300, 5)]),
    ],
)
def test_merged_ranges(ranges, gap, size, runs):
    got, place = storage.merge(ranges, gap, size)
    assert got == runs
    for (at, n), (run, inside) in zip(ranges, place):
        start, length = got[run]
        assert start + inside == at and inside + n <= length


def test_sources_agree(tmp_path, server):
    url, sent = server
    data = bytes(RND.integers(0, 256, 500_000, np.uint8))
    (tmp_path / "x.bin").write_bytes(data)
    for path in (str(tmp_path / "x.bin"), f"file://{tmp_path}/x.bin", f"{url}/x.bin", data):
        source = storage.open_source(path)
        assert source.size() == len(data)
        for at, n in ((0, 10), (70_000, 3), (65_530, 20), (0, 400_000), (499_990, 50), (600_000, 5), (5, 0)):
            assert source.read_at(at, n) == data[at : at + n]
        asked = [(10, 5), (400_000, 10), (0, 4), (12, 8)]
        assert source.read_many(asked) == [data[a : a + n] for a, n in asked]
        assert source.stats()["requests"] >= 1
    assert storage.ArrowSource(f"file://{tmp_path}/x.bin").read_at(99, 7) == data[99:106]
    assert not storage.exists(f"{url}/none") and storage.exists(f"{url}/x.bin") and not storage.exists(f"{tmp_path}/none")
    assert storage.list_files(f"{tmp_path}/*.bin") == [f"{tmp_path}/x.bin"]
    sent.clear()
    storage.open_source(f"{url}/x.bin").read_at(1000, 10)
    assert sum(sent) <= storage.BLOCK


def test_containers_over_http(spark, tmp_path, server):
    url, sent = server
    x = RND.integers(0, 60_000, (512, 640)).astype("u2")
    tiff.write_tiff(f"{tmp_path}/x.tif", [x], tile=(64, 64))
    zarr.write_array(f"{tmp_path}/x.zarr", x, (256, 256), inner=(64, 64), codec=None)
    sent.clear()
    assert (api.read_region(f"{url}/x.tif", 0, (100, 140), (200, 230), format="tiff")[..., 0] == x[100:140, 200:230]).all()
    assert sum(sent) < x.nbytes / 2
    sent.clear()
    assert (api.read_region(f"{url}/x.zarr", 0, (100, 120), (200, 230), format="zarr") == x[100:120, 200:230]).all()
    assert sum(sent) < x.nbytes / 2
    rows = api.read(spark, f"{url}/x.tif").where("ty = 1 and tx = 2").collect()
    assert len(rows) == 1 and (np.frombuffer(rows[0].payload, "u2").reshape(64, 64) == x[64:128, 128:192]).all()


def test_dicomweb(spark, tmp_path, server):
    url, _ = server
    x = RND.integers(0, 4096, (6, 5)).astype("u2")
    folder = tmp_path / "studies/1/series/2/instances"
    (folder / "3/frames").mkdir(parents=True)
    (folder / "3/frames/1").write_bytes(b"--b\r\nContent-Type: application/octet-stream; transfer-syntax=1.2.840.10008.1.2.1\r\n\r\n" + x.tobytes() + b"\r\n--b--")
    client = acquisitions.DicomwebClient(url)
    assert (client.get_frame("1", "2", "3", 1, (6, 5), "u2") == x).all()
    listed = acquisitions.DicomwebClient("s", fetch=lambda u, a: ("application/dicom+json", json.dumps([{"00080018": {"Value": [v]}} for v in "ab"]).encode()))
    assert listed.list_instances("1", "2") == ["a", "b"]
    asked = spark.createDataFrame([("1", "2", "3", 1, 6, 5, "u2")], "study string, series string, instance string, frame long, height int, width int, dtype string")
    assert acquisitions.read_dicomweb(asked, url).first().payload == x.tobytes()


def test_zarr_order_filters_and_checksums(tmp_path):
    x = np.arange(6, dtype="i4").reshape(2, 3)
    folder = tmp_path / "f"
    folder.mkdir()
    meta = {"zarr_format": 2, "shape": [2, 3], "chunks": [2, 3], "dtype": "<i4", "compressor": None, "fill_value": 0, "order": "F", "filters": None}
    (folder / ".zarray").write_text(json.dumps(meta))
    (folder / "0.0").write_bytes(x.T.tobytes())
    assert (zarr.open_array(str(folder)).read() == x).all()
    (folder / ".zarray").write_text(json.dumps(meta | {"filters": [{"id": "vlen-utf8"}]}))
    with pytest.raises(registry.BackendUnavailable):
        zarr.open_array(str(folder)).read()
    zarr.write_array(f"{tmp_path}/t", x, (2, 3), codec=None, checksum=True)
    path = tmp_path / "t/c/0/0"
    assert (zarr.open_array(f"{tmp_path}/t").read() == x).all()
    path.write_bytes(b"\x01" + path.read_bytes()[1:])
    with pytest.raises(ValueError, match="checksum"):
        zarr.open_array(f"{tmp_path}/t").read()
    meta = json.loads((tmp_path / "t/zarr.json").read_text())
    meta["codecs"] = [{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "little"}}]
    (tmp_path / "t/zarr.json").write_text(json.dumps(meta))
    path.write_bytes(x.T.tobytes())
    assert (zarr.open_array(f"{tmp_path}/t").read() == x).all()
    assert zarr.level_downscale([(100, 90), (50, 36), (40, 100)]) == [(1, 1), (2, 2), (2, 1)]


def test_shards_are_read_by_range(tmp_path, monkeypatch):
    x = RND.integers(0, 255, (128, 128)).astype("u1")
    zarr.write_array(f"{tmp_path}/s", x, (128, 128), inner=(16, 16), codec=None)
    read, kept = [], storage.Source.read_at
    monkeypatch.setattr(storage.Source, "read_at", lambda self, at, n: (read.append(n), kept(self, at, n))[1])
    array = zarr.open_array(f"{tmp_path}/s")
    read.clear()
    assert (array.read(slice(20, 30), slice(40, 47)) == x[20:30, 40:47]).all()
    assert sum(read) < 128 * 128 / 4


def test_tiff_without_seeking_and_in_memory():
    class Pipe(io.RawIOBase):
        def __init__(self):
            self.data = b""

        def writable(self):
            return True

        def write(self, b):
            self.data += bytes(b)
            return len(b)

    pages = [RND.integers(0, 255, (20, 30, 3)).astype("u1"), RND.integers(0, 9999, (7, 9)).astype("u2")]
    out = Pipe()
    tiff.write_tiff(out, pages, compression=8)
    codec = registry.get_codec("tiff")
    for data in (out.data, codec.encode(pages)):
        assert all((a == b).all() for a, b in zip(codec.decode(data), pages))


def test_folds_and_frames_in_order(spark):
    x = RND.integers(0, 1000, (40, 6)).astype("i4")
    rows = [(k, "i4", v.tobytes()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "frame int, dtype string, payload binary").repartition(9)
    for f in (np.maximum, np.bitwise_xor, np.add):
        got = frames.fold(df, f, fan_in=3).collect()
        assert len(got) == 1 and (np.frombuffer(got[0].payload, "i4") == f.reduce(x)).all()
    assert frames.fold(df.limit(0), np.add).collect() == []
    assert [r.frame for r in frames.iter_frames(df, "frame")] == list(range(40))


def test_checksums_of_long_data():
    def plain(data):
        x = 0xFFFFFFFF
        for b in data:
            x ^= b
            for _ in range(8):
                x = x >> 1 ^ 0x82F63B78 if x & 1 else x >> 1
        return x ^ 0xFFFFFFFF

    for n in (1, 4095, 4096, 9999):
        data = bytes(RND.integers(0, 256, n, np.uint8))
        assert crc32c(data) == plain(data)
