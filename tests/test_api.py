"""Entry points, CZI and event frames."""

import struct

import numpy as np
import pytest

from tilespark import api
from tilespark.functions.arraycodecs import eer_encode
from tilespark.operators import frames
from tilespark.sources import czi, tiff, zarr

RND = np.random.default_rng(2)


@pytest.mark.parametrize("compression", [0, 5, 6])
def test_czi(spark, tmp_path, compression):
    gray = [RND.integers(0, 999, (8, 10)).astype("u2") for _ in range(3)]
    blocks = [(x, {"Y": (0, 8), "X": (10 * k, 10), "T": (k, 1)}) for k, x in enumerate(gray)]
    blocks.append((gray[0][::2, ::2].copy(), {"Y": (0, 8), "X": (0, 10), "T": (0, 1)}))
    blocks.append((RND.integers(0, 255, (4, 4, 3)).astype("u1"), {"Y": (0, 4), "X": (0, 4), "T": (9, 1)}))
    data = czi.czi_encode(blocks, compression, "<a/>")
    assert czi.czi_metadata(data) == "<a/>"
    (tmp_path / "x.czi").write_bytes(data)
    rows = api.open_pyramid(spark, f"{tmp_path}/x.czi").orderBy("entry").collect()
    assert [r.scale for r in rows] == [1.0, 1.0, 1.0, 2.0, 1.0] and rows[2].axes["T"] == 2 and rows[1].x0 == 10
    for r, (x, _) in zip(rows, blocks):
        assert (np.frombuffer(r.payload, r.dtype).reshape(r.stored_h, r.stored_w, r.samples) == x.reshape(*x.shape[:2], -1)).all()


def test_eer(spark, tmp_path):
    truth, parts, at = [], [], 8
    for k in range(3):
        ys, xs = np.divmod(np.sort(RND.choice(64 * 64, 50, replace=False)), 64)
        truth.append({(int(y), int(x)) for y, x in zip(ys, xs)})
        raw = eer_encode(ys, xs, 7, 2, 64, 64)
        raw += b"\0" * (len(raw) % 2)
        tags = [(256, 64), (257, 64), (259, 65001), (273, at), (277, 1), (278, 64), (279, len(raw))]
        body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
        nxt = at + len(raw) + len(body) + 4
        parts.append((at + len(raw), raw + body + struct.pack("<I", 0)))
        at = nxt
    out = bytearray(struct.pack("<2sHI", b"II", 42, parts[0][0]) + b"".join(p for _, p in parts))
    end = 8
    for k, (_, p) in enumerate(parts):
        end += len(p)
        if k + 1 < len(parts):
            struct.pack_into("<I", out, end - 4, parts[k + 1][0])
    (tmp_path / "x.eer").write_bytes(bytes(out))
    events = api.read(spark, f"{tmp_path}/x.eer")
    got = events.collect()
    for k in range(3):
        assert {(r.y, r.x) for r in got if r.frame == k} == truth[k]
    assert sum(r.v for r in frames.rasterise(events, []).collect()) == 150


def test_read_write_and_regions(spark, tmp_path):
    x = RND.integers(0, 255, (20, 30)).astype("u1")
    for name in ("a.png", "b.bmp", "c.gif", "d.fits", "e.tif"):
        api.write(f"{tmp_path}/{name}", x)
        assert api.read(spark, f"{tmp_path}/{name}").count() == 1
    api.write(f"{tmp_path}/f.zarr", x, chunks=(10, 10))
    assert api.read(spark, f"{tmp_path}/f.zarr").count() == 6
    levels = [RND.integers(0, 99, (64 >> k, 64 >> k)).astype("u2") for k in range(3)]
    tiff.write_tiff(f"{tmp_path}/p.tif", [levels], tile=(16, 16))
    zarr.write_pyramid(f"{tmp_path}/p.zarr", levels, (16, 16))
    for path in (f"{tmp_path}/p.tif", f"{tmp_path}/p.zarr"):
        assert api.levels(path) == [(64, 64), (32, 32), (16, 16)]
        got = api.read_region(path, 1, (4, -4), (0, 9))
        assert (got.reshape(24, 9) == levels[1][4:-4, :9]).all()
    for bad in (lambda: api.read(spark, "x.webp"), lambda: api.write(f"{tmp_path}/x.jp2", x)):
        with pytest.raises(api.BackendUnavailable):
            bad()
    with pytest.raises(ValueError):
        api.read(spark, "x.unknown")


def test_reduce(spark):
    data = [RND.integers(0, 99, 12).astype("u2") for _ in range(5)]
    df = spark.createDataFrame([(bytearray(x.tobytes()), "u2") for x in data], "payload binary, dtype string")
    for how, f in (("max", np.max), ("min", np.min), ("sum", np.sum)):
        assert [r.v for r in api.reduce_frames(df, how).orderBy("pos").collect()] == f(data, axis=0).tolist()
