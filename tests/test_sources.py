"""Containers: what is written is read back, and only what is asked for is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.functions import images, registry
from tilespark.functions.colour import parse_color
from tilespark.operators import pyramid
from tilespark.sources import containers, microscopy, storage, tiff, zarr

RND = np.random.default_rng(1)


def pixels(row):
    return np.frombuffer(row.payload, row.dtype).reshape(row.h, row.w, row.samples)


def assemble(rows, height, width, samples, dtype):
    out = np.zeros((height, width, samples), dtype)
    for r in rows:
        out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = pixels(r)
    return out


@pytest.mark.parametrize("compression", [1, 5, 8, 32773, 50000, 34925])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_pages(tmp_path, compression, tile, big):
    gray, rgb = RND.integers(0, 4096, (50, 70)).astype("u2"), RND.integers(0, 255, (33, 40, 3)).astype("u1")
    path = f"{tmp_path}/x.tif"
    tiff.write_tiff(path, [gray, rgb], tile=tile, compression=compression, predictor=2, big=big)
    read_at = tiff.file_reader(path)
    got = tiff.read_pages(read_at)
    for (_, _, page), want in zip(got, (gray[..., None], rgb)):
        h, w, _ = page.shape
        assert (tiff.read_region(read_at, page, (0, h), (0, w)) == want).all()
        assert (tiff.read_region(read_at, page, (10, 31), (17, 39)) == want[10:31, 17:39]).all()


def test_float_predictor_and_planar(tmp_path):
    x = RND.normal(size=(20, 30)).astype("f4")
    tiff.write_tiff(f"{tmp_path}/f.tif", [x], tile=(16, 16), compression=8, predictor=3)
    read_at = tiff.file_reader(f"{tmp_path}/f.tif")
    page = tiff.read_pages(read_at)[0][2]
    assert (tiff.read_region(read_at, page, (0, 20), (0, 30))[..., 0] == x).all()
    with pytest.raises(ValueError):
        tiff.read_pages(lambda a, n: b"XX" + bytes(n))


@pytest.mark.parametrize("subifds", [True, False])
def test_tiff_source(spark, tmp_path, subifds):
    containers.register(spark)
    levels = [RND.integers(0, 999, (128 >> k, 96 >> k)).astype("u2") for k in range(3)]
    path = f"{tmp_path}/p.tif"
    tiff.write_tiff(path, [levels], tile=(32, 32), compression=50000, subifds=subifds, description=tiff.ome_xml("YX", (128, 96), "u2", ["dapi"], {"X": 0.5}))
    page = tiff.read_pages(tiff.file_reader(path))
    assert 'SizeX="96"' in page[0][2].description and [p.shape[0] for p in tiff.pyramid_levels(page)] == [128, 64, 32]
    df = spark.read.format("tiff").option("path", path).option("tilesPerPartition", 4).load()
    where = "level = 0 and page = 0"
    assert (assemble(df.where(where).collect(), 128, 96, 1, "u2")[..., 0] == levels[0]).all()
    box = pyramid.tile_overlaps(spark.createDataFrame([(40, 70, 10, 33)], "y0 int, y1 int, x0 int, x1 int"), 32, 32)
    assert sorted((r.ty, r.tx) for r in box.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    part = df.where(where + " and y0 >= 32 and y0 < 96 and x0 < 64")
    assert part.count() == 4 and part.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("version,inner", [(2, None), (3, None), (3, (8, 12))])
@pytest.mark.parametrize("codec", [None, "zstd", "gzip"])
def test_zarr(spark, tmp_path, version, inner, codec):
    x = RND.integers(0, 999, (64, 96)).astype("u2")
    x[:16, :24] = 0
    path = f"{tmp_path}/a"
    zarr.write_array(path, x, (16, 24), version=version, codec=codec, inner=inner)
    array = zarr.open_array(path)
    assert (array.read() == x).all() and (array.read(slice(10, 40), slice(-50, None)) == x[10:40, -50:]).all()
    assert array.chunk((0, 0)) is None
    with pytest.raises(ValueError):
        array.read(slice(0, 9, 2))
    containers.register(spark)
    df = spark.read.format("zarr").option("path", path).load()
    rows = df.where("c0 = 1 and c1 <= 1").collect()
    assert sorted((r.c0, r.c1) for r in rows) == [(1, 0), (1, 1)]
    for r in rows:
        assert (np.frombuffer(r.payload, r.dtype).reshape(r.shape) == x[16:32, r.c1 * 24 : r.c1 * 24 + 24]).all()
    assert df.where("not stored").count() == 1


def test_zarr_pyramid(spark, tmp_path):
    levels = [RND.integers(0, 9, (64 >> k, 64 >> k)).astype("u1") for k in range(3)]
    zarr.write_pyramid(f"{tmp_path}/p", levels, (16, 16))
    assert [(a.read() == x).all() for a, x in zip(zarr.open_pyramid(f"{tmp_path}/p"), levels)] == [True] * 3
    containers.register(spark)
    assert spark.read.format("zarr").option("path", f"{tmp_path}/p").load().where("level = 1").count() == 4


def test_fits(spark, tmp_path):
    arrays = [RND.integers(0, 100, (12, 10)).astype(d) for d in ("u1", "i2", "i4", "i8", "f4", "f8", "u2", "u4", "i1")] + [RND.integers(0, 9, (2, 8, 6)).astype("i2")]
    (tmp_path / "x.fits").write_bytes(containers.fits_encode(arrays))
    rows = containers.read_fits(spark, f"{tmp_path}/x.fits").orderBy("hdu").collect()
    assert len(rows) == len(arrays)
    for r, x in zip(rows, arrays):
        assert np.dtype(r.dtype) == x.dtype and (np.frombuffer(r.payload, r.dtype).reshape(r.shape) == x).all()
    head = containers.fits_encode([np.arange(6, dtype="i2").reshape(2, 3)]).replace(b"END" + b" " * 77, b"BSCALE  = 0.5".ljust(80) + b"END" + b" " * 77, 1)
    data = head[:2880] + head[2960:] if len(head) % 2880 else head
    assert next(containers.fits_hdus(data))[1].tolist() == [[0.0, 0.5, 1.0], [1.5, 2.0, 2.5]]


def test_ndtiff_index(spark, tmp_path):
    entries = [({"z": k, "c": "a"}, "f.tif", (k * 100, 8, 6, 1, 0, k * 100 + 96, 4, 0)) for k in range(5)]
    (tmp_path / "NDTiff.index").write_bytes(containers.ndtiff_encode(entries) + b"\xff\xff\xff\xff")
    rows = containers.read_ndtiff_index(spark, f"{tmp_path}/NDTiff.index").orderBy("ordinal").collect()
    assert [(r.axes["z"], r.pixel_offset, r.width) for r in rows] == [(str(k), k * 100, 8) for k in range(5)]


def test_images_and_sink(spark, tmp_path):
    x = RND.integers(0, 255, (9, 7, 3)).astype("u1")
    (tmp_path / "in").mkdir()
    for name, data in (("a.png", images.png_encode(x)), ("b.bmp", images.bmp_encode(x)), ("c.qoi", images.qoi_encode(x)), ("d.gif", images.gif_encode([x[..., 0], x[..., 1]]))):
        (tmp_path / "in" / name).write_bytes(data)
    rows = containers.read_images(spark, f"{tmp_path}/in").collect()
    assert len(rows) == 5
    for r in rows:
        got = np.frombuffer(r.payload, r.dtype).reshape(r.height, r.width, r.channels)
        assert (got == x).all() if not r.path.endswith("gif") else (got[..., 0] == x[..., r.frame]).all()
    frames = spark.createDataFrame([(k, 4, 5, "u2", bytearray(np.full((4, 5), k, "u2").tobytes())) for k in range(3)], "frame long, height int, width int, dtype string, payload binary")
    names = containers.write_frames(frames, str(tmp_path))
    read_at = tiff.file_reader(names[2])
    assert (tiff.read_region(read_at, tiff.read_pages(read_at)[0][2], (0, 4), (0, 5)) == 2).all()


def test_registry(spark):
    assert registry.get_codec("ZLIB").name == "deflate" and registry.get_codec("dxt5").name == "bcn"
    assert registry.has_codec("zstd", "encode") and not registry.has_codec("jxl", "decode") and not registry.has_codec("nope")
    with pytest.raises(KeyError):
        registry.get_codec("nope")
    df = spark.createDataFrame([("a/b.PNG", bytearray(b"\x28\xb5\x2f\xfd")), ("a/b", bytearray(b"\x28\xb5\x2f\xfd")), ("a/b", bytearray(b""))], "path string, head binary")
    assert [r[0] for r in df.select(registry.resolve_codec(F.col("path"), F.col("head"))).collect()] == ["png", "zstd", None]
    with pytest.raises(Exception, match="no backend installed"):
        df.select(registry.decode_bytes(F.col("head"), "webp")).collect()
    assert parse_color("Rec2020_PQ").is_hdr and parse_color(None) is None
    for bad, kind in (("nope", ValueError), (3, TypeError)):
        with pytest.raises(kind):
            parse_color(bad)


@pytest.mark.parametrize("big", [False, True])
def test_files_of_many_pages(tmp_path, monkeypatch, big):
    """What is read of the heads grows with the pages, and small pages share partitions."""
    x = RND.integers(0, 999, (2, 700, 4, 6)).astype("u2")
    for k in range(2):
        tiff.write_tiff(f"{tmp_path}/{k}.tif", list(x[k]), big=big)
    asked = 0

    def counted(path, real=tiff.file_reader):
        read_at = real(path)

        def run(at, n):
            nonlocal asked
            asked += 1
            return read_at(at, n)

        return run

    monkeypatch.setattr(tiff, "file_reader", counted)
    for options, most in (({}, 4), ({"tilesPerPartition": 100}, 14)):
        asked = 0
        reader = tiff.TiffReader({"path": f"{tmp_path}/*.tif", **options})
        parts = reader.partitions()
        assert 1 < len(parts) <= most
        rows = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
        assert asked < 10 * 1400
        got = {(r["path"][-5], r["page"]): r["payload"] for r in rows}
        assert len(rows) == 1400 and got == {(str(k), n): x[k, n].tobytes() for k in range(2) for n in range(700)}
    reader.tests = [("page", tiff.GreaterThanOrEqual, 650)]
    assert sum(run.last - run.first for part in reader.partitions() for run in part.runs) == 100


@pytest.mark.parametrize("streams", [{"a": 7_000_000}, {"a": 9_000_000, "b": 9_000_000, **{f"s/{k}": 60 * k for k in range(400)}}, {f"s/{k}": 900 for k in range(12_000)}])
def test_compound_files_of_many_sectors(streams):
    """Allocation tables beyond the 109 that the head lists."""
    data = {p: RND.bytes(n) for p, n in streams.items()}
    whole = microscopy.compound_encode(data)
    assert len(whole) % 512 == 0
    ole = microscopy.Compound(storage.BytesSource(whole))
    assert set(ole.streams) == set(data)
    assert all(ole.read(p) == x for p, x in data.items())
