"""Queries that write containers from the shared tables and read them back.

An embedding of 64 numbers is an 8 x 8 frame of counts; the frames of a label, in the order
of their numbers, become pages, chunks, sub-blocks or one mosaic of four frames a row.  The
SQL computes from the table alone where every pixel has to be found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tilespark import api
from tilespark.functions import arraycodecs, bytecodecs, checksums, colour, images, registry
from tilespark.operators import frames, pyramid, ranges
from tilespark.plans.array_queries import CELLS, ORACLES, QUERIES, query, table
from tilespark.session import scratch_folder
from tilespark.sources import acquisitions, containers, czi, microscopy, tiff, zarr

RANKED = CELLS + ", k AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS r FROM cells)"
MOSAIC = RANKED + ", m AS (SELECT label, r, 8 * (r // 4) + y AS y, 8 * (r % 4) + x AS x, v FROM k)"
#: Stands where a mosaic or chunk has no frame.
NOTHING = 65535


def _counts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 256)).alias("v"))


def _written(spark, sf_dir, name: str, write) -> str:
    """The folder into which each label's task has called ``write(path, label, counts, floats)``."""
    folder = scratch_folder(spark, name)

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["vec_id"].to_numpy())
        counts, floats = (np.array(rows[c].to_pylist())[order].reshape(-1, 8, 8) for c in ("v", "embedding"))
        label = rows["label"][0].as_py()
        write(f"{folder}/{label}", label, counts.astype("u2"), floats.astype("f4"))
        return pa.table({"label": pa.array([label], pa.int32())})

    _counts(spark, sf_dir).groupBy("label").applyInArrow(run, "label int").collect()
    return folder


def _mosaic(x: np.ndarray) -> np.ndarray:
    rows = -(-len(x) // 4)
    out = np.full((4 * rows, 8, 8), NOTHING, x.dtype)
    out[: len(x)] = x
    return out.reshape(rows, 4, 8, 8).swapaxes(1, 2).reshape(8 * rows, 32)


def _label(path: str = "path", pattern: str = r"/(\d+)\.[a-z0-9]+$") -> Column:
    return F.regexp_extract(path, pattern, 1).cast("int").alias("label")


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.col("v").cast("long")).where(F.col("v") != NOTHING)


# --- TIFF -----------------------------------------------------------------------------
def _tiles(spark, sf_dir) -> DataFrame:
    folder = _written(spark, sf_dir, "mosaic", lambda path, _, x, __: api.write(f"{path}.tif", _mosaic(x), tile=(16, 16), compression=50000, predictor=2))
    return api.read(spark, f"{folder}/*.tif")


def _tile_cells(df: DataFrame) -> DataFrame:
    return _whole(frames.payload_cells(df, F.col("w"), [_label(), "ty", "tx", "y0", "x0"])).drop("c")


_TILE_SQL = MOSAIC + "SELECT label, y // 16 AS ty, x // 16 AS tx, y // 16 * 16 AS y0, x // 16 * 16 AS x0, y % 16 AS y, x % 16 AS x, v FROM m"


@query(_TILE_SQL)
def tiff_tiles(spark, sf_dir):
    """Write and read of tiles, with their places."""
    return _tile_cells(_tiles(spark, sf_dir))


@query(_TILE_SQL + " WHERE y // 16 = 1 AND x < 16")
def tiff_pruned_tiles(spark, sf_dir):
    """Comparisons that the source is given before it reads."""
    return _tile_cells(_tiles(spark, sf_dir).where("ty = 1 and x0 < 16"))


@query(MOSAIC + "SELECT label, level, CAST(y // f AS INT) AS y, CAST(x // f AS INT) AS x, v FROM m, (VALUES (1, 2), (2, 4)) t(level, f) WHERE y % f = 0 AND x % f = 0")
def tiff_levels(spark, sf_dir):
    """Levels of a pyramid, in SubIFDs or in reduced pages."""

    def write(path, label, x, _):
        whole = _mosaic(x)
        tiff.write_tiff(f"{path}.tif", [[whole, whole[::2, ::2], whole[::4, ::4]]], tile=(16, 16), compression=8, subifds=bool(label % 2))

    df = api.open_pyramid(spark, f"{_written(spark, sf_dir, 'levels', write)}/*.tif")
    level = F.greatest("level", "page").alias("level")
    out = frames.payload_cells(df.where("level > 0 or page > 0"), F.col("w"), [_label(), level, "y0", "x0"])
    return _whole(out).select("label", "level", (F.col("y0") + F.col("y")).alias("y"), (F.col("x0") + F.col("x")).alias("x"), "v")


@query(RANKED + "SELECT label, r AS page, y, x, v FROM k WHERE r >= 2 AND r < 7")
def tiff_pages(spark, sf_dir):
    """Pages of classic and large files, of strips under LZW and PackBits."""
    folder = _written(spark, sf_dir, "pages", lambda path, label, x, _: tiff.write_tiff(f"{path}.tif", list(x), compression=(5, 32773)[label % 2], predictor=1 + label % 2, big=label % 3 == 0))
    df = api.read(spark, f"{folder}/*.tif").where("page >= 2 and page < 7")
    return _whole(frames.payload_cells(df, F.col("w"), [_label(), "page"])).drop("c")


@query(RANKED + "SELECT label, r AS page, y, x, CAST(e AS DOUBLE) AS v FROM k")
def tiff_float_pages(spark, sf_dir):
    """Floats under predictor 3."""
    folder = _written(spark, sf_dir, "floats", lambda path, _, __, x: tiff.write_tiff(f"{path}.tif", list(x), compression=8, predictor=3))
    return frames.payload_cells(api.read(spark, f"{folder}/*.tif"), F.col("w"), [_label(), "page"]).drop("c")


@query(
    MOSAIC
    + """, n AS (SELECT label, CAST(max(r) // 4 * 8 + 8 AS BIGINT) AS h FROM m GROUP BY label)
SELECT label, level, h // f AS height, CAST(32 // f AS BIGINT) AS width, 'u2' AS dtype, CAST(8 AS BIGINT) AS compression, CAST(ceil(h // f / 16) * ceil(32 // f / 16) AS BIGINT) AS tiles
FROM n, (VALUES (CAST(0 AS BIGINT), 1), (CAST(1 AS BIGINT), 2)) t(level, f)"""
)
def tiff_info(spark, sf_dir):
    """What the heads of files tell."""

    def write(path, _, x, __):
        tiff.write_tiff(f"{path}.tif", [[_mosaic(x), _mosaic(x)[::2, ::2]]], tile=(16, 16), compression=8)

    found = api.info(spark, f"{_written(spark, sf_dir, 'info', write)}/*.tif")
    return found.select(_label(), "level", "height", "width", "dtype", "compression", "tiles")


@query(CELLS + "SELECT y, x, bit_or(v) AS v, max(v) AS most FROM cells GROUP BY y, x")
def reduce_any_function(spark, sf_dir):
    """Frames of files folded by functions of two arrays."""
    folder = _written(spark, sf_dir, "fold", lambda path, _, x, __: tiff.write_tiff(f"{path}.tif", list(x), compression=50000))

    def folded(reducer, name):
        out = api.reduce_files(spark, f"{folder}/*.tif", reducer)
        return frames.payload_cells(out, F.lit(8), []).select("y", "x", F.col("v").cast("long").alias(name))

    return folded(np.bitwise_or, "v").join(folded(np.maximum, "most"), ["y", "x"])


@query("SELECT label, CAST(count(*) AS BIGINT) AS t, 'uint16' AS kind, '0.5' AS size_x, 'dapi' AS channel FROM embeddings GROUP BY label")
def ome_metadata(spark, sf_dir):
    """OME-XML in a file's description, as Spark's XPath reads it."""

    def described(path, _, x, __):
        tiff.write_tiff(f"{path}.tif", list(x), description=tiff.ome_xml("TYX", x.shape, x.dtype, ["dapi"], {"X": 0.5}))

    folder = _written(spark, sf_dir, "ome", described)
    files = spark.read.format("binaryFile").load(f"{folder}/*.tif").select("path", "content")

    def run(batches):
        for batch in batches:
            rows = [{"path": p, "xml": tiff.read_pages(lambda a, n, d=d: d[a : a + n])[0][2].description} for p, d in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("xml", pa.string())]))

    xml = files.mapInArrow(run, "path string, xml string")
    pixels = "//*[local-name()=\"Pixels\"]/"
    picked = {"t": "@SizeT", "kind": "@Type", "size_x": "@PhysicalSizeX", "channel": "*[local-name()=\"Channel\"]/@Name"}
    return xml.select(_label(), *(F.xpath_string("xml", F.lit(pixels + p)).alias(k) for k, p in picked.items())).withColumn("t", F.col("t").cast("long"))


# --- Zarr -----------------------------------------------------------------------------
_VARIANTS = [
    {"version": 2, "codec": "zstd", "order": "F"},
    {"version": 2, "codec": "zlib", "filters": ({"id": "delta", "dtype": "<u2"},)},
    {"version": 2, "codec": "lz4", "filters": ({"id": "shuffle", "elementsize": 2},)},
    {"version": 3, "codec": "gzip", "checksum": True},
    {"version": 3, "codec": "zstd", "inner": (2, 2, 4)},
    {"version": 3, "codec": None},
    {"version": 2, "codec": "bz2"},
    {"version": 2, "codec": "brotli"},
]


def _arrays(spark, sf_dir) -> str:
    return _written(spark, sf_dir, "arrays", lambda path, label, x, _: zarr.write_array(path, x, (4, 4, 8), fill=NOTHING, **_VARIANTS[label % len(_VARIANTS)]))


@query(RANKED + "SELECT label, r // 4 AS c0, y // 4 AS c1, r % 4 AS z, y % 4 AS y, x, v FROM k")
def zarr_chunks(spark, sf_dir):
    """Chunks of both versions, with filters, Fortran order, checksums and shards."""
    folder = _arrays(spark, sf_dir)
    labels = [r.label for r in table(spark, sf_dir, "embeddings").select("label").distinct().collect()]
    out = None
    for label in labels:
        one = api.read(spark, f"{folder}/{label}", format="zarr").withColumn("label", F.lit(label))
        out = one if out is None else out.union(one)
    cells = frames.payload_cells(out, F.lit(8), ["label", "c0", "c1"])
    return _whole(cells).select("label", "c0", "c1", F.floor(F.col("y") / 4).cast("int").alias("z"), (F.col("y") % 4).alias("y"), "x", "v")


@query(RANKED + "SELECT label, r AS z, y, x, v FROM k WHERE r >= 3 AND r < 9 AND y >= 2 AND y < 7 AND x >= 1 AND x < 6")
def zarr_region(spark, sf_dir):
    """Regions, read by the ranges of the chunks and inner chunks that they meet."""
    folder = _arrays(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()

    def run(batches):
        for batch in batches:
            for label in batch.column(0).to_pylist():
                x = zarr.open_array(f"{folder}/{label}").read(slice(3, 9), slice(2, 7), slice(1, 6))
                z, y, c = np.indices(x.shape, np.int32).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(x.size, label, np.int32)), pa.array(z + 3), pa.array(y + 2), pa.array(c + 1), pa.array(x.ravel().astype(np.int64))], names=["label", "z", "y", "x", "v"])

    return labels.mapInArrow(run, "label int, z int, y int, x int, v long")


@query(MOSAIC + "SELECT label, level, CAST(y // f AS INT) AS y, CAST(x // f AS INT) AS x, v FROM m, (VALUES (0, 1), (1, 2)) t(level, f) WHERE y % f = 0 AND x % f = 0")
def zarr_pyramid(spark, sf_dir):
    """Levels of OME-Zarr groups."""
    folder = _written(spark, sf_dir, "groups", lambda path, _, x, __: zarr.write_pyramid(f"{path}.zarr", [_mosaic(x), _mosaic(x)[::2, ::2]], (16, 16), fill=NOTHING))
    labels = [r.label for r in table(spark, sf_dir, "embeddings").select("label").distinct().collect()]
    out = None
    for label in labels:
        one = api.open_pyramid(spark, f"{folder}/{label}.zarr").withColumn("label", F.lit(label))
        out = one if out is None else out.union(one)
    cells = frames.payload_cells(out, F.lit(16), ["label", "level", "c0", "c1"])
    return _whole(cells).select("label", "level", (F.col("c0") * 16 + F.col("y")).alias("y"), (F.col("c1") * 16 + F.col("x")).alias("x"), "v")


# --- FITS, NDTiff, CZI, LIF, GIF ------------------------------------------------------
@query(RANKED + "SELECT label, CAST(hdu AS BIGINT) AS hdu, r AS z, y, x, CASE WHEN hdu = 0 THEN CAST(v AS DOUBLE) ELSE CAST(e AS DOUBLE) END AS v FROM k, (VALUES (0), (1)) t(hdu)")
def fits_images(spark, sf_dir):
    """Unsigned integers and floats in the units of a file."""

    def write(path, _, x, f):
        with open(f"{path}.fits", "wb") as out:
            out.write(containers.fits_encode([x, f]))

    df = api.read(spark, f"{_written(spark, sf_dir, 'fits', write)}/*.fits")
    cells = frames.payload_cells(df, F.lit(8), [_label(), "hdu"])
    return cells.select("label", "hdu", F.floor(F.col("y") / 8).cast("int").alias("z"), (F.col("y") % 8).alias("y"), "x", "v")


def _acquisitions(spark, sf_dir) -> str:
    def write(path, label, x, _):
        axes = ({"z": k % 3, "t": k // 3} for k in range(len(x)))
        acquisitions.write_ndtiff(path, zip(axes, x), compression=(1, 8)[label % 2], limit=4000)

    return _written(spark, sf_dir, "ndtiff", write)


@query("SELECT label, r AS ordinal, CAST(r % 3 AS INT) AS z, CAST(r // 3 AS INT) AS t, CAST(8 AS BIGINT) AS width, CAST(8 AS BIGINT) AS height, CAST(1 AS BIGINT) AS pixel_type FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings)")
def ndtiff_index(spark, sf_dir):
    index = containers.read_ndtiff_index(spark, f"{_acquisitions(spark, sf_dir)}/*/NDTiff.index")
    axis = {k: F.col("axes").getItem(k).cast("int").alias(k) for k in "zt"}
    return index.select(_label(pattern=r"/(\d+)/NDTiff\.index$"), "ordinal", axis["z"], axis["t"], "width", "height", "pixel_type")


@query(RANKED + "SELECT label, CAST(r // 3 AS INT) AS t, y, x, v FROM k WHERE r % 3 = 1")
def ndtiff_frames(spark, sf_dir):
    """Frames by their axes, each read by its range."""
    folder = _acquisitions(spark, sf_dir)
    labels = [r.label for r in table(spark, sf_dir, "embeddings").select("label").distinct().collect()]
    out = None
    for label in labels:
        index = containers.read_ndtiff_index(spark, f"{folder}/{label}/NDTiff.index").where(F.col("axes").getItem("z") == "1")
        one = acquisitions.ndtiff_frames(index, f"{folder}/{label}").withColumn("label", F.lit(label))
        out = one if out is None else out.union(one)
    return _whole(frames.payload_cells(out, F.lit(8), ["label", F.col("axes").getItem("t").cast("int").alias("t")])).drop("c")


@query(RANKED + "SELECT label, y, x, sum(v) AS v, count(*) AS frames FROM k GROUP BY label, y, x")
def ndtiff_files_are_tiffs(spark, sf_dir):
    """The data files of acquisitions, read as any other TIFF."""
    df = api.read(spark, f"{_acquisitions(spark, sf_dir)}/*/NDTiffStack*.tif", format="tiff")
    cells = frames.payload_cells(df, F.col("w"), [_label(pattern=r"/(\d+)/NDTiffStack[^/]*$")])
    return cells.groupBy("label", "y", "x").agg(F.sum("v").cast("long").alias("v"), F.count(F.lit(1)).alias("frames"))


def _czi(spark, sf_dir) -> DataFrame:
    def write(path, label, x, _):
        blocks = [(f, {"Y": (8 * (k // 4), 8), "X": (8 * (k % 4), 8), "S": (k % 2, 1)}) for k, f in enumerate(x)]
        with open(f"{path}.czi", "wb") as out:
            out.write(czi.czi_encode(blocks, compression=(0, 5, 6)[label % 3]))

    return api.read(spark, f"{_written(spark, sf_dir, 'czi', write)}/*.czi")


@query(RANKED + "SELECT label, CAST(r AS BIGINT) AS entry, CAST(r % 2 AS BIGINT) AS scene, CAST(8 * (r // 4) AS BIGINT) AS y0, CAST(8 * (r % 4) AS BIGINT) AS x0, y, x, v FROM k")
def czi_subblocks(spark, sf_dir):
    cells = frames.payload_cells(_czi(spark, sf_dir), F.col("stored_w"), [_label(), "entry", F.col("axes").getItem("S").alias("scene"), "y0", "x0"])
    return _whole(cells).drop("c")


@query(
    MOSAIC
    + """, g AS (SELECT l AS label, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT label AS l FROM embeddings), range(4, 60) t(y), range(3, 40) s(x))
SELECT g.label, g.y, g.x, coalesce(m.v, 0) AS v FROM g LEFT JOIN m ON m.label = g.label AND m.y = g.y AND m.x = g.x"""
)
def czi_region(spark, sf_dir):
    """A region put together from sub-blocks; gaps and what lies beyond are zero."""
    cells = _whole(frames.payload_cells(_czi(spark, sf_dir).where("scale = 1"), F.col("stored_w"), [_label(), "entry", "y0", "x0"]))
    cells = cells.select("label", "entry", (F.col("y0") + F.col("y")).cast("int").alias("y"), (F.col("x0") + F.col("x")).cast("int").alias("x"), "v")
    return pyramid.paste(cells, "entry", (4, 60), (3, 40), ["label"])


@query(RANKED + "SELECT label, 'series' || label AS name, r AS z, y, x, v FROM k")
def lif_images(spark, sf_dir):
    def write(path, label, x, _):
        dims = "".join(f'<DimensionDescription DimID="{k + 1}" NumberOfElements="{n}" BytesInc="{b}"/>' for k, (n, b) in enumerate(((8, 2), (8, 16), (len(x), 128))))
        image = f'<Element Name="series{label}"><Data><Image><ImageDescription><Channels><ChannelDescription Resolution="16" BytesInc="0"/></Channels><Dimensions>{dims}</Dimensions></ImageDescription></Image></Data><Memory Size="{x.nbytes}" MemoryBlockID="M1"/></Element>'
        with open(f"{path}.lif", "wb") as out:
            out.write(acquisitions.lif_encode(f"<LMSDataContainerHeader>{image}</LMSDataContainerHeader>", {"M1": x.tobytes()}))

    df = api.read(spark, f"{_written(spark, sf_dir, 'lif', write)}/*.lif")
    cells = _whole(frames.payload_cells(df, F.lit(8), [_label(), "name"]))
    return cells.select("label", "name", F.floor(F.col("y") / 8).cast("int").alias("z"), (F.col("y") % 8).alias("y"), "x", "v")


def _gifs(spark, sf_dir) -> DataFrame:
    def write(path, _, x, __):
        api.write(f"{path}.png", (x[0] % 256).astype("u1"))
        with open(f"{path}.gif", "wb") as out:
            out.write(images.gif_encode(list((x % 256).astype("u1"))))

    return api.read(spark, f"{_written(spark, sf_dir, 'gif', write)}/*.gif")


@query(RANKED + "SELECT label, r AS frame, y, x, v % 256 AS v FROM k")
def gif_frames(spark, sf_dir):
    df = _gifs(spark, sf_dir)
    cells = df.select("path", "frame", F.col("width").alias("w"), "channels", F.posexplode(frames.values("payload", "dtype")).alias("pos", "v")).where("pos % channels = 0")
    pixel = F.floor(F.col("pos") / F.col("channels"))
    return cells.select(_label(), F.col("frame").cast("int").alias("frame"), F.floor(pixel / F.col("w")).cast("int").alias("y"), (pixel % F.col("w")).cast("int").alias("x"), F.col("v").cast("long").alias("v"))


@query("SELECT label, count(*) AS frames FROM embeddings GROUP BY label")
def frame_count(spark, sf_dir):
    return frames.frame_count(_gifs(spark, sf_dir).select(_label()), ["label"])


def _stored(spark, sf_dir, name: str, encode) -> str:
    """The folder of one file ``<label>.<name>`` for each label."""

    def write(path, label, x, _):
        with open(f"{path}.{name}", "wb") as out:
            out.write(encode(label, x))

    return _written(spark, sf_dir, name, write)


def _axis(name: str) -> Column:
    return F.col("axes").getItem(name).cast("int").alias(name)


@query(RANKED + "SELECT label, r AS frame, y, x, v FROM k")
def nd2_frames(spark, sf_dir):
    """Frames by the map of chunks, packed and plain."""
    folder = _stored(spark, sf_dir, "nd2", lambda label, x: microscopy.nd2_encode(list(x), packed=bool(label % 2)))
    df = api.read(spark, f"{folder}/*.nd2")
    return _whole(frames.payload_cells(df, F.col("width"), [_label(), F.col("frame").cast("int").alias("frame")])).drop("c")


def _oib(spark, sf_dir) -> str:
    return _stored(spark, sf_dir, "oib", lambda _, x: microscopy.oib_encode({(k % 2, k // 2 % 3, k // 6): f for k, f in enumerate(x)}))


@query(RANKED + "SELECT label, CAST(r % 2 AS INT) AS c, CAST(r // 2 % 3 AS INT) AS z, CAST(r // 6 AS INT) AS t, y, x, v FROM k")
def oib_planes(spark, sf_dir):
    """Planes in the streams of compound files, by channel, depth and time."""
    df = api.read(spark, f"{_oib(spark, sf_dir)}/*.oib").select("path", "payload", "dtype", "width", _axis("c").alias("channel"), _axis("z"), _axis("t"))
    cells = _whole(frames.payload_cells(df, F.col("width"), [_label(), "channel", "z", "t"]))
    return cells.select("label", F.col("channel").alias("c"), "z", "t", "y", "x", "v")


@query("SELECT label, count(*) + 2 AS streams FROM embeddings GROUP BY label")
def ole_streams(spark, sf_dir):
    return microscopy.list_streams(spark, f"{_oib(spark, sf_dir)}/*.oib").groupBy(_label()).agg(F.count(F.lit(1)).alias("streams"))


@query(RANKED + "SELECT label, CAST(r // 16 AS INT) AS file, CAST(r % 16 AS INT) AS plane, y, x, v FROM k")
def vsi_planes(spark, sf_dir):
    """Planes of the companions of an index, found by its name."""

    def write(path, label, x, _):
        import os

        api.write(f"{path}.vsi", x[0], format="tiff")
        for k in range(0, len(x), 16):
            folder = f"{path.rpartition('/')[0]}/_{label}_/stack{10000 + k // 16}"
            os.makedirs(folder)
            with open(f"{folder}/frame_t_0.ets", "wb") as out:
                out.write(microscopy.ets_encode(x[k : k + 16]))

    df = api.read(spark, f"{_written(spark, sf_dir, 'vsi', write)}/*.vsi")
    return _whole(frames.payload_cells(df, F.col("width"), [_label(), _axis("file"), _axis("plane")])).drop("c")


# --- images and array codecs ----------------------------------------------------------
def _coded(name: str, encode, decode, dtype: str, shape: tuple[int, ...], head: str) -> None:
    """Frame by frame: the first bytes of what is stored, and the numbers that come back."""
    here = encode
    there = decode

    def run(spark, sf_dir):
        @arrow_udf("binary")
        def pack(v: pa.Array) -> pa.Array:
            return pa.array([here(np.asarray(x.values).astype(dtype).reshape(shape)) for x in v], pa.binary())

        @arrow_udf("array<bigint>")
        def unpack(v: pa.Array) -> pa.Array:
            return pa.array([np.asarray(there(x)).astype(np.int64).ravel() for x in v.to_pylist()], pa.list_(pa.int64()))

        df = _counts(spark, sf_dir).select("vec_id", pack("v").alias("coded"))
        first = F.lower(F.hex(F.substring("coded", 1, len(head) // 2))).alias("head")
        return df.select("vec_id", first, F.posexplode(unpack("coded")).alias("pos", "v"))

    most = 65536 if dtype == "u2" else 256
    query(CELLS + f"SELECT vec_id, '{head}' AS head, 8 * y + x AS pos, v % {most} AS v FROM cells", name)(run)


_coded("image_png", images.png_encode, images.png_decode, "u2", (8, 8), "89504e470d0a1a0a0000000d49484452000000080000000810")
_coded("image_bmp", images.bmp_encode, lambda b: images.bmp_decode(b), "u1", (8, 2, 4), "424d")
_coded("image_qoi", images.qoi_encode, images.qoi_decode, "u1", (4, 4, 4), "716f69660000000400000004")
_coded("array_npy", arraycodecs.npy_encode, arraycodecs.npy_decode, "u2", (8, 8), "934e554d50590100")
_coded("dicom_rle", arraycodecs.dicomrle_encode, lambda b: acquisitions.decode_frame(b, "1.2.840.10008.1.2.5", (8, 8), "u2"), "u2", (8, 8), "0200000040000000")
_coded("dicom_plain", lambda x: x.tobytes(), lambda b: acquisitions.decode_frame(b, "1.2.840.10008.1.2.1", (8, 8), "u2"), "u2", (8, 8), "")
_coded("rice_cells", arraycodecs.rice_encode, lambda b: arraycodecs.rice_decode(b, "u2"), "u2", (64,), "800000002000000002000000")
_coded("bitshuffle_cells", lambda x: arraycodecs.bitshuffle_encode(x.tobytes(), 2), lambda b: np.frombuffer(arraycodecs.bitshuffle_decode(b, 2), "u2"), "u2", (64,), "")
_coded("packints_cells", lambda x: arraycodecs.packints_encode(x, 13), lambda b: arraycodecs.packints_decode(b, "u2", 13, 64), "u2", (64,), "")


def _hexed(name: str, sql: str, f, dtype: str) -> None:
    """Frame by frame: the bytes that are stored, as hex."""

    def run(spark, sf_dir):
        @arrow_udf("binary")
        def pack(v: pa.Array) -> pa.Array:
            return pa.array([f(np.asarray(x.values).astype(dtype)) for x in v], pa.binary())

        return _counts(spark, sf_dir).select("vec_id", F.lower(F.hex(pack("v"))).alias("bytes"))

    query(CELLS + sql, name)(run)


_hexed("bmp_rows", "SELECT vec_id, string_agg(printf('%02x', v % 256), '' ORDER BY y DESC, x) AS bytes FROM cells GROUP BY vec_id", lambda v: images.bmp_encode(v.reshape(8, 8))[54 + 1024 :], "u1")
_hexed("npy_body", "SELECT vec_id, string_agg(printf('%02x%02x', v % 256, v // 256), '' ORDER BY y, x) AS bytes FROM cells GROUP BY vec_id", lambda v: arraycodecs.npy_encode(v)[-128:], "<u2")
_hexed(
    "bitshuffle_planes",
    ", p AS (SELECT vec_id, b, y, sum(((v % 256) >> b & 1) << x) AS byte FROM cells, (SELECT CAST(b AS INT) AS b FROM range(8) t(b)) GROUP BY vec_id, b, y) SELECT vec_id, string_agg(printf('%02x', CAST(byte AS INT)), '' ORDER BY b, y) AS bytes FROM p GROUP BY vec_id",
    lambda v: arraycodecs.bitshuffle_encode(v.tobytes(), 1, 64),
    "u1",
)
_hexed(
    "floatpred_planes",
    ", d AS (SELECT vec_id, x, y, v % 256 AS lo, v // 256 AS hi FROM cells), e AS (SELECT vec_id, x, y, (lo - coalesce(lag(lo) OVER w, 0) + 256) % 256 AS lo, (hi - coalesce(lag(hi) OVER w, 0) + 256) % 256 AS hi FROM d WINDOW w AS (PARTITION BY vec_id, y ORDER BY x)) SELECT vec_id, string_agg(CASE p WHEN 0 THEN printf('%02x', lo) ELSE printf('%02x', hi) END, '' ORDER BY y, p, x) AS bytes FROM e, (VALUES (0), (1)) t(p) GROUP BY vec_id",
    lambda v: arraycodecs.floatpred_encode(v.view("<f2").reshape(8, 8)),
    "<u2",
)
_hexed(
    "predictor3_planes",
    ", b AS (SELECT vec_id, y, CASE p WHEN 0 THEN v // 256 ELSE v % 256 END AS byte, p * 8 + x AS place FROM cells, (VALUES (0), (1)) t(p)), d AS (SELECT vec_id, y, place, (byte - coalesce(lag(byte) OVER (PARTITION BY vec_id, y ORDER BY place), 0) + 256) % 256 AS byte FROM b) SELECT vec_id, string_agg(printf('%02x', byte), '' ORDER BY y, place) AS bytes FROM d GROUP BY vec_id",
    lambda v: arraycodecs.predictor3_encode(v.view("<f2").reshape(8, 8, 1)),
    "<u2",
)


def _runs(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (3 + e % 120).alias("n"), (65 + F.col("user_id") % 26).alias("c"), (e % 60000).alias("v"))


def _on_numbers(f):
    @arrow_udf("binary")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.binary())

    return run


@query("SELECT event_id, printf('%02x%02x', CAST(257 - (3 + event_id % 120) AS INT), CAST(65 + user_id % 26 AS INT)) AS bytes FROM events")
def packbits_runs(spark, sf_dir):
    f = _on_numbers(lambda n, c: bytecodecs.ENCODE["packbits"](bytes((c,)) * n, None))
    return _runs(spark, sf_dir).select("event_id", F.lower(F.hex(f("n", "c"))).alias("bytes"))


@query("SELECT event_id, '80' AS clear, repeat(chr(CAST(65 + user_id % 26 AS INT)), CAST(3 + event_id % 120 AS INT)) AS text FROM events")
def tiff_lzw_runs(spark, sf_dir):
    pack, unpack = _on_numbers(lambda n, c: bytecodecs.lzw_encode(bytes((c,)) * n)), _on_numbers(lambda x, _: bytecodecs.lzw_decode(x))
    df = _runs(spark, sf_dir).withColumn("coded", pack("n", "c"))
    return df.select("event_id", F.lower(F.hex(F.substring("coded", 1, 1))).alias("clear"), F.decode(unpack("coded", F.lit(0)), "US-ASCII").alias("text"))


@query("SELECT event_id, printf('%04x00', CAST(event_id % 60000 AS INT)) AS bytes FROM events")
def rice_even_blocks(spark, sf_dir):
    """A block of one value: the value, and a code of four bits for "no differences"."""
    f = _on_numbers(lambda v, _: arraycodecs.rice_encode(np.full(32, v, "u2"))[12:])
    return _runs(spark, sf_dir).select("event_id", F.lower(F.hex(f("v", "n"))).alias("bytes"))


@query(
    """WITH e AS (SELECT event_id, CAST(event_id % 256 AS INT) AS a, CAST(user_id % 256 AS INT) AS b FROM events)
SELECT event_id, CAST(p AS INT) AS pos, CAST(CASE WHEN p % 8 = 0 THEN a WHEN p % 8 = 1 THEN b WHEN a > b THEN ((8 - p % 8) * a + (p % 8 - 1) * b) // 7
  WHEN p % 8 < 6 THEN ((6 - p % 8) * a + (p % 8 - 1) * b) // 5 WHEN p % 8 = 6 THEN 0 ELSE 255 END AS BIGINT) AS v FROM e, range(16) t(p)"""
)
def bc4_ramps(spark, sf_dir):
    """Blocks whose pixels take the eight steps of the ramp one after the other."""
    steps = sum(k << 3 * k for k in range(8)).to_bytes(3, "little") * 2

    @arrow_udf("array<bigint>")
    def unpack(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([arraycodecs.bcn_decode(bytes((x, y)) + steps, "bc4", 4, 4).ravel().astype(np.int64) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.list_(pa.int64()))

    df = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 256).alias("a"), (F.col("user_id") % 256).alias("b"))
    return df.select("event_id", F.posexplode(unpack("a", "b")).alias("pos", "v"))


@query(CELLS + ", b AS (SELECT vec_id, 8 * y + x AS pos, v % 256 AS v FROM cells) SELECT m.vec_id, CAST(m.pos // 4 AS INT) AS x, CAST(m.pos % 4 AS INT) AS c, CASE WHEN e.v = 0 THEN 0.0 ELSE m.v * pow(2.0, e.v - 136) END AS v FROM b m JOIN b e ON m.vec_id = e.vec_id AND m.pos // 4 = e.pos // 4 AND m.pos % 4 < 3 AND e.pos % 4 = 3")
def rgbe_pictures(spark, sf_dir):
    """Radiance pictures with run-length coded rows, as floats."""

    @arrow_udf("array<double>")
    def through(v: pa.Array) -> pa.Array:
        return pa.array([arraycodecs.rgbe_file_decode(arraycodecs.rgbe_file_encode(np.asarray(x.values).astype("u1").reshape(1, 16, 4))).astype(float).ravel() for x in v], pa.list_(pa.float64()))

    df = _counts(spark, sf_dir).select("vec_id", F.posexplode(through("v")).alias("pos", "v"))
    return df.select("vec_id", F.floor(F.col("pos") / 3).cast("int").alias("x"), (F.col("pos") % 3).alias("c"), "v")


def _electrons(spark, sf_dir, finer: int) -> DataFrame:
    e = F.col("event_id")
    pixels = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("frame"), (e % 4096).alias("p"))
    pixels = pixels.groupBy("frame").agg(F.array_sort(F.collect_set("p")).alias("p"))

    @arrow_udf("array<struct<y:bigint,x:bigint>>")
    def through(v: pa.Array) -> pa.Array:
        out = []
        for p in v:
            p = np.asarray(p.values)
            y, x = arraycodecs.eer_events(arraycodecs.eer_encode(p // 64, p % 64, 7, 2, 64, 64), 7, 2, 64, 64, finer=finer)
            out.append([{"y": a, "x": b} for a, b in zip(y.tolist(), x.tolist())])
        return pa.array(out, pa.list_(pa.struct([("y", pa.int64()), ("x", pa.int64())])))

    return pixels.select("frame", F.explode(through("p")).alias("e")).select("frame", "e.y", "e.x")


_ELECTRONS = "SELECT DISTINCT CAST(user_id % 10 AS INT) AS frame, event_id % 4096 // 64 AS y, event_id % 64 AS x FROM events"


@query(_ELECTRONS)
def eer_electrons(spark, sf_dir):
    return _electrons(spark, sf_dir, 0)


@query(f"SELECT frame, 2 * y + 1 AS y, 2 * x + 1 AS x FROM ({_ELECTRONS})")
def eer_parts_of_pixels(spark, sf_dir):
    """Electrons without an offset lie past the middle of their pixels."""
    return _electrons(spark, sf_dir, 1)


# --- registry, from fixed values ------------------------------------------------------
def _listed(spark, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Named colours as (primaries, transfer, whether high dynamic range).
@query(
    """SELECT * FROM (VALUES ('srgb', 1, 13, false), ('srgb-linear', 1, 8, false), ('linear-srgb', 1, 8, false), ('linear', 1, 8, false), ('display-p3', 11, 13, false), ('p3', 11, 13, false), ('p3-linear', 11, 8, false), ('rec709', 1, 1, false),
('bt709', 1, 1, false), ('rec2020-pq', 9, 16, true), ('bt2020-pq', 9, 16, true), ('rec2020-hlg', 9, 18, true), ('bt2020-hlg', 9, 18, true), ('rec2020-linear', 9, 8, false), ('bt2020-linear', 9, 8, false)) t(name, primaries, transfer, hdr)"""
)
def parse_color(spark, sf_dir):
    """All names, written in capitals and with underscores."""
    found = [(n, colour.parse_color(n.upper().replace("-", "_"))) for n in colour.SPECS]
    return _listed(spark, [(n, c.primaries, c.transfer, c.is_hdr) for n, c in found], "name string, primaries int, transfer int, hdr boolean")


# Aliases and the codecs that they name.
@query(
    """SELECT * FROM (VALUES ('JPEGXL', 'jxl'), ('jpeg-xl', 'jxl'), ('zlib', 'deflate'), ('jpg', 'jpeg'), ('J2K', 'jpeg2k'), ('jp2', 'jpeg2k'), ('heic', 'heif'), ('jls', 'jpegls'), ('charls', 'jpegls'), ('openjph', 'htj2k'), ('xz', 'lzma'), ('bzip2', 'bz2'), ('npy', 'numpy'),
('float-pred', 'floatpred'), ('bc7', 'bcn'), ('dxt5', 'bcn'), ('rice', 'rcomp'), ('dicom-rle', 'dicomrle'), ('hdf', 'hdf5'), ('oif', 'oib'), ('bshuf', 'bitshuffle'), ('bigtiff', 'tiff'), ('pco', 'pcodec'), ('szip', 'aec'), ('blosc2nd', 'b2nd'), ('nothing', NULL)) t(alias, name)"""
)
def get_codec(spark, sf_dir):
    asked = ["JPEGXL", "jpeg-xl", "zlib", "jpg", "J2K", "jp2", "heic", "jls", "charls", "openjph", "xz", "bzip2", "npy", "float-pred", "bc7", "dxt5", "rice", "dicom-rle", "hdf", "oif", "bshuf", "bigtiff", "pco", "szip", "blosc2nd", "nothing"]
    return _listed(spark, [(a, registry.get_codec(a).name if registry.has_codec(a) else None) for a in asked], "alias string, name string")


# Codecs of the catalogue whose libraries are not installed.
@query("SELECT * FROM (VALUES ('aec'), ('avif'), ('b2nd'), ('blosc2'), ('brunsli'), ('cms'), ('hdf5'), ('heif'), ('htj2k'), ('jpeg'), ('jpeg2k'), ('jpegls'), ('jxl'), ('lerc'), ('mozjpeg'), ('oir'), ('pcodec'), ('sperr'), ('sz3'), ('webp'), ('zfp')) t(name)")
def absent_backends(spark, sf_dir):
    """Codecs that raise with a clear message when they are used."""
    return registry.list_codecs(spark).where("not encodes and not decodes").select("name")


# First bytes and the codecs that they tell.
_HEADS = (
    ("FF0A", "jxl"), ("0000000C4A584C20", "jxl"), ("716F6966", "qoi"), ("28B52FFD", "zstd"), ("04224D18", "lz4"), ("4C6572633220", "lerc"), ("7A6670", "zfp"), ("535A334F", "sz3"), ("53505252", "sperr"), ("0A0442D2", "brunsli"),
    ("50434F4F", "pcodec"), ("789C", "deflate"), ("7801", "deflate"), ("FFD8FF", "jpeg"), ("524946460000000057454250", "webp"), ("0000000C6A5020200D0A870A", "jpeg2k"), ("FF4FFF51", "jpeg2k"), ("0000001C6674797061766966", "avif"),
    ("0000001C6674797068656963", "heif"), ("FD377A585A00", "lzma"), ("425A6839", "bz2"), ("934E554D5059", "numpy"), ("474946383961", "gif"), ("474946383761", "gif"), ("894844460D0A1A0A", "hdf5"), ("5A495352415746494C45", "czi"),
    ("DACEBE0A", "nd2"), ("70000000", "lif"), ("D0CF11E0A1B11AE1", "oib"), ("4F4C594D505553524157464F524D4154", "oir"), ("424D", "bmp"), ("89504E470D0A1A0A", "png"), ("49492B00", "tiff"), ("4D4D002B", "tiff"), ("0011", None),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{h}', {'NULL' if n is None else repr(n)})" for h, n in _HEADS) + ") t(head, name)")
def codec_for_heads(spark, sf_dir):
    df = _listed(spark, [(h,) for h, _ in _HEADS], "head string")
    return df.select("head", registry.codec_for_bytes(F.concat(F.unhex("head"), F.unhex(F.lit("00" * 40)))).alias("name"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'bmp' WHEN 1 THEN 'png' WHEN 2 THEN 'zstd' ELSE NULL END AS name FROM documents")
def resolve_codec(spark, sf_dir):
    """The name given, else the suffix, else the first bytes."""
    n = F.col("doc_id") % 4
    path = F.when(n < 2, F.lit("a/b.png")).otherwise(F.lit("a/b"))
    head = F.unhex(F.when(n < 3, F.lit("28B52FFD00")).otherwise(F.lit("0011")))
    return table(spark, sf_dir, "documents").select("doc_id", registry.resolve_codec(path, head, F.when(n == 0, F.lit("BMP"))).alias("name"))


@query("SELECT c_custkey, reverse(c_name) AS coded, c_name AS plain FROM customer")
def register_codec(spark, sf_dir):
    """A user's codec."""
    registry.register_codec(registry.Codec("backwards", encode=lambda b, _=None: b[::-1], decode=lambda b: b[::-1]))
    try:
        coded = registry.encode_bytes(F.encode("c_name", "UTF-8"), "backwards")
        out = table(spark, sf_dir, "customer").select("c_custkey", F.decode(coded, "UTF-8").alias("coded"), F.decode(registry.decode_bytes(coded, "backwards"), "UTF-8").alias("plain"))
    finally:
        registry.CODECS[:] = [c for c in registry.CODECS if c.name != "backwards"]
    return out


@query("SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN '28b52ffd' ELSE '425a6839' END AS head, text FROM documents")
def codecs_in_sql(spark, sf_dir):
    """Codecs as functions of SQL."""
    registry.register_functions(spark)
    name = f"documents_{abs(hash(sf_dir))}"
    table(spark, sf_dir, "documents").createOrReplaceTempView(name)
    coded = f"SELECT doc_id, if(doc_id % 2 = 0, 'zstd', 'bz2') AS codec, codec_encode(encode(text, 'UTF-8'), if(doc_id % 2 = 0, 'zstd', 'bz2')) AS coded FROM {name}"
    return spark.sql(f"SELECT doc_id, lower(hex(substring(coded, 1, 4))) AS head, decode(codec_decode(coded, codec), 'UTF-8') AS text FROM ({coded})")


# Published checksums.
@query("SELECT * FROM (VALUES ('313233343536373839', 'e3069283'), (repeat('00', 32), '8a9136aa'), (repeat('ff', 32), '62a8ab43'), ('', '00000000')) t(data, crc)")
def crc32c(spark, sf_dir):
    @arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([f"{checksums.crc32c(x):08x}" for x in v.to_pylist()])

    df = _listed(spark, [("313233343536373839",), ("00" * 32,), ("ff" * 32,), ("",)], "data string")
    return df.select("data", run(F.unhex("data")).alias("crc"))


# --- responses, axes and ranges -------------------------------------------------------
@query("SELECT page_id, CAST(p AS INT) AS part, CASE p WHEN 0 THEN 'text/plain' ELSE 'text/html' END AS kind, CASE p WHEN 0 THEN url ELSE html END AS content FROM pages, range(2) t(p)")
def multipart_parts(spark, sf_dir):
    """Parts of multipart responses, with their heads."""

    @arrow_udf("array<struct<kind:string,content:binary>>")
    def split(v: pa.Array) -> pa.Array:
        found = [acquisitions.multipart(x, 'multipart/related; type="text/html"; boundary="b0und"') for x in v.to_pylist()]
        return pa.array([[{"kind": h["content-type"], "content": c} for h, c in parts] for parts in found], pa.list_(pa.struct([("kind", pa.string()), ("content", pa.binary())])))

    body = F.concat(F.lit("--b0und\r\nContent-Type: text/plain\r\n\r\n"), "url", F.lit("\r\n--b0und\r\ncontent-type:text/html\r\nX: y\r\n\r\n"), "html", F.lit("\r\n--b0und--\r\n"))
    df = table(spark, sf_dir, "pages").select("page_id", F.posexplode(split(F.encode(body, "UTF-8"))).alias("part", "x"))
    return df.select("page_id", "part", "x.kind", F.decode("x.content", "UTF-8").alias("content"))


@query(CELLS + "SELECT vec_id, x AS y, y AS x, v FROM cells")
def move_axis(spark, sf_dir):
    cells = pyramid.cells(_counts(spark, sf_dir), "v", 8, ["vec_id"])
    return pyramid.move_axis(pyramid.squeeze(cells.withColumn("c", F.lit(0)), "c"), {"y": "x", "x": "y"})


@query("WITH l AS (SELECT p_brand, CAST(p_size % 5 AS INT) AS level, max(p_partkey % 900 + 100) AS h, min(p_partkey % 700 + 50) AS w FROM part GROUP BY ALL) SELECT p_brand, level, CAST(greatest(1, round_even(first_value(h) OVER b / h, 0)) AS INT) AS ds_y, CAST(greatest(1, round_even(first_value(w) OVER b / w, 0)) AS INT) AS ds_x FROM l WINDOW b AS (PARTITION BY p_brand ORDER BY level)")
def level_downscale(spark, sf_dir):
    p = F.col("p_partkey")
    levels = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 5).cast("int").alias("level")).agg(F.max(p % 900 + 100).alias("h"), F.min(p % 700 + 50).alias("w"))
    return pyramid.level_downscale(levels, ["p_brand"]).select("p_brand", "level", "ds_y", "ds_x")


@query(
    """WITH RECURSIVE s AS (SELECT event_id, user_id, event_id // 50 * 100 AS "offset", 10 + event_id * 37 % 200 AS length FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "offset", length DESC, event_id) AS k FROM s),
f AS (SELECT user_id, event_id, k, CAST(0 AS BIGINT) AS run, "offset" AS a, "offset" + length AS b FROM r WHERE k = 1
UNION ALL
SELECT r.user_id, r.event_id, r.k,
CASE WHEN r."offset" - f.b <= 100 AND greatest(r."offset" + r.length, f.b) - f.a <= 300 THEN f.run ELSE f.run + 1 END,
CASE WHEN r."offset" - f.b <= 100 AND greatest(r."offset" + r.length, f.b) - f.a <= 300 THEN f.a ELSE r."offset" END,
CASE WHEN r."offset" - f.b <= 100 AND greatest(r."offset" + r.length, f.b) - f.a <= 300 THEN greatest(r."offset" + r.length, f.b) ELSE r."offset" + r.length END
FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT event_id, run FROM f"""
)
def coalesce_equal_offsets(spark, sf_dir):
    """Of ranges with one offset the longest comes first."""
    e = F.col("event_id")
    df = table(spark, sf_dir, "events").select("event_id", "user_id", (F.floor(e / 50) * 100).alias("offset"), (10 + e * 37 % 200).alias("length"))
    return ranges.coalesce_ranges(df, ["user_id"], 100, 300).select("event_id", "run")
