"""Queries of the array operators over the shared tables.

An embedding of 64 numbers is an 8 x 8 frame, its ``vec_id`` the frame's number and its
``label`` the stack.  Events are samples of a user; texts are payloads of bytes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import colour, registry
from tilespark.operators import filters, frames, pyramid, ranges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Cells of frames, as floats and as counts from 0 to some hundred.
CELLS = """
WITH raw AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS e FROM embeddings),
cells AS (SELECT vec_id, label, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, e, CAST(floor((CAST(e AS DOUBLE) + 1) * 256) AS BIGINT) AS v FROM raw)
"""


def float_cells(spark, sf_dir):
    return pyramid.cells(table(spark, sf_dir, "embeddings"), "embedding", 8, ["vec_id", "label"])


def cells(spark, sf_dir):
    return float_cells(spark, sf_dir).withColumn("v", F.floor((F.col("v").cast("double") + 1) * 256))


# --- registry -------------------------------------------------------------------------
def _values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x + "'" for x in r) + ")" for r in rows)


# The catalogue as the formats define it (what a format allows, not what is
# installed): name, aliases, suffixes, encode, decode, several frames, chunks, parallel decoding.
_CATALOGUE = """
('jxl', 'jpegxl,jpeg-xl', '.jxl', TRUE, TRUE, TRUE, TRUE, FALSE),
('qoi', '', '.qoi', TRUE, TRUE, FALSE, FALSE, FALSE),
('zstd', '', '.zst', TRUE, TRUE, FALSE, FALSE, FALSE),
('lz4', '', '.lz4', TRUE, TRUE, FALSE, FALSE, FALSE),
('brotli', '', '.br', TRUE, TRUE, FALSE, FALSE, FALSE),
('blosc2', '', '.b2', TRUE, TRUE, FALSE, FALSE, FALSE),
('b2nd', 'blosc2nd,blosc2-nd', '.b2nd', TRUE, TRUE, FALSE, FALSE, FALSE),
('aec', 'ccsds,szip', '.aec', TRUE, TRUE, FALSE, FALSE, FALSE),
('lerc', '', '.lerc', TRUE, TRUE, FALSE, FALSE, FALSE),
('zfp', '', '.zfp', TRUE, TRUE, FALSE, FALSE, FALSE),
('sz3', '', '.sz3', TRUE, TRUE, FALSE, FALSE, FALSE),
('sperr', '', '.sperr', TRUE, TRUE, FALSE, FALSE, FALSE),
('brunsli', '', '.brn', TRUE, TRUE, FALSE, FALSE, FALSE),
('pcodec', 'pco', '.pco', TRUE, TRUE, FALSE, FALSE, FALSE),
('deflate', 'zlib', '.zlib', TRUE, TRUE, FALSE, FALSE, FALSE),
('jpeg', 'jpg', '.jpg,.jpeg', TRUE, TRUE, FALSE, FALSE, FALSE),
('webp', '', '.webp', TRUE, TRUE, FALSE, FALSE, FALSE),
('jpeg2k', 'j2k,jp2', '.jp2,.j2k,.jpx,.jpc', TRUE, TRUE, FALSE, FALSE, FALSE),
('avif', '', '.avif', TRUE, TRUE, FALSE, FALSE, FALSE),
('heif', 'heic', '.heif,.heic', TRUE, TRUE, FALSE, FALSE, FALSE),
('jpegls', 'jls,charls', '.jls', TRUE, TRUE, FALSE, FALSE, FALSE),
('mozjpeg', '', '.jpg,.jpeg,.mjpg', TRUE, TRUE, FALSE, FALSE, FALSE),
('htj2k', 'openjph,jph,j2c', '.j2c,.jph', TRUE, TRUE, FALSE, FALSE, FALSE),
('lzma', 'xz', '.xz,.lzma', TRUE, TRUE, FALSE, FALSE, FALSE),
('bz2', 'bzip2', '.bz2', TRUE, TRUE, FALSE, FALSE, FALSE),
('numpy', 'npy', '.npy', TRUE, TRUE, FALSE, FALSE, FALSE),
('byteshuffle', '', '', TRUE, TRUE, FALSE, FALSE, FALSE),
('delta', '', '', TRUE, TRUE, FALSE, FALSE, FALSE),
('xor', '', '', TRUE, TRUE, FALSE, FALSE, FALSE),
('floatpred', 'float-pred', '', TRUE, TRUE, FALSE, FALSE, FALSE),
('quantize', '', '', TRUE, TRUE, FALSE, FALSE, FALSE),
('packints', '', '', TRUE, TRUE, FALSE, FALSE, FALSE),
('bcn', 'bc1,bc2,bc3,bc4,bc5,bc6h,bc7,dxt1,dxt3,dxt5', '', FALSE, TRUE, FALSE, FALSE, FALSE),
('rcomp', 'rice,rice1,ricecomp', '', TRUE, TRUE, FALSE, FALSE, FALSE),
('dicomrle', 'dicom-rle,dcmrle', '', TRUE, TRUE, FALSE, FALSE, FALSE),
('cms', '', '', FALSE, TRUE, FALSE, FALSE, FALSE),
('gif', '', '.gif', TRUE, TRUE, TRUE, FALSE, FALSE),
('snappy', '', '.sz', TRUE, TRUE, FALSE, FALSE, FALSE),
('hdf5', 'hdf', '.h5,.hdf5,.he5', FALSE, TRUE, TRUE, TRUE, FALSE),
('czi', '', '.czi', FALSE, TRUE, TRUE, TRUE, TRUE),
('nd2', '', '.nd2', FALSE, TRUE, TRUE, TRUE, FALSE),
('lif', '', '.lif', FALSE, TRUE, TRUE, FALSE, FALSE),
('oib', 'oif', '.oib,.oif', FALSE, TRUE, TRUE, FALSE, FALSE),
('vsi', '', '.vsi', FALSE, TRUE, TRUE, TRUE, FALSE),
('oir', '', '.oir', FALSE, TRUE, TRUE, TRUE, FALSE),
('bmp', '', '.bmp,.dib', TRUE, TRUE, FALSE, FALSE, FALSE),
('png', '', '.png', TRUE, TRUE, FALSE, FALSE, FALSE),
('bitshuffle', 'bshuf', '', TRUE, TRUE, FALSE, FALSE, FALSE),
('tiff', 'bigtiff', '.tif,.tiff,.btf', TRUE, TRUE, TRUE, TRUE, FALSE),
('eer', '', '.eer', FALSE, TRUE, TRUE, TRUE, FALSE)
"""
_COLUMNS = "t(name, aliases, extensions, encode, decode, multi_frame, chunked, parallel_decode)"


@query(f"SELECT * FROM (VALUES {_CATALOGUE}) {_COLUMNS}")
def list_codecs(spark, sf_dir):
    df = registry.list_codecs(spark)
    return df.select("name", F.array_join("aliases", ",").alias("aliases"), F.array_join("extensions", ",").alias("extensions"), "encode", "decode", "multi_frame", "chunked", "parallel_decode")


@query(f"SELECT name FROM (VALUES {_CATALOGUE}) {_COLUMNS} WHERE encode")
def has_codec_op(spark, sf_dir):
    """What the catalogue claims; ``has_codec_backend_op`` has what can be encoded here."""
    return registry.list_codecs(spark).where("encode").select("name")


# Codecs that need nothing beyond what is installed.
_HERE = "('qoi'), ('zstd'), ('lz4'), ('brotli'), ('deflate'), ('lzma'), ('bz2'), ('numpy'), ('byteshuffle'), ('delta'), ('xor'), ('floatpred'), ('quantize'), ('packints'), ('rcomp'), ('dicomrle'), ('gif'), ('snappy'), ('bmp'), ('png'), ('bitshuffle'), ('tiff')"


@query(f"SELECT name, true AS encode FROM (VALUES {_HERE}) t(name)")
def has_codec_backend_op(spark, sf_dir):
    """Codecs that encode here, with the catalogue's flag."""
    here = [c.name for c in registry.CODECS if registry.has_codec(c.name, "encode")]
    return registry.list_codecs(spark).where(F.col("name").isin(here)).select("name", "encode")


_SUFFIXES = [".zst", ".PNG", ".jpg", ".tif", ".czi", ".unknown", ".Jp2", ".btf", "", ".lz4"]
# The codecs of these suffixes.
_BY_SUFFIX = dict(zip(_SUFFIXES, ["zstd", "png", "jpeg", "tiff", "czi", None, "jpeg2k", "tiff", None, "lz4"]))


@query(f"SELECT doc_id, 'data/' || source || '/' || doc_id || s AS path, name FROM documents JOIN (VALUES {_values([(i, e, n) for i, (e, n) in enumerate(_BY_SUFFIX.items())])}) t(i, s, name) ON doc_id % 10 = i")
def codec_for_path(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % 10 + 1).cast("int"))
    path = F.concat(F.lit("data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).withColumn("name", registry.codec_for_path(F.col("path")))


_HEADS = [("28B52FFD00", "zstd"), ("89504E470D0A1A0A00", "png"), ("FFD8FFE000", "jpeg"), ("49492A0008000000", "vsi"), ("49492B0008000000", "tiff"), ("789C010203", "deflate"), ("FF4FFF5100", "jpeg2k"), ("0011223344", None), ("425A683900", "bz2"), ("52494646AABBCCDD57454250", "webp")]


@query(f"SELECT page_id, name FROM pages JOIN (VALUES {_values([(i, h, n) for i, (h, n) in enumerate(_HEADS)])}) t(i, h, name) ON page_id % 10 = i")
def codec_for_bytes(spark, sf_dir):
    head = F.element_at(F.array(*(F.lit(h) for h, _ in _HEADS)), (F.col("page_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", registry.codec_for_bytes(F.concat(F.unhex(head), F.encode(F.substring("html", 1, 40), "UTF-8"))).alias("name"))


# --- codecs ---------------------------------------------------------------------------
def _roundtrip(codec: str) -> None:
    def run(spark, sf_dir):
        raw = F.encode("text", "UTF-8")
        df = table(spark, sf_dir, "documents").select("doc_id", registry.encode_bytes(raw, codec).alias("coded"))
        return df.select("doc_id", F.decode(registry.decode_bytes(F.col("coded"), codec), "UTF-8").alias("text"))

    query("SELECT doc_id, text FROM documents", f"roundtrip_{codec}")(run)


for _c in ("zstd", "lz4", "brotli", "snappy", "deflate", "gzip", "lzma", "bz2"):
    _roundtrip(_c)


@query()
def compression_ratio_by_lang(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    df = table(spark, sf_dir, "documents").select("lang", F.octet_length("text").alias("raw"), *(F.octet_length(registry.encode_bytes(raw, c)).alias(c) for c in ("zstd", "lz4", "deflate")))
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *((F.sum(c) / F.sum("raw")).alias(c) for c in ("zstd", "lz4", "deflate")))


@query("SELECT page_id, html FROM pages")
def segment_dispatch(spark, sf_dir):
    raw, n = F.encode("html", "UTF-8"), F.col("page_id") % 4
    coded = F.when(n == 1, registry.encode_segment(raw, 8)).when(n == 2, registry.encode_segment(raw, 50000)).when(n == 3, registry.encode_segment(raw, 32773)).otherwise(raw)
    code = F.when(n == 1, 8).when(n == 2, 50000).when(n == 3, 32773).otherwise(1)
    df = table(spark, sf_dir, "pages").select("page_id", coded.alias("coded"), code.alias("code"))
    return df.select("page_id", F.decode(registry.decode_segment(F.col("coded"), F.col("code")), "UTF-8").alias("html"))


# --- numeric filters ------------------------------------------------------------------
_EVENT = "CAST(floor(value * 100) AS BIGINT)"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("value") * 100).alias("v"))


@query(f"SELECT event_id, {_EVENT} - coalesce(lag({_EVENT}) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS d FROM events")
def delta_encode(spark, sf_dir):
    return filters.delta_encode(_events(spark, sf_dir), ["user_id"], "event_id", "v", "d").select("event_id", "d")


@query(f"SELECT event_id, {_EVENT} - coalesce(lag({_EVENT}, 3) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS d FROM events")
def delta_dist3(spark, sf_dir):
    return filters.delta_encode(_events(spark, sf_dir), ["user_id"], "event_id", "v", "d", dist=3).select("event_id", "d")


@query(f"SELECT event_id, {_EVENT} AS v FROM events")
def delta_decode(spark, sf_dir):
    df = filters.delta_encode(_events(spark, sf_dir), ["user_id"], "event_id", "v", "d")
    return filters.delta_decode(df.drop("v"), ["user_id"], "event_id", "d", "v").select("event_id", "v")


@query(CELLS + "SELECT vec_id, y, x, ((v - coalesce(lag(v) OVER (PARTITION BY vec_id, y ORDER BY x), 0)) % 65536 + 65536) % 65536 AS d FROM cells")
def predictor2(spark, sf_dir):
    return filters.predictor2(cells(spark, sf_dir), ["vec_id"], "y", "x", "v", "d", bits=16).select("vec_id", "y", "x", "d")


@query(f"SELECT event_id, xor({_EVENT}, coalesce(lag({_EVENT}) OVER (PARTITION BY user_id ORDER BY event_id), 0)) AS d FROM events")
def xor_encode(spark, sf_dir):
    return filters.xor_encode(_events(spark, sf_dir), ["user_id"], "event_id", "v", "d").select("event_id", "d")


@query(f"SELECT event_id, bit_xor({_EVENT}) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM events")
def xor_decode(spark, sf_dir):
    return filters.xor_decode(_events(spark, sf_dir).withColumnRenamed("v", "d"), ["user_id"], "event_id", "d", "v").select("event_id", "v")


def _numpy(f, dtype):
    """An Arrow function over arrays of numbers, one array a row."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(dtype)
    def run(x: pa.Array) -> pa.Array:
        return pa.array([f(np.asarray(v.values)) if v.is_valid else None for v in x])

    return run


@query(CELLS + "SELECT vec_id, string_agg(printf('%02x', (CAST(v AS INT) >> (8 * CAST(b AS INT))) & 255), '' ORDER BY b, y, x) AS planes FROM cells, range(4) t(b) GROUP BY vec_id")
def byteshuffle_u32(spark, sf_dir):
    from tilespark.functions.arraycodecs import byteshuffle_encode

    f = _numpy(lambda v: byteshuffle_encode(v.astype("<u4").tobytes(), 4), "binary")
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 256)).alias("v"))
    return df.select("vec_id", F.lower(F.hex(f("v"))).alias("planes"))


@query("SELECT vec_id, embedding FROM embeddings")
def floatpred_roundtrip(spark, sf_dir):
    from tilespark.functions.arraycodecs import floatpred_decode, floatpred_encode

    f = _numpy(lambda v: floatpred_decode(floatpred_encode(v.reshape(8, -1)), v.dtype, (8, len(v) // 8)).ravel(), "array<float>")
    return table(spark, sf_dir, "embeddings").select("vec_id", f("embedding").alias("embedding"))


@query(CELLS + "SELECT vec_id, y, x, CASE WHEN e = 0 THEN 0.0 ELSE sign(e) * floor(abs(CAST(e AS DOUBLE)) / pow(2.0, floor(log2(abs(CAST(e AS DOUBLE)))) - 10) + 0.5) * pow(2.0, floor(log2(abs(CAST(e AS DOUBLE)))) - 10) END AS v FROM cells")
def bitround_10(spark, sf_dir):
    from tilespark.functions.arraycodecs import bitround

    f = _numpy(lambda v: bitround(v, 10), "array<float>")
    df = table(spark, sf_dir, "embeddings").select("vec_id", "label", f("embedding").alias("embedding"))
    return pyramid.cells(df, "embedding", 8, ["vec_id"]).withColumn("v", F.col("v").cast("double"))


@query("SELECT event_id, CASE WHEN value = 0 THEN value ELSE round_even(value * pow(10.0, 2 - floor(log10(abs(value)))), 0) / pow(10.0, 2 - floor(log10(abs(value)))) END AS v FROM events")
def quantize_nsd(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", filters.nsd(F.col("value"), 3).alias("v"))


@query(CELLS + "SELECT vec_id, string_agg(lpad(bin(v), 12, '0'), '' ORDER BY y, x) AS bits FROM cells GROUP BY vec_id")
def packints_12(spark, sf_dir):
    from tilespark.functions.arraycodecs import packints_encode

    f = _numpy(lambda v: packints_encode(v, 12), "binary")
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 256)).alias("v"))
    pairs = F.regexp_extract_all(F.hex(f("v")), F.lit(".."), F.lit(0))
    return df.select("vec_id", F.array_join(F.transform(pairs, lambda h: F.lpad(F.conv(h, 16, 2), 8, "0")), "").alias("bits"))


# --- pyramids and regions -------------------------------------------------------------
_POOL = """
, p1 AS (SELECT vec_id, label, y, x // 2 AS x, CAST(trunc(avg(v) + 0.5) AS BIGINT) AS v FROM cells GROUP BY vec_id, label, y, x // 2),
p2 AS (SELECT vec_id, label, CAST(y // 2 AS INT) AS y, CAST(x AS INT) AS x, CAST(trunc(avg(v) + 0.5) AS BIGINT) AS v FROM p1 GROUP BY vec_id, label, y // 2, x)
"""
_POOL2 = """
, p3 AS (SELECT vec_id, label, y, x // 2 AS x, CAST(trunc(avg(v) + 0.5) AS BIGINT) AS v FROM p2 GROUP BY vec_id, label, y, x // 2),
p4 AS (SELECT vec_id, label, CAST(y // 2 AS INT) AS y, CAST(x AS INT) AS x, CAST(trunc(avg(v) + 0.5) AS BIGINT) AS v FROM p3 GROUP BY vec_id, label, y // 2, x)
"""

@query(CELLS + _POOL + "SELECT vec_id, y, x, v FROM p2")
def mean_pool(spark, sf_dir):
    return pyramid.mean_pool(cells(spark, sf_dir), ["vec_id", "label"], 8, 8, True).select("vec_id", "y", "x", "v")


@query(CELLS + _POOL + _POOL2 + "SELECT 0 AS level, vec_id, y, x, v FROM cells UNION ALL SELECT 1, vec_id, y, x, v FROM p2 UNION ALL SELECT 2, vec_id, y, x, v FROM p4")
def pyramid_levels(spark, sf_dir):
    shapes = pyramid.level_shapes(8, 8, 2)
    return pyramid.pyramid(cells(spark, sf_dir), ["vec_id"], shapes, True)


_LEVELS = "(VALUES (0, 4096, 6144), (1, 2048, 3072), (2, 1024, 1536), (3, 512, 768))"


@query(f"SELECT doc_id, coalesce((SELECT min(level) FROM {_LEVELS} t(level, h, w) WHERE h <= n_chars AND w <= n_chars * 2), 0) AS level FROM documents")
def best_level_for(spark, sf_dir):
    levels = spark.createDataFrame([(k, 4096 >> k, 6144 >> k, "s") for k in range(4)], "level int, h int, w int, source string")
    requests = table(spark, sf_dir, "documents").select("doc_id", F.lit("s").alias("source"), F.col("n_chars").alias("max_h"), (F.col("n_chars") * 2).alias("max_w"))
    return pyramid.best_level(F.broadcast(levels), "source", requests, "doc_id")


@query(CELLS + "SELECT vec_id, y, x, v FROM cells WHERE y >= 2 AND y < 6 AND x >= 5 AND label = 1")
def read_region(spark, sf_dir):
    return pyramid.read_region(cells(spark, sf_dir), (8, 8), (2, -2), (5, None), label=1).select("vec_id", "y", "x", "v")


_BOX = "SELECT event_id, CAST(user_id % 50 AS INT) AS y0, CAST(user_id % 50 + event_id % 40 AS INT) AS y1, CAST(event_id % 64 AS INT) AS x0, CAST(event_id % 64 + user_id % 30 AS INT) AS x1 FROM events"


def _boxes(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", (u % 50).cast("int").alias("y0"), (u % 50 + e % 40).cast("int").alias("y1"), (e % 64).cast("int").alias("x0"), (e % 64 + u % 30).cast("int").alias("x1"))


@query(f"WITH b AS ({_BOX}) SELECT event_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx FROM b, range(0, 8) t(ty), range(0, 8) s(tx) WHERE y1 > y0 AND x1 > x0 AND ty * 16 < y1 AND ty * 16 + 16 > y0 AND tx * 16 < x1 AND tx * 16 + 16 > x0")
def tile_overlap_join(spark, sf_dir):
    return pyramid.tile_overlaps(_boxes(spark, sf_dir), 16, 16).select("event_id", "ty", "tx")


def _overlaps(spark, sf_dir, boxes):
    p = F.col("p_partkey")
    blocks = table(spark, sf_dir, "part").select("p_partkey", (p % 60).alias("by0"), (p % 90).alias("bx0"), (F.col("p_size") % 12).alias("bh"), F.lit(7).alias("bw"), F.lit(0).alias("k"))
    return pyramid.subblock_overlaps(boxes.withColumn("k", F.lit(0)), blocks, ["k"], 16).select("event_id", "p_partkey")


@query(f"WITH b AS ({_BOX}) SELECT event_id, p_partkey FROM b, part WHERE event_id % 97 = 0 AND y1 > y0 AND x1 > x0 AND p_partkey % 60 < y1 AND p_partkey % 60 + p_size % 12 > y0 AND p_partkey % 90 < x1 AND p_partkey % 90 + 7 > x0 AND p_size % 12 > 0")
def subblock_overlap(spark, sf_dir):
    """Overlaps of every 97th box only; ``subblock_overlap_all`` has those of all boxes."""
    return _overlaps(spark, sf_dir, _boxes(spark, sf_dir).where("event_id % 97 = 0"))


@query(f"WITH b AS ({_BOX}) SELECT event_id, p_partkey FROM b, part WHERE y1 > y0 AND x1 > x0 AND p_partkey % 60 < y1 AND p_partkey % 60 + p_size % 12 > y0 AND p_partkey % 90 < x1 AND p_partkey % 90 + 7 > x0 AND p_size % 12 > 0")
def subblock_overlap_all(spark, sf_dir):
    """Overlaps of all boxes; their number grows with events times parts."""
    return _overlaps(spark, sf_dir, _boxes(spark, sf_dir))


@query("WITH g AS (SELECT l, CAST(c AS INT) AS c FROM (SELECT DISTINCT label AS l FROM embeddings), range(0, 40) t(c)), s AS (SELECT label, CAST(vec_id % 97 AS INT) AS c, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT g.l AS label, g.c AS chunk, coalesce(s.n, -1) AS n FROM g LEFT JOIN s ON g.l = s.label AND g.c = s.c")
def region_fill_value(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    grid = e.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("chunk"))
    stored = e.groupBy("label", (F.col("vec_id") % 97).cast("int").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    return pyramid.fill_missing(grid, stored, ["label", "chunk"], "n", -1)


# --- folds and frames -----------------------------------------------------------------
def _projection(how: str, sql: str) -> None:
    def run(spark, sf_dir):
        return frames.project(cells(spark, sf_dir), ["label"], how)

    query(CELLS + f"SELECT label, y, x, {sql} AS v FROM cells GROUP BY label, y, x", f"{how}_projection")(run)


for _h, _s in (("max", "max(v)"), ("min", "min(v)"), ("sum", "CAST(sum(v) AS BIGINT)"), ("mean", "avg(v)")):
    _projection(_h, _s)


@query(CELLS + "SELECT label, y, x, CAST(sum(v) % 65536 AS BIGINT) AS v FROM cells WHERE vec_id >= 10 AND vec_id < 300 GROUP BY label, y, x")
def range_sum(spark, sf_dir):
    return frames.range_sum(cells(spark, sf_dir), ["label"], "vec_id", 10, 300, 16)


@query("SELECT CAST(user_id % 10 AS INT) AS frame, CAST(event_id % 64 // 8 AS INT) AS y, CAST(event_id % 8 AS INT) AS x, count(*) AS v FROM events GROUP BY 1, 2, 3")
def event_raster(spark, sf_dir):
    e = F.col("event_id")
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("int").alias("frame"), F.floor(e % 64 / 8).cast("int").alias("y"), (e % 8).cast("int").alias("x"))
    return frames.rasterise(events, ["frame"])


@query(CELLS + "SELECT vec_id, y, x, last_value(CASE WHEN v % 3 = 0 THEN NULL ELSE v END IGNORE NULLS) OVER (PARTITION BY label, y, x ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS v FROM cells")
def gif_composite(spark, sf_dir):
    df = cells(spark, sf_dir).withColumn("v", F.when(F.col("v") % 3 != 0, F.col("v")))
    return filters.running_composite(df, ["label", "y", "x"], "vec_id", "v", "v").select("vec_id", "y", "x", "v")


def _index(spark, sf_dir):
    """Frames of an acquisition with their axes."""
    e = F.col("event_id")
    axes = F.create_map(F.lit("z"), (e % 5).cast("string"), F.lit("c"), F.col("event_type"), F.lit("t"), F.floor(e / 50).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", axes.alias("axes"))


@query("SELECT * FROM (VALUES ('z'), ('c'), ('t')) t(name)")
def axes_names(spark, sf_dir):
    return frames.axes_names(_index(spark, sf_dir))


@query("SELECT DISTINCT event_type AS value FROM events")
def axis_values(spark, sf_dir):
    return frames.axis_values(_index(spark, sf_dir), "c")


@query("SELECT event_id FROM events WHERE event_id % 5 = 2 AND event_type = 'click' AND event_id // 50 = 3")
def read_frame(spark, sf_dir):
    return frames.read_frame(_index(spark, sf_dir), {"z": "2", "c": "click", "t": "3"}).select("event_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id * 3 IN (SELECT event_id FROM events)")
def has_frame(spark, sf_dir):
    keys = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 3).alias("event_id"))
    return frames.has_frames(keys, table(spark, sf_dir, "events"), ["event_id"]).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE vec_id * 7 + 1 NOT IN (SELECT event_id FROM events WHERE event_id IS NOT NULL)")
def missing_frames(spark, sf_dir):
    keys = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 7 + 1).alias("event_id"))
    return frames.missing_frames(keys, table(spark, sf_dir, "events"), ["event_id"]).select("vec_id")


@query("SELECT d.doc_id AS ordinal, e.vec_id, e.label FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id * 37 % 611")
def read_many_ordered(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), (F.col("doc_id") * 37 % 611).alias("key"))
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "vec_id", "label")
    return frames.read_many(keys, stored, ["key"]).select("ordinal", "vec_id", "label")


@query("SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000) - event_id AS nbytes FROM events")
def compressed_nbytes(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id")
    return filters.lead_sizes(df, "user_id", "event_id", F.lit(1_000_000_000), "nbytes").select("event_id", "nbytes")


@query("SELECT p_partkey FROM (SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size % 5) - 1 AS level FROM part) WHERE level = 1")
def entries_at_level(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("s", F.col("p_size") % 5)
    return pyramid.entries_at_level(df, ["p_brand"], ["s"], 1).select("p_partkey")


@query("SELECT DISTINCT p_brand, p_size % 5 AS scale FROM part")
def scale_factors(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 5).alias("scale")).distinct()


@query("SELECT p_brand, max(p_partkey % 60 + p_size) AS height, max(p_partkey % 90 + 7) AS width FROM part GROUP BY p_brand")
def level_extent(spark, sf_dir):
    p = F.col("p_partkey")
    df = table(spark, sf_dir, "part").select("p_brand", (p % 60).alias("y0"), F.col("p_size").alias("h"), (p % 90).alias("x0"), F.lit(7).alias("w"))
    return pyramid.level_extent(df, ["p_brand"])


# --- byte ranges ----------------------------------------------------------------------
_RANGES = "SELECT event_id, user_id, event_id * 100 AS \"offset\", 40 + event_id * 13 % 80 AS length FROM events"


def _ranges(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", (e * 100).alias("offset"), (40 + e * 13 % 80).alias("length"))


@query(
    f"""WITH r AS ({_RANGES}),
a AS (SELECT *, CASE WHEN "offset" - max("offset" + length) OVER (PARTITION BY user_id ORDER BY "offset", length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2000 THEN 0 ELSE 1 END AS b FROM r),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY "offset", length ROWS UNBOUNDED PRECEDING) - 1 AS run FROM a)
SELECT event_id, CAST(run AS BIGINT) AS run, min("offset") OVER (PARTITION BY user_id, run) AS run_start, max("offset" + length) OVER (PARTITION BY user_id, run) AS run_end FROM g"""
)
def coalesce_ranges(spark, sf_dir):
    return ranges.coalesce_ranges(_ranges(spark, sf_dir), ["user_id"], 2000).select("event_id", "run", "run_start", "run_end")


@query(
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "offset", length) AS k FROM ({_RANGES})),
f AS (SELECT user_id, event_id, k, CAST(0 AS BIGINT) AS run, "offset" AS a, "offset" + length AS b FROM r WHERE k = 1
UNION ALL
SELECT r.user_id, r.event_id, r.k,
CASE WHEN r."offset" - f.b <= 2000 AND greatest(r."offset" + r.length, f.b) - f.a <= 8000 THEN f.run ELSE f.run + 1 END,
CASE WHEN r."offset" - f.b <= 2000 AND greatest(r."offset" + r.length, f.b) - f.a <= 8000 THEN f.a ELSE r."offset" END,
CASE WHEN r."offset" - f.b <= 2000 AND greatest(r."offset" + r.length, f.b) - f.a <= 8000 THEN greatest(r."offset" + r.length, f.b) ELSE r."offset" + r.length END
FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k + 1)
SELECT f.event_id, run, min(r."offset") OVER (PARTITION BY f.user_id, run) AS run_start, max(r."offset" + r.length) OVER (PARTITION BY f.user_id, run) AS run_end FROM f JOIN r USING (event_id)"""
)
def coalesce_ranges_capped(spark, sf_dir):
    return ranges.coalesce_ranges(_ranges(spark, sf_dir), ["user_id"], 2000, 8000).select("event_id", "run", "run_start", "run_end")


@query("SELECT event_id, CAST(event_id // 16 // 4 AS INT) AS sy, CAST(event_id % 16 // 8 AS INT) AS sx, CAST(event_id // 16 % 4 * 8 + event_id % 16 % 8 AS INT) AS inner_id FROM events")
def shard_lookup(spark, sf_dir):
    e = F.col("event_id")
    (sy, sx), inner = ranges.shard_of([F.floor(e / 16), e % 16], [4, 8])
    return table(spark, sf_dir, "events").select("event_id", sy.alias("sy"), sx.alias("sx"), inner.alias("inner_id"))


# --- arithmetic, quality, sets, extensions --------------------------------------------
@query("SELECT event_id, CASE WHEN user_id % 256 = 0 THEN 0.0 ELSE (event_id % 256) * pow(2.0, user_id % 256 - 136) END AS v FROM events")
def rgbe_decode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", colour.rgbe_value(F.col("event_id") % 256, F.col("user_id") % 256).cast("double").alias("v"))


@query("SELECT event_id, CAST(event_id AS DOUBLE) * 0.5 + 32768.0 AS v FROM events")
def fits_bscale(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", colour.scaled(F.col("event_id"), 0.5, 32768).alias("v"))


@query("SELECT vec_id, list_reverse(embedding[1:3]) || embedding[4:4] AS rgba FROM embeddings")
def bgr_to_rgb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", colour.reverse_channels(F.slice("embedding", 1, 4), alpha=True).alias("rgba"))


@query(CELLS + ", q AS (SELECT label, v, v // 8 * 8 AS w FROM cells) SELECT label, max(abs(v - w)) AS max_abs_error, avg((v - w) * (v - w)) AS mse, round(CASE WHEN avg((v - w) * (v - w)) = 0 THEN CAST('inf' AS DOUBLE) ELSE 10 * log10(262144.0 / avg((v - w) * (v - w))) END, 9) AS psnr FROM q GROUP BY label")
def psnr(spark, sf_dir):
    df = cells(spark, sf_dir).withColumn("w", F.floor(F.col("v") / 8) * 8)
    return frames.quality(df, ["label"], "v", "w", 512).withColumn("psnr", F.round("psnr", 9))


@query("SELECT vec_id FROM embeddings WHERE label < 3 UNION ALL SELECT vec_id FROM embeddings WHERE label >= 2")
def stack_union(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("label < 3").select("vec_id").union(e.where("label >= 2").select("vec_id"))


@query("SELECT vec_id FROM embeddings WHERE label < 3 INTERSECT SELECT vec_id FROM embeddings WHERE label >= 2")
def frames_intersect(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("label < 3").select("vec_id").intersect(e.where("label >= 2").select("vec_id"))


@query("SELECT vec_id FROM embeddings WHERE label < 3 EXCEPT SELECT vec_id FROM embeddings WHERE label >= 2")
def frames_except(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.where("label < 3").select("vec_id").exceptAll(e.where("label >= 2").select("vec_id")).distinct()


@query(CELLS + "SELECT label, y, x, max(v) AS v FROM cells GROUP BY label, y, x")
def running_max_stream(spark, sf_dir):
    import uuid

    from tilespark.streaming.folds import drain, running_projection

    schema = table(spark, sf_dir, "embeddings").schema
    name = f"running_{uuid.uuid4().hex}"
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/embeddings.parquet*")
    frame = pyramid.cells(stream, "embedding", 8, ["vec_id", "label"]).withColumn("v", F.floor((F.col("v").cast("double") + 1) * 256))
    return drain(running_projection(frame, ["label"], "max"), name, f"{folder}/{name}")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf_dir):
    from tilespark.streaming.folds import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour").withColumn("total", F.round("total", 4))


@query(
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM g GROUP BY user_id, s"""
)
def events_session(spark, sf_dir):
    from tilespark.streaming.folds import sessions

    return sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "30 minutes")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value of each pixel over the frames of a stack, at all levels of a pyramid."""
    shapes = pyramid.level_shapes(8, 8, 2)
    return frames.project(pyramid.pyramid(cells(spark, sf_dir), ["vec_id", "label"], shapes, True), ["label", "level"], "max")


query(
    CELLS + _POOL + _POOL2 + "SELECT label, 0 AS level, y, x, max(v) AS v FROM cells GROUP BY label, y, x UNION ALL SELECT label, 1, y, x, max(v) FROM p2 GROUP BY label, y, x UNION ALL SELECT label, 2, y, x, max(v) FROM p4 GROUP BY label, y, x",
    "projection_pyramid",
)(flagship)
