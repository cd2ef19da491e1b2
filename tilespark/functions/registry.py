"""The catalogue of codecs, what they can do, and how files and bytes find theirs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import arraycodecs, bytecodecs, images

NUMERIC = ("u1", "i1", "u2", "i2", "u4", "i4", "u8", "i8", "f2", "f4", "f8")
INTS, FLOATS = NUMERIC[:8], NUMERIC[8:]


class BackendUnavailable(RuntimeError):
    """The codec needs a native library that is not installed."""


@dataclass(frozen=True)
class Codec:
    name: str
    aliases: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    dtypes: tuple[str, ...] = ("u1",)
    can_encode: bool = True
    can_decode: bool = True
    multi_frame: bool = False
    chunked: bool = False
    parallel_decode: bool = False
    encode: Callable | None = field(default=None, compare=False)
    decode: Callable | None = field(default=None, compare=False)
    #: Leading bytes as hex, each with an offset; every entry of one alternative must match.
    magic: tuple[tuple[tuple[int, str], ...], ...] = ()

    @property
    def native(self) -> bool:
        return self.encode is not None or self.decode is not None


def _byte(name, aliases=(), ext=(), magic=()):
    return Codec(name, aliases, ext, encode=bytecodecs.ENCODE[name], decode=bytecodecs.DECODE[name], magic=magic)


def _absent(name, aliases=(), ext=(), dtypes=("u1",), magic=(), **more):
    return Codec(name, aliases, ext, dtypes, magic=magic, **more)


def _at(hexed, offset=0):
    return ((offset, hexed),)


def _tiff_encode(x, level=None):
    """A page, or a list of pages."""
    from tilespark.sources.tiff import tiff_bytes

    return tiff_bytes(x if isinstance(x, list) else [x], compression=8, level=level)


def _tiff_decode(data):
    """The pages."""
    from tilespark.sources.tiff import tiff_arrays

    return tiff_arrays(data)


def _czi_decode(data):
    """The pixels of all sub-blocks, in the order of the directory."""
    from tilespark.sources.czi import czi_entries, czi_pixels

    return [czi_pixels(data, e) for e in czi_entries(data)]


def _lif_decode(data):
    """The images, slowest dimension first."""
    from tilespark.sources.acquisitions import lif_images

    return [x for _, x in lif_images(data)]


def _nd2_decode(data):
    """The frames."""
    from tilespark.sources.microscopy import nd2_frames

    return [x for _, x in nd2_frames(bytes(data))]


def _oib_decode(data):
    """The planes, the channel slowest."""
    from tilespark.sources.microscopy import oib_frames

    return [x for _, x in oib_frames(bytes(data))]


# Names, aliases, suffixes and magic bytes in order of precedence.
CODECS: list[Codec] = [
    _absent("jxl", ("jpegxl", "jpeg-xl"), (".jxl",), ("u1", "u2", "f2", "f4"), (_at("FF0A"), _at("0000000C4A584C20")), multi_frame=True, chunked=True),
    Codec("qoi", (), (".qoi",), encode=images.qoi_encode, decode=images.qoi_decode, magic=(_at("716F6966"),)),
    _byte("zstd", (), (".zst",), (_at("28B52FFD"),)),
    _byte("lz4", (), (".lz4",), (_at("04224D18"),)),
    _byte("brotli", (), (".br",)),
    _absent("blosc2", (), (".b2",), magic=(_at("02"),)),
    _absent("b2nd", ("blosc2nd", "blosc2-nd"), (".b2nd",), NUMERIC, (_at("62"),)),
    _absent("aec", ("ccsds", "szip"), (".aec",), INTS[:6]),
    _absent("lerc", (), (".lerc",), ("i1", "u1", "i2", "u2", "i4", "u4", "f4", "f8"), (_at("4C6572633220"),)),
    _absent("zfp", (), (".zfp",), ("i4", "i8", "f4", "f8"), (_at("7A6670"),)),
    _absent("sz3", (), (".sz3",), ("f4", "f8"), (_at("535A334F"),)),
    _absent("sperr", (), (".sperr",), ("f4", "f8"), (_at("53505252"),)),
    _absent("brunsli", (), (".brn",), magic=(_at("0A0442D2"),)),
    _absent("pcodec", ("pco",), (".pco",), NUMERIC, (_at("50434F4F"),)),
    _byte("deflate", ("zlib",), (".zlib",)),
    _absent("jpeg", ("jpg",), (".jpg", ".jpeg"), magic=(_at("FFD8"),)),
    _absent("webp", (), (".webp",), magic=(((0, "52494646"), (8, "57454250")),)),
    _absent("jpeg2k", ("j2k", "jp2"), (".jp2", ".j2k", ".jpx", ".jpc"), ("u1", "u2"), (_at("FF4FFF51"), _at("0000000C6A5020200D0A870A"))),
    _absent("avif", (), (".avif",), magic=(((4, "6674797061766966"),), ((4, "6674797061766973"),))),
    _absent("heif", ("heic",), (".heif", ".heic"), ("u1", "u2"), (((4, "6674797068656963"),), ((4, "667479706D696631"),), ((4, "6674797068656978"),))),
    _absent("jpegls", ("jls", "charls"), (".jls",), ("u1", "u2"), (((0, "FFD8"), (2, "FFF7")),)),
    _absent("mozjpeg", (), (".jpg", ".jpeg", ".mjpg"), magic=(_at("FFD8"),)),
    _absent("htj2k", ("openjph", "jph", "j2c"), (".j2c", ".jph"), ("u1", "u2", "i1", "i2"), (_at("FF4FFF51"),)),
    _byte("lzma", ("xz",), (".xz", ".lzma"), (_at("FD377A585A00"),)),
    _byte("bz2", ("bzip2",), (".bz2",), tuple(_at(f"425A68{0x30 + k:02X}") for k in range(1, 10))),
    Codec("numpy", ("npy",), (".npy",), (*NUMERIC, "c8", "c16"), encode=arraycodecs.npy_encode, decode=arraycodecs.npy_decode, magic=(_at("934E554D5059"),)),
    Codec("byteshuffle", (), (), NUMERIC, encode=arraycodecs.byteshuffle_encode, decode=arraycodecs.byteshuffle_decode),
    Codec("delta", (), (), INTS, encode=arraycodecs.delta_encode, decode=arraycodecs.delta_decode),
    Codec("xor", (), (), INTS, encode=arraycodecs.xor_encode, decode=arraycodecs.xor_decode),
    Codec("floatpred", ("float-pred",), (), FLOATS, encode=arraycodecs.floatpred_encode, decode=arraycodecs.floatpred_decode),
    Codec("quantize", (), (), FLOATS, encode=arraycodecs.bitround),
    Codec("packints", (), (), ("u1", "u2", "u4", "u8"), encode=arraycodecs.packints_encode, decode=arraycodecs.packints_decode),
    Codec("bcn", ("bc1", "bc2", "bc3", "bc4", "bc5", "bc6h", "bc7", "dxt1", "dxt3", "dxt5"), (), ("u1", "i1", "f2", "f4"), can_encode=False, decode=arraycodecs.bcn_decode),
    Codec("rcomp", ("rice", "rice1", "ricecomp"), (), INTS[:6], encode=arraycodecs.rice_encode, decode=arraycodecs.rice_decode),
    Codec("dicomrle", ("dicom-rle", "dcmrle"), (), ("u1", "i1", "u2", "i2"), encode=arraycodecs.dicomrle_encode, decode=arraycodecs.dicomrle_decode),
    _absent("cms", (), (), ("u1", "u2"), can_encode=False),
    Codec("gif", (), (".gif",), multi_frame=True, encode=images.gif_encode, decode=images.gif_frames, magic=(_at("474946383761"), _at("474946383961"))),
    _byte("snappy", (), (".sz",)),
    _absent("hdf5", ("hdf",), (".h5", ".hdf5", ".he5"), ("u1", "u2", "i2", "i4", "f4", "f8"), (_at("894844460D0A1A0A"),), can_encode=False, multi_frame=True, chunked=True),
    Codec("czi", (), (".czi",), ("u1", "u2", "f4"), decode=_czi_decode, magic=(_at("5A495352415746494C45"),), can_encode=False, multi_frame=True, chunked=True, parallel_decode=True),
    Codec("nd2", (), (".nd2",), ("u1", "u2", "i2", "f4"), decode=_nd2_decode, magic=(_at("DACEBE0A"), _at("DABCD83E")), can_encode=False, multi_frame=True, chunked=True),
    Codec("lif", (), (".lif",), ("u1", "u2"), decode=_lif_decode, magic=(_at("70000000"),), can_encode=False, multi_frame=True),
    Codec("oib", ("oif",), (".oib", ".oif"), ("u1", "u2", "u4"), decode=_oib_decode, magic=(_at("D0CF11E0A1B11AE1"),), can_encode=False, multi_frame=True),
    Codec("vsi", (), (".vsi",), ("u1", "u2", "f4"), decode=_tiff_decode, magic=(_at("49492A00"), _at("4D4D002A")), can_encode=False, multi_frame=True, chunked=True),
    _absent("oir", (), (".oir",), ("u1", "u2"), (_at("4F4C594D505553524157464F524D4154"),), can_encode=False, multi_frame=True, chunked=True),
    Codec("bmp", (), (".bmp", ".dib"), encode=images.bmp_encode, decode=images.bmp_decode, magic=(_at("424D"),)),
    Codec("png", (), (".png",), ("u1", "u2"), encode=images.png_encode, decode=images.png_decode, magic=(_at("89504E470D0A1A0A"),)),
    Codec("bitshuffle", ("bshuf",), (), NUMERIC[:6] + ("u8", "i8", "f4", "f8"), encode=arraycodecs.bitshuffle_encode, decode=arraycodecs.bitshuffle_decode),
    Codec("tiff", ("bigtiff",), (".tif", ".tiff", ".btf"), NUMERIC, multi_frame=True, chunked=True, encode=_tiff_encode, decode=_tiff_decode, magic=(_at("49492A00"), _at("4D4D002A"), _at("49492B00"), _at("4D4D002B"))),
    Codec("eer", (), (".eer",), ("u1", "u2"), can_encode=False, multi_frame=True, chunked=True, decode=arraycodecs.eer_events),
]

#: TIFF compression codes and the codecs of their segments.
SEGMENT_CODES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits", 34925: "lzma", 50000: "zstd", 7: "jpeg", 33003: "jpeg2k", 34712: "jpeg2k", 34887: "lerc", 50001: "webp", 50002: "jxl"}


def register_codec(codec: Codec) -> None:
    """Adds a codec; one of the same name is replaced in its place."""
    for k, c in enumerate(CODECS):
        if c.name == codec.name:
            CODECS[k] = codec
            return
    CODECS.append(codec)


def get_codec(name: str) -> Codec:
    want = name.lower()
    for c in CODECS:
        if want == c.name or want in c.aliases:
            return c
    raise KeyError(name)


def has_codec(name: str, op: str | None = None) -> bool:
    try:
        c = get_codec(name)
    except KeyError:
        return False
    return {None: True, "encode": c.can_encode and c.encode is not None, "decode": c.can_decode and c.decode is not None}[op]


def list_codecs(spark: SparkSession) -> DataFrame:
    """One row per codec, by name: ``encode`` and ``decode`` are what the format allows,
    ``encodes`` and ``decodes`` what runs here."""
    rows = [(c.name, list(c.aliases), list(c.extensions), c.native, c.can_encode, c.can_decode, has_codec(c.name, "encode"), has_codec(c.name, "decode"), c.multi_frame, c.chunked, c.parallel_decode, list(c.dtypes), k) for k, c in enumerate(CODECS)]
    schema = "name string, aliases array<string>, extensions array<string>, native boolean, encode boolean, decode boolean, encodes boolean, decodes boolean, multi_frame boolean, chunked boolean, parallel_decode boolean, dtypes array<string>, priority int"
    return spark.createDataFrame(rows, schema).orderBy("name")


def codec_for_path(path: Column) -> Column:
    """The codec of a path's suffix, whatever its case; null if none has it."""
    suffix = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    table: dict[str, str] = {}
    for c in CODECS:
        for e in c.extensions:
            table.setdefault(e, c.name)
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), suffix)


def codec_for_bytes(head: Column) -> Column:
    """The first codec whose magic bytes stand at the start of a binary column."""
    text = F.hex(F.substring(head, 1, 64))
    out = None
    for c in CODECS:
        tests = [[F.substring(text, 2 * at + 1, len(h)) == h for at, h in alt] for alt in c.magic]
        if c.name == "deflate":
            b0, b1 = (F.conv(F.substring(text, k, 2), 16, 10).cast("int") for k in (1, 3))
            tests = [[b0.bitwiseAND(15) == 8, (256 * b0 + b1) % 31 == 0]]
        for alt in tests:
            fits = alt[0]
            for t in alt[1:]:
                fits = fits & t
            out = F.when(fits, c.name) if out is None else out.when(fits, c.name)
    return out


def resolve_codec(path: Column, head: Column, fmt: Column | None = None) -> Column:
    """By the name given, else by suffix, else by magic bytes."""
    return F.coalesce(*([F.lower(fmt)] if fmt is not None else []), codec_for_path(path), codec_for_bytes(head))


def _bytes_udf(f, error: str):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def run(x: pa.Array) -> pa.Array:
        if f is None:
            raise BackendUnavailable(error)
        return pa.array([None if v is None else bytes(f(v)) for v in x.to_pylist()], pa.binary())

    return run


def encode_bytes(data: Column, name: str, level: int | None = None) -> Column:
    """Compresses a binary column."""
    c = get_codec(name) if has_codec(name) else None
    f = c.encode if c else bytecodecs.ENCODE[name]
    return _bytes_udf(f and (lambda v: f(v, level)), f"{name}: no backend installed")(data)


def decode_bytes(data: Column, name: str) -> Column:
    c = get_codec(name) if has_codec(name) else None
    return _bytes_udf(c.decode if c else bytecodecs.DECODE[name], f"{name}: no backend installed")(data)


def _segments():
    from pyspark.sql.functions import arrow_udf

    known = {k: bytecodecs.DECODE.get(v) for k, v in SEGMENT_CODES.items()}

    @arrow_udf("binary")
    def run(x: pa.Array, codes: pa.Array) -> pa.Array:
        out = []
        for v, k in zip(x.to_pylist(), codes.to_pylist()):
            if v is None or k is None:
                out.append(None)
            elif k == 1:
                out.append(v)
            elif known.get(k) is None:
                raise BackendUnavailable(f"segment code {k}: no backend installed")
            else:
                out.append(bytes(known[k](v)))
        return pa.array(out, pa.binary())

    return run


def decode_segment(data: Column, code: Column) -> Column:
    """Decompresses segments by their TIFF compression code, several codes in one column."""
    return _segments()(data, code)


def encode_segment(data: Column, name: str, level: int | None = None) -> Column:
    """The inverse, by name or code."""
    name = SEGMENT_CODES.get(name, name) if isinstance(name, int) else name
    return data if name == "none" else encode_bytes(data, name, level)


def register_functions(spark: SparkSession) -> None:
    """``codec_encode(data, name)`` and ``codec_decode(data, name)`` for SQL, and
    ``segment_decode(data, code)`` of TIFF's compression codes."""
    from pyspark.sql.functions import arrow_udf

    def each(op: str):
        def run(data: pa.Array, names: pa.Array) -> pa.Array:
            out = []
            for v, name in zip(data.to_pylist(), names.to_pylist()):
                if v is None or name is None:
                    out.append(None)
                    continue
                f = getattr(get_codec(name), op) if has_codec(name) else getattr(bytecodecs, op.upper())[name]
                if f is None:
                    raise BackendUnavailable(f"{name}: no backend installed")
                out.append(bytes(f(v, None) if op == "encode" else f(v)))
            return pa.array(out, pa.binary())

        run.__annotations__ = {"data": pa.Array, "names": pa.Array, "return": pa.Array}
        return arrow_udf(run, "binary")

    for op in ("encode", "decode"):
        spark.udf.register(f"codec_{op}", each(op))
    spark.udf.register("segment_decode", _segments())
