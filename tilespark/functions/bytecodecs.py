"""Lossless byte codecs, bytes to bytes."""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib

import pyarrow as pa
import zstandard


def _arrow(name: str, level: int | None):
    return pa.Codec(name, level) if level is not None else pa.Codec(name)


def _stream(name: str, data: bytes) -> bytes:
    with pa.CompressedInputStream(pa.BufferReader(data), name) as f:
        return f.read()


def zstd_encode(data: bytes, level: int | None = None) -> bytes:
    return zstandard.ZstdCompressor(level=3 if level is None else level).compress(data)


def zstd_decode(data: bytes) -> bytes:
    out, rest = [], bytes(data)
    while rest:  # frames may follow each other
        one = zstandard.ZstdDecompressor().decompressobj()
        out.append(one.decompress(rest))
        if not one.eof:
            raise ValueError("truncated zstd frame")
        rest = one.unused_data
    return b"".join(out)


def lz4_encode(data: bytes, level: int | None = None) -> bytes:
    return _arrow("lz4", level).compress(data, asbytes=True)


def lz4_decode(data: bytes) -> bytes:
    return _stream("lz4", data)


def brotli_encode(data: bytes, level: int | None = None) -> bytes:
    return _arrow("brotli", 6 if level is None else level).compress(data, asbytes=True)


def brotli_decode(data: bytes) -> bytes:
    return _stream("brotli", data)


def snappy_encode(data: bytes, level: int | None = None) -> bytes:
    return pa.Codec("snappy").compress(data, asbytes=True)


def snappy_decode(data: bytes) -> bytes:
    """A raw block; its length stands in front as a varint."""
    size = shift = 0
    for b in data[:5]:
        size |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            break
    else:
        raise ValueError("not a snappy block")
    return pa.decompress(data, size, "snappy", asbytes=True)


def deflate_encode(data: bytes, level: int | None = None) -> bytes:
    return zlib.compress(data, 6 if level is None else level)


def gzip_encode(data: bytes, level: int | None = None) -> bytes:
    return gzip.compress(data, 9 if level is None else level, mtime=0)


def lzma_encode(data: bytes, level: int | None = None) -> bytes:
    return lzma.compress(data, preset=level)


def bz2_encode(data: bytes, level: int | None = None) -> bytes:
    return bz2.compress(data, 9 if level is None else level)


def packbits_encode(data: bytes, level: int | None = None) -> bytes:
    """Runs of three bytes or more, at most 128, else literals; never the code 0x80."""
    out, at, n = bytearray(), 0, len(data)
    literal = bytearray()

    def flush():
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            flush()
            out += bytes((257 - run, data[at]))
        else:
            literal += data[at : at + run]
        at += run
    flush()
    return bytes(out)


def packbits_decode(data: bytes, size: int | None = None) -> bytes:
    """Up to ``size`` bytes of output, if given; padding after them is not read."""
    out, at, n = bytearray(), 0, len(data)
    while at < n and (size is None or len(out) < size):
        c = data[at]
        at += 1
        if c < 128:
            if at + c + 1 > n:
                raise ValueError("truncated literal")
            out += data[at : at + c + 1]
            at += c + 1
        elif c > 128:
            if at >= n:
                raise ValueError("truncated run")
            out += data[at : at + 1] * (257 - c)
            at += 1
    return bytes(out)


_CLEAR, _END = 256, 257


def lzw_encode(data: bytes, level: int | None = None) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one early."""
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    nxt, width = 258, 9

    def put(code):
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    put(_CLEAR)
    word = b""
    for k in range(len(data)):
        more = data[k : k + 1]
        if not word or word + more in table:
            word += more
            continue
        put(table[word] if len(word) > 1 else word[0])
        table[word + more] = nxt
        nxt += 1
        if nxt == 4094:
            put(_CLEAR)
            table, nxt, width = {}, 258, 9
        elif nxt == 1 << width:
            width += 1
        word = more
    if word:
        put(table[word] if len(word) > 1 else word[0])
        nxt += 1
        if nxt == 4094:
            put(_CLEAR)
            width = 9
        elif nxt == 1 << width:
            width += 1
    put(_END)
    if bits:
        out.append(held << 8 - bits & 0xFF)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    base = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, out, width, last = list(base), [], 9, None
    held = bits = at = 0
    while True:
        while bits < width:
            if at >= len(data):
                return b"".join(out)
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == _END:
            return b"".join(out)
        if code == _CLEAR:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            word = table[code]
        else:
            if code > len(table):
                raise ValueError("bad LZW code")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1


ENCODE = {"zstd": zstd_encode, "lz4": lz4_encode, "brotli": brotli_encode, "snappy": snappy_encode, "deflate": deflate_encode, "gzip": gzip_encode, "lzma": lzma_encode, "bz2": bz2_encode, "packbits": packbits_encode, "lzw": lzw_encode}
DECODE = {"zstd": zstd_decode, "lz4": lz4_decode, "brotli": brotli_decode, "snappy": snappy_decode, "deflate": zlib.decompress, "gzip": gzip.decompress, "lzma": lzma.decompress, "bz2": bz2.decompress, "packbits": packbits_decode, "lzw": lzw_decode}
