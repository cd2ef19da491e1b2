"""Still-image codecs from their public specifications: PNG, BMP, QOI, GIF."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"


def png_encode(x: np.ndarray, level: int = 6, icc: bytes | None = None) -> bytes:
    """8 or 16 bits; gray, gray with alpha, RGB or RGBA.  Rows take the Sub filter."""
    x = x[..., None] if x.ndim == 2 else x
    h, w, c = x.shape
    depth = x.dtype.itemsize * 8
    if x.dtype not in (np.uint8, np.uint16) or c > 4:
        raise ValueError("uint8 or uint16 with one to four channels")
    raw = np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, -1)
    step = c * depth // 8
    rows = np.ones((h, raw.shape[1] + 1), np.uint8)
    rows[:, 1:] = raw
    rows[:, 1 + step :] -= raw[:, :-step]

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    out = [_PNG, chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, (0, 4, 2, 6)[c - 1], 0, 0, 0))]
    if icc:
        out.append(chunk(b"iCCP", b"ICC profile\0\0" + zlib.compress(icc)))
    return b"".join([*out, chunk(b"IDAT", zlib.compress(rows.tobytes(), level)), chunk(b"IEND", b"")])


def png_chunks(data: bytes):
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def png_icc(data: bytes) -> bytes | None:
    for kind, body in png_chunks(data):
        if kind == b"iCCP":
            return zlib.decompress(body[body.index(b"\0") + 2 :])
    return None


def png_decode(data: bytes) -> np.ndarray:
    head, palette, alpha, body = None, None, b"", []
    for kind, part in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = part
        elif kind == b"IDAT":
            body.append(part)
    w, h, depth, colour, _, _, interlace = head
    if interlace:
        raise NotImplementedError("interlaced PNG")
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride, step = -(-w * c * depth // 8), max(1, c * depth // 8)
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, row = rows[y, 0], rows[y, 1:]
        if kind == 1:
            pad = np.zeros(-(-stride // step) * step, np.uint8)
            pad[:stride] = row
            row = np.cumsum(pad.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            line, up = row.astype(int).tolist(), above.astype(int).tolist()
            for i in range(stride):
                a, b = (line[i - step] if i >= step else 0), up[i]
                if kind == 3:
                    p = (a + b) // 2
                else:
                    d = up[i - step] if i >= step else 0
                    pa, pb, pc = abs(b - d), abs(a - d), abs(a + b - 2 * d)
                    p = a if pa <= pb and pa <= pc else b if pb <= pc else d
                line[i] = (line[i] + p) & 255
            row = np.array(line, np.uint8)
        out[y] = above = row
    if depth == 16:
        x = out.view(">u2").astype(np.uint16).reshape(h, w, c)
    elif depth == 8:
        x = out.reshape(h, w, c)
    else:
        bits = np.unpackbits(out, axis=1)[:, : w * depth].reshape(h, w, depth)
        x = (bits * (1 << np.arange(depth)[::-1])).sum(-1).astype(np.uint8)[..., None]
        x = x if colour == 3 else (x * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if colour == 3:
        rgb = palette[x[..., 0]]
        if alpha:
            table = np.full(len(palette), 255, np.uint8)
            table[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            return np.concatenate([rgb, table[x[..., 0]][..., None]], -1)
        return rgb
    return x[..., 0] if c == 1 else x


def bmp_encode(x: np.ndarray) -> bytes:
    """Gray as 8-bit with a palette, RGB as 24-bit, RGBA as 32-bit; rows from the bottom."""
    h, w = x.shape[:2]
    c = 1 if x.ndim == 2 else x.shape[2]
    pixels = x if c == 1 else x[..., [2, 1, 0, 3][:c]]
    rows = np.ascontiguousarray(pixels[::-1]).reshape(h, -1)
    pad = -rows.shape[1] % 4
    body = np.pad(rows, ((0, 0), (0, pad))).tobytes()
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256)) if c == 1 else b""
    at = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", at + len(body), 0, 0, at)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * c, 0, len(body), 2835, 2835, 256 if c == 1 else 0, 0) + palette + body


def bmp_decode(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    (at,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, compression = struct.unpack_from("<IiiHHI", data, 14)
    if compression not in (0, 3):
        raise NotImplementedError("compressed BMP")
    stride = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    rows = rows if h < 0 else rows[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        index = rows[:, :w]
        if (palette == np.arange(len(palette))[:, None]).all():
            return index.copy()
        return palette[index]
    if bits == 24:
        return rows[:, : w * 3].reshape(abs(h), w, 3)[..., ::-1].copy()
    if bits in (16, 32):
        words = rows[:, : w * bits // 8].copy().view(f"<u{bits // 8}").astype(np.uint32)
        masks = struct.unpack_from("<III", data, 54) if compression == 3 else ((0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF))
        out = []
        for m in masks:
            low = (m & -m).bit_length() - 1
            most = m >> low
            out.append(((words & m) >> low) * 255 // most)
        if bits == 32 and compression == 0:
            out.append(words >> 24)
        return np.stack(out, -1).astype(np.uint8)
    raise NotImplementedError(f"{bits}-bit BMP")


def qoi_encode(x: np.ndarray) -> bytes:
    h, w, c = x.shape
    out = bytearray(struct.pack(">4sIIBB", b"qoif", w, h, c, 0))
    seen, last, run = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    pixels = [tuple(p) if c == 4 else (*p, 255) for p in x.reshape(-1, c).tolist()]
    for k, p in enumerate(pixels):
        if p == last:
            run += 1
            if run == 62 or k == len(pixels) - 1:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        slot = (p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64
        if seen[slot] == p:
            out.append(slot)
        else:
            seen[slot] = p
            dr, dg, db = ((p[i] - last[i] + 128) % 256 - 128 for i in range(3))
            if p[3] != last[3]:
                out += bytes((0xFF, *p))
            elif all(-2 <= d <= 1 for d in (dr, dg, db)):
                out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
            elif -32 <= dg <= 31 and -8 <= dr - dg <= 7 and -8 <= db - dg <= 7:
                out += bytes((0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8))
            else:
                out += bytes((0xFE, *p[:3]))
        last = p
    return bytes(out) + b"\0" * 7 + b"\1"


def qoi_decode(data: bytes) -> np.ndarray:
    magic, w, h, c, _ = struct.unpack_from(">4sIIBB", data)
    if magic != b"qoif":
        raise ValueError("not a QOI")
    seen, p, out, at = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), [], 14
    while len(out) < w * h:
        b = data[at]
        at += 1
        if b == 0xFE:
            p, at = (*data[at : at + 3], p[3]), at + 3
        elif b == 0xFF:
            p, at = tuple(data[at : at + 4]), at + 4
        elif b >= 0xC0:
            out += [p] * (b - 0xC0 + 1)
            continue
        elif b >= 0x80:
            dg, more = b - 0x80 - 32, data[at]
            at += 1
            p = ((p[0] + dg + (more >> 4) - 8) & 255, (p[1] + dg) & 255, (p[2] + dg + (more & 15) - 8) & 255, p[3])
        elif b >= 0x40:
            p = ((p[0] + (b >> 4 & 3) - 2) & 255, (p[1] + (b >> 2 & 3) - 2) & 255, (p[2] + (b & 3) - 2) & 255, p[3])
        else:
            p = seen[b]
        seen[(p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64] = p
        out.append(p)
    return np.array(out[: w * h], np.uint8).reshape(h, w, 4)[..., :c]


def _gif_lzw_decode(data: bytes, bits: int, count: int) -> np.ndarray:
    clear, end = 1 << bits, (1 << bits) + 1
    base = [bytes((k,)) for k in range(clear)] + [b"", b""]
    table, width, last, out = list(base), bits + 1, None, bytearray()
    value = have = at = 0
    while len(out) < count:
        while have < width:
            if at >= len(data):
                return np.frombuffer(bytes(out).ljust(count, b"\0"), np.uint8)
            value |= data[at] << have
            have, at = have + 8, at + 1
        code = value & (1 << width) - 1
        value, have = value >> width, have - width
        if code == clear:
            table, width, last = list(base), bits + 1, None
            continue
        if code == end:
            break
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + word[:1])
        out += word
        last = word
        if len(table) == 1 << width and width < 12:
            width += 1
    return np.frombuffer(bytes(out[:count]).ljust(count, b"\0"), np.uint8)


def _gif_lzw_encode(data: bytes, bits: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    out, value, have = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, nxt = bits + 1, end + 1

    def put(code):
        nonlocal value, have
        value |= code << have
        have += width
        while have >= 8:
            out.append(value & 255)
            value, have = value >> 8, have - 8

    put(clear)
    word = b""
    for k in range(len(data)):
        more = data[k : k + 1]
        if not word or word + more in table:
            word += more
            continue
        put(table[word] if len(word) > 1 else word[0])
        if nxt < 4096:
            table[word + more] = nxt
            if nxt == 1 << width:
                width += 1
            nxt += 1
        else:
            put(clear)
            table, width, nxt = {}, bits + 1, end + 1
        word = more
    if word:
        put(table[word] if len(word) > 1 else word[0])
        if nxt < 4096 and nxt == 1 << width:
            width += 1
    put(end)
    if have:
        out.append(value & 255)
    return bytes(out)


def gif_encode(frames: list[np.ndarray], palette: np.ndarray | None = None, delay: int = 10) -> bytes:
    """Frames of palette indices (uint8); a gray palette if none is given."""
    h, w = frames[0].shape
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1) if palette is None else palette
    table = np.zeros((256, 3), np.uint8)
    table[: len(palette)] = palette
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), table.tobytes()]
    for f in frames:
        body = _gif_lzw_encode(f.tobytes(), 8)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4, delay, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, w, h, 0), b"\x08"]
        out += [bytes((len(body[k : k + 255]),)) + body[k : k + 255] for k in range(0, len(body), 255)] + [b"\0"]
    return b"".join([*out, b";"])


def gif_frames(data: bytes) -> tuple[list[np.ndarray], list[int]]:
    """Composited RGB frames and their delays; a frame is drawn over the one before."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    w, h, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, own = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        own = np.frombuffer(data, np.uint8, n * 3, at).reshape(-1, 3)
        at += n * 3
    canvas, frames, delays, clear, delay = np.zeros((h, w, 3), np.uint8), [], [], None, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", data, at + 3)
                clear = index if bits & 1 else None
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        x, y, fw, fh, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        table = own
        if flags & 0x80:
            n = 2 << (flags & 7)
            table = np.frombuffer(data, np.uint8, n * 3, at).reshape(-1, 3)
            at += n * 3
        bits, at, parts = data[at], at + 1, []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        at += 1
        index = _gif_lzw_decode(b"".join(parts), bits, fw * fh).reshape(fh, fw)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, fh, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index = index[np.argsort(order)]
        draw = np.ones_like(index, bool) if clear is None else index != clear
        part = canvas[y : y + fh, x : x + fw]
        part[draw] = table[np.minimum(index, len(table) - 1)][draw]
        frames.append(canvas.copy())
        delays.append(delay)
        clear = None
    return frames, delays
