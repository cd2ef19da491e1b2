"""Codecs: round trips, specification vectors and damaged input."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilespark.functions import arraycodecs as ac
from tilespark.functions import bytecodecs as bc
from tilespark.functions import images

RND = np.random.default_rng(0)
PAYLOADS = [b"", b"a", b"abc" * 5000, bytes(RND.integers(0, 256, 70_000, np.uint8)), b"\0" * 100_000, bytes(range(256)) * 40]


@pytest.mark.parametrize("name", sorted(bc.ENCODE))
def test_byte_round_trips(name):
    for data in PAYLOADS:
        assert bytes(bc.DECODE[name](bc.ENCODE[name](data, None))) == data


@pytest.mark.parametrize("name,levels", [("zstd", (1, 3, 9, 19)), ("brotli", (0, 5, 11)), ("deflate", (0, 6, 9)), ("bz2", (1, 9)), ("lzma", (0, 6))])
def test_levels(name, levels):
    for level in levels:
        assert bc.DECODE[name](bc.ENCODE[name](PAYLOADS[2], level)) == PAYLOADS[2]


@pytest.mark.parametrize("name", ["zstd", "lz4", "brotli", "snappy", "deflate", "gzip", "lzma", "bz2"])
def test_damage_raises(name):
    junk = bytes(RND.integers(0, 256, 1024, np.uint8))
    for bad in (junk, bc.ENCODE[name](PAYLOADS[3])[:1000]):
        with pytest.raises(Exception):
            assert len(bc.DECODE[name](bad)) == 70_000
            raise ValueError


def test_packbits_vector():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    plain = bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4 + [0x80, 0x00, 0x2A, 0x22] + [0xAA] * 10)
    assert bc.packbits_decode(packed) == plain and bc.packbits_encode(plain) == packed


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600))
def test_run_coders(data):
    assert bc.packbits_decode(bc.packbits_encode(data)) == data
    assert bc.lzw_decode(bc.lzw_encode(data)) == data


@pytest.mark.parametrize("dtype", ["u1", "i1", "u2", "i2", "u4", "i4", "u8", "i8"])
@pytest.mark.parametrize("dist", [1, 2, 3])
def test_delta_and_xor(dtype, dist):
    x = RND.integers(0, 100, (5, 17)).astype(dtype)
    x[0, 0] = np.iinfo(dtype).max
    for axis in (-1, 0):
        assert (ac.delta_decode(ac.delta_encode(x, axis, dist), axis, dist) == x).all()
        assert (ac.xor_decode(ac.xor_encode(x, axis, dist), axis, dist) == x).all()


def test_shuffles():
    for k in (1, 2, 4, 8):
        for n in (0, 7, 8, 100, 5000):
            data = RND.integers(0, 256, n * k, np.uint8).tobytes()
            assert ac.byteshuffle_decode(ac.byteshuffle_encode(data, k), k) == data
            assert ac.bitshuffle_decode(ac.bitshuffle_encode(data, k), k) == data
    assert ac.byteshuffle_encode(bytes([1, 2, 3, 4]), 2) == bytes([1, 3, 2, 4])
    assert ac.bitshuffle_encode(bytes([1, 0, 0, 0, 0, 0, 0, 0x81]), 1) == bytes([0x81, 0, 0, 0, 0, 0, 0, 0x80])
    with pytest.raises(ValueError):
        ac.byteshuffle_encode(b"abc", 2)


def test_float_filters():
    for dtype in ("f2", "f4", "f8"):
        x = RND.normal(size=(6, 33)).astype(dtype)
        assert (ac.floatpred_decode(ac.floatpred_encode(x), dtype, x.shape) == x).all()
        assert (ac.bitround(x, ac._MANTISSA[x.dtype.itemsize]) == x).all()
        assert np.abs(ac.bitround(x, 5) - x).max() <= np.abs(x).max() * 2.0**-6
        y = x[..., None]
        assert (ac.predictor3_decode(ac.predictor3_encode(y), dtype, y.shape) == y).all()
    assert ac.nsd(np.array([0.0, 1234.5, 2.5, 3.5, -0.00123]), 1).tolist() == [0.0, 1000.0, 2.0, 4.0, -0.001]
    x = RND.integers(0, 4096, (8, 9, 3)).astype("u2")
    assert (ac.predictor2_decode(ac.predictor2_encode(x)) == x).all()


def test_packints():
    for bits in (1, 3, 8, 12, 16, 31, 32, 64):
        x = RND.integers(0, 1 << min(bits, 62), 77, np.uint64)
        data = ac.packints_encode(x, bits)
        assert len(data) == -(-77 * bits // 8) and (ac.packints_decode(data, "u8", bits, 77) == x).all()
    assert ac.packints_encode(np.array([1, 2], "u2"), 16) == b"\0\1\0\2" and ac.packints_encode(np.array([5, 1], "u1"), 4) == b"\x51"
    with pytest.raises(ValueError):
        ac.packints_decode(b"a", "u1", 3, 9)


def test_array_codecs():
    for dtype in ("u1", "i1", "u2", "i2"):
        for shape in ((9, 14), (6, 5, 3)):
            x = RND.integers(0, 50, shape).astype(dtype)
            assert (ac.dicomrle_decode(ac.dicomrle_encode(x), shape, dtype) == x).all()
    for dtype in ("u1", "i2", "u4"):
        x = np.cumsum(RND.integers(-3, 4, 500)).clip(0, 100).astype(dtype)
        assert (ac.rice_decode(ac.rice_encode(x)) == x).all()
    x = RND.normal(size=(3, 4)).astype("f4")
    assert (ac.npy_decode(ac.npy_encode(x)) == x).all()
    light = RND.random((10, 3)).astype("f4") * 50
    assert np.abs(ac.rgbe_decode(ac.rgbe_encode(light)) - light).max() <= light.max() / 100
    assert ac.rgbe_decode(np.array([[128, 64, 0, 129]], "u1")).tolist() == [[1.0, 0.5, 0.0]]
    rows, cols = np.array([0, 3, 3, 63]), np.array([5, 0, 1, 63])
    got = ac.eer_events(ac.eer_encode(rows, cols, 7, 2, 64, 64), 7, 2, 64, 64)
    assert (got[0] == rows).all() and (got[1] == cols).all()


def test_blocks():
    red = bytes([0x00, 0xF8, 0x1F, 0x00, 0, 0, 0, 0])
    assert (ac.bcn_decode(red, "bc1", 4, 4) == [255, 0, 0, 255]).all()
    assert (ac.bcn_decode(b"\xff" * 8 + red, "bc2", 3, 2) == [255, 0, 0, 255]).all()
    assert (ac.bcn_decode(bytes([200, 10, 0, 0, 0, 0, 0, 0]) + red, "dxt5", 4, 4)[..., 3] == 200).all()
    assert ac.bcn_decode(bytes([200, 10, 1, 0, 0, 0, 0, 0]) * 2, "bc5", 4, 4).shape == (4, 4, 2)
    with pytest.raises(NotImplementedError):
        ac.bcn_decode(bytes(16), "bc7", 4, 4)


@pytest.mark.parametrize("shape", [(7, 5), (6, 9, 3), (4, 4, 4)])
def test_images(shape):
    x = RND.integers(0, 256, shape).astype("u1")
    x[2:4] = 7
    assert (images.png_decode(images.png_encode(x)) == x).all()
    assert (images.png_decode(images.png_encode(x.astype("u2") * 200)) == x.astype("u2") * 200).all()
    assert (images.bmp_decode(images.bmp_encode(x)) == x).all()
    if x.ndim == 3:
        assert (images.qoi_decode(images.qoi_encode(x)) == x).all()
    assert images.png_icc(images.png_encode(x, icc=b"profile")) == b"profile" and images.png_icc(images.png_encode(x)) is None


def test_gif():
    frames = [RND.integers(0, 256, (40, 30)).astype("u1") for _ in range(3)]
    got, delays = images.gif_frames(images.gif_encode(frames, delay=7))
    assert all((g[..., 0] == f).all() for g, f in zip(got, frames)) and delays == [7, 7, 7]
