"""Acquisitions: frames by their axes, blocks and responses."""

import numpy as np
import pytest

from tilespark.functions.arraycodecs import dicomrle_encode
from tilespark.functions.registry import BackendUnavailable
from tilespark.operators import frames
from tilespark.sources import acquisitions as acq

RND = np.random.default_rng(4)


@pytest.mark.parametrize("compression", [1, 50000, 8])
def test_ndtiff(spark, tmp_path, compression):
    data = [({"z": z, "c": c}, RND.integers(0, 999, (6, 8)).astype("u2")) for z in range(4) for c in ("a", "b")]
    data.append(({"rgb": 1}, RND.integers(0, 255, (5, 4, 3)).astype("u1")))
    acq.write_ndtiff(str(tmp_path), data, compression=compression, limit=400)
    df = acq.read_ndtiff(spark, str(tmp_path))
    rows = df.orderBy("ordinal").collect()
    for r, (axes, x) in zip(rows, data, strict=True):
        assert {k: str(v) for k, v in axes.items()} == r.axes
        assert (np.frombuffer(r.payload, r.dtype).reshape(r.height, r.width, r.samples) == x.reshape(*x.shape[:2], -1)).all()
    one = frames.read_frame(df, {"z": "2", "c": "b"}).collect()
    assert len(one) == 1 and (np.frombuffer(one[0].payload, "u2").reshape(6, 8) == data[5][1]).all()
    assert sorted(r.name for r in frames.axes_names(df).collect()) == ["c", "rgb", "z"]
    assert sorted(r.value for r in frames.axis_values(df, "z").collect()) == ["0", "1", "2", "3"]


def test_ndtiff_pyramid(tmp_path):
    for name in ("Full resolution", "Downsampled_x4", "Downsampled_x2", "other"):
        (tmp_path / name).mkdir()
    assert [k for k, _ in acq.ndtiff_pyramid(str(tmp_path))] == [1, 2, 4]


def test_lif(spark, tmp_path):
    x = RND.integers(0, 255, (3, 6, 5)).astype("u1")
    xml = (
        '<Doc><Element Name="one"><Data><Image><ImageDescription><Channels><ChannelDescription Resolution="8" BytesInc="0"/></Channels><Dimensions>'
        '<DimensionDescription DimID="1" NumberOfElements="5" BytesInc="1"/><DimensionDescription DimID="2" NumberOfElements="6" BytesInc="5"/>'
        '<DimensionDescription DimID="3" NumberOfElements="3" BytesInc="30"/></Dimensions></ImageDescription></Image></Data><Memory MemoryBlockID="M1"/></Element></Doc>'
    )
    (tmp_path / "x.lif").write_bytes(acq.lif_encode(xml, {"M1": x.tobytes(), "M2": b""}))
    (row,) = acq.read_lif(spark, f"{tmp_path}/x.lif").collect()
    assert row.name == "one" and (np.frombuffer(row.payload, row.dtype).reshape(row.shape) == x).all()
    with pytest.raises(ValueError):
        acq.lif_parts(bytes(40))


def test_dicomweb():
    x = RND.integers(0, 99, (7, 5)).astype("u2")
    coded = dicomrle_encode(x)
    body = b"--b1\r\nContent-Type: application/octet-stream\r\n\r\n" + coded + b"\r\n--b1\r\n\r\nsecond\r\n--b1--\r\n"
    parts = acq.multipart(body, 'multipart/related; type="x"; boundary=b1')
    assert parts[0][0]["content-type"] == "application/octet-stream" and parts[1][1] == b"second"
    assert (acq.decode_frame(parts[0][1], "1.2.840.10008.1.2.5", x.shape, "u2") == x).all()
    assert (acq.decode_frame(x.tobytes(), "1.2.840.10008.1.2.1", x.shape, "u2") == x).all()
    with pytest.raises(BackendUnavailable):
        acq.decode_frame(b"", "1.2.840.10008.1.2.4.50", (1, 1), "u1")
    with pytest.raises(ValueError):
        acq.decode_frame(b"", "1.2.840.10008.1.2.4.70", (1, 1), "u1")
    with pytest.raises(ValueError):
        acq.multipart(b"", "multipart/related")
