"""Codecs that are listed as encoding have a backend."""

from tilespark.functions import registry
from tilespark.plans import array_queries as q


def test_listed_codecs_encode(spark, sf_dir):
    names = {r.name for r in q.QUERIES["has_codec_backend_op"](spark, sf_dir).collect()}
    assert names == {c.name for c in registry.CODECS if registry.has_codec(c.name, "encode")}
    assert "zstd" in names and not names & {"jxl", "blosc2", "aec"}
