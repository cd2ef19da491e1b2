"""Overlaps of all boxes and blocks against brute force."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tilespark.operators import pyramid
from tilespark.plans import array_queries as q


def test_all_boxes(spark, sf_dir):
    boxes = q._boxes(spark, sf_dir).collect()
    parts = q.table(spark, sf_dir, "part").select("p_partkey", "p_size").collect()
    want = []
    for p, size in parts:
        y, x, h = p % 60, p % 90, size % 12
        want += [(b.event_id, p) for b in boxes if h and b.y1 > b.y0 and b.x1 > b.x0 and y < b.y1 and y + h > b.y0 and x < b.x1 and x + 7 > b.x0]
    assert any(e % 97 for e, _ in want)
    got = q.QUERIES["subblock_overlap_all"](spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_task_makes_most_of_the_pairs(spark):
    """Few small rows, many pairs: they must not all come out of one task."""
    place = (F.col("id") % 100).cast("int")
    boxes = spark.range(10_000).select("id", F.lit(0).alias("k"), F.lit(0).alias("y0"), F.lit(1).alias("y1"), place.alias("x0"), (place + 1).alias("x1"))
    blocks = spark.range(20_000).select(F.col("id").alias("block"), F.lit(0).alias("k"), F.lit(0).alias("by0"), place.alias("bx0"), F.lit(1).alias("bh"), F.lit(1).alias("bw"))
    pairs = pyramid.subblock_overlaps(boxes, blocks, ["k"], 16)
    tasks = [r["count"] for r in pairs.select("id", "block").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 10_000 * 200
    assert max(tasks) < 0.5 * sum(tasks)


@pytest.mark.parametrize("few", [0, 1000])
def test_listed_and_shuffled_blocks_give_the_same(spark, few):
    """Equal blocks, nulls, empty ones, places below zero and several keys; columns as before."""
    rng = random.Random(5)
    boxes = [(rng.choice([0, 1, None]), i, y := rng.randrange(-40, 40), y + rng.randrange(0, 30), x := rng.randrange(-40, 40), x + rng.randrange(0, 30)) for i in range(150)]
    blocks = [(rng.choice([None, 7, 8]), rng.choice([0, 1, None]), rng.randrange(-4, 4) * 10, rng.randrange(-4, 4) * 10, rng.randrange(0, 3) * 5, 7, "n" if i % 3 else None) for i in range(150)]
    a = spark.createDataFrame(boxes, "k int, id int, y0 int, y1 int, x0 int, x1 int")
    b = spark.createDataFrame(blocks + blocks[:20], "p int, k int, by0 int, bx0 int, bh int, bw int, name string")
    got = pyramid.subblock_overlaps(a, b, ["k"], 16, few=few)
    assert got.columns == ["k", "id", "y0", "y1", "x0", "x1", "p", "by0", "bx0", "bh", "bw", "name"]
    want = [
        (k, i, y0, y1, x0, x1, p, by, bx, h, w, name)
        for k, i, y0, y1, x0, x1 in boxes
        for p, kb, by, bx, h, w, name in blocks + blocks[:20]
        if k is not None and k == kb and y1 > y0 and x1 > x0 and h > 0 and by < y1 and by + h > y0 and bx < x1 and bx + w > x0
    ]
    assert want and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_long_lists_in_several_parts(spark, monkeypatch):
    """Many blocks of one place, cut into runs and dealt over parts: nothing is lost or doubled."""
    monkeypatch.setattr(pyramid, "RUN", 5, raising=False)
    monkeypatch.setattr(pyramid, "TILE", 60, raising=False)
    rng = random.Random(7)
    boxes = [(rng.choice([0, 1, None]), i, y := rng.randrange(-40, 40), y + rng.randrange(0, 30), x := rng.randrange(-40, 40), x + rng.randrange(0, 30)) for i in range(600)]
    places = [(rng.choice([0, 1, None]), rng.randrange(-4, 4) * 10, rng.randrange(-4, 4) * 10, rng.randrange(0, 3) * 10) for _ in range(12)] + [(0, None, 0, 5)]
    blocks = [(i // 2 if i % 7 else None, k, by, bx, h, 20) for i in range(400) for k, by, bx, h in [rng.choice(places)]]
    a = spark.createDataFrame(boxes, "k int, id int, y0 int, y1 int, x0 int, x1 int")
    b = spark.createDataFrame(blocks, "p int, k int, by0 int, bx0 int, bh int, bw int")
    got = pyramid.subblock_overlaps(a, b, ["k"], 16)
    assert got.columns == ["k", "id", "y0", "y1", "x0", "x1", "p", "by0", "bx0", "bh", "bw"]
    want = [
        (k, i, y0, y1, x0, x1, p, by, bx, h, w)
        for k, i, y0, y1, x0, x1 in boxes
        for p, kb, by, bx, h, w in blocks
        if k is not None and k == kb and by is not None and y1 > y0 and x1 > x0 and h > 0 and by < y1 and by + h > y0 and bx < x1 and bx + w > x0
    ]
    assert len(want) > 1000 and collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_pairs_take_little_disk(spark, tmp_path):
    """Pairs of boxes with the blocks of many shared places: far less than a byte for a row."""
    place = (F.col("id") % 60).cast("int")
    boxes = spark.range(3_000).select("id", F.lit(0).alias("k"), F.lit(0).alias("y0"), F.lit(1).alias("y1"), place.alias("x0"), (place + 20).alias("x1"))
    blocks = spark.range(15_000).select(F.col("id").alias("block"), F.lit(0).alias("k"), F.lit(0).alias("by0"), place.alias("bx0"), F.lit(1).alias("bh"), F.lit(1).alias("bw"))
    pairs = pyramid.subblock_overlaps(boxes, blocks, ["k"], 16).select("id", "block")
    pairs.coalesce(1).write.parquet(out := f"{tmp_path}/pairs")
    rows = sum(50 * 250 * min(20, 60 - x) for x in range(60))
    back = spark.read.parquet(out)
    assert back.count() == rows and back.distinct().count() == rows
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * rows
