"""Multi-resolution levels and regions over cells (one row per pixel) and tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cells(df: DataFrame, array: str, width: int, keep: Sequence[str]) -> DataFrame:
    """Rows (keep..., y, x, v) of an array column that holds a frame row by row."""
    out = df.select(*keep, F.posexplode(array).alias("pos", "v"))
    return out.select(*keep, F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), "v")


def _pool(df: DataFrame, keys, axis: str, other: str, size: Column, integer: bool) -> DataFrame:
    mean = F.avg("v")
    mean = (mean + 0.5).cast("long") if integer else mean
    half = F.floor(F.col(axis) / 2).cast("int").alias(axis)
    return df.where(F.col(axis) < F.floor(size / 2) * 2).groupBy(*keys, other, half).agg(mean.alias("v"))


def mean_pool(df: DataFrame, keys: Sequence[str], height: int, width: int, integer: bool) -> DataFrame:
    """2 x 2 means, the last axis first.  Integers are rounded after each axis by adding a
    half and truncating; an odd last row or column is dropped."""
    across = _pool(df.select(*keys, "y", "x", "v"), keys, "x", "y", F.lit(width), integer)
    return _pool(across, keys, "y", "x", F.lit(height), integer).select(*keys, "y", "x", "v")


def level_shapes(height: int, width: int, smallest: int = 256, most: int | None = None) -> list[tuple[int, int]]:
    """Full resolution first, halved until both sides would fit into ``smallest``."""
    out = [(height, width)]
    while max(out[-1]) > smallest and min(out[-1]) >= 2 and (most is None or len(out) < most):
        out.append((out[-1][0] // 2, out[-1][1] // 2))
    return out


def pyramid(df: DataFrame, keys: Sequence[str], shapes: Sequence[tuple[int, int]], integer: bool) -> DataFrame:
    """(level, keys..., y, x, v) of all levels; each level is pooled from the one before."""
    out = df.select(F.lit(0).alias("level"), *keys, "y", "x", "v")
    level = df
    for k in range(1, len(shapes)):
        level = mean_pool(level, keys, *shapes[k - 1], integer)
        out = out.unionByName(level.select(F.lit(k).alias("level"), *keys, "y", "x", "v"))
    return out


def best_level(levels: DataFrame, source: str, requests: DataFrame, key: str) -> DataFrame:
    """(key, level): the first level that fits a request's ``max_h`` and ``max_w``; level 0
    where none does."""
    fits = requests.join(levels, source).where("h <= max_h and w <= max_w").groupBy(key).agg(F.min("level").alias("level"))
    return requests.select(key).join(fits, key, "left").select(key, F.coalesce("level", F.lit(0)).alias("level"))


def clip(start: int | None, stop: int | None, size: int) -> tuple[int, int]:
    """Bounds within an axis; negative ones count from its end once."""
    a = 0 if start is None else start + size if start < 0 else start
    b = size if stop is None else stop + size if stop < 0 else stop
    a = min(max(a, 0), size)
    return a, max(a, min(max(b, 0), size))


def read_region(df: DataFrame, shape: tuple[int, int], y: tuple, x: tuple, level: int | None = None, **axes) -> DataFrame:
    """Cells of a region; plain comparisons, so that sources prune by them."""
    (y0, y1), (x0, x1) = clip(*y, shape[0]), clip(*x, shape[1])
    out = df if level is None else df.where(F.col("level") == level)
    for name, value in axes.items():
        out = out.where(F.col(name) == value)
    return out.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def tile_overlaps(boxes: DataFrame, th: int, tw: int) -> DataFrame:
    """Boxes (y0, y1, x0, x1; ends exclusive) by the regular tiles they meet: (..., ty, tx).
    Tile numbers are enumerated for each box, so that the join to tiles is an equi-join."""
    ids = boxes.where("y1 > y0 and x1 > x0")
    ids = ids.withColumn("ty", F.explode(F.sequence((F.floor(F.col("y0") / th)).cast("int"), F.floor((F.col("y1") - 1) / th).cast("int"))))
    return ids.withColumn("tx", F.explode(F.sequence((F.floor(F.col("x0") / tw)).cast("int"), F.floor((F.col("x1") - 1) / tw).cast("int"))))


#: Pairs of a box and a block, overlapping or not, that a task looks after, and tasks at most.
TASK_PAIRS, MOST_TASKS = 50_000_000, 2000
#: Of long lists: blocks that follow each other in a run, and boxes and blocks, about, that the
#: pairs of a task are made of, so that dictionaries of files can hold them.
RUN, TILE = 256, 50_000


def subblock_overlaps(boxes: DataFrame, blocks: DataFrame, key: Sequence[str], grid: int, few: int = 2_000_000) -> DataFrame:
    """Pairs of boxes and irregular blocks (by0, bx0, bh, bw) that overlap.  Both are
    enumerated over a grid, joined by cell and key, and kept in the cell of their corner.

    What comes out can be far more than what goes in, so the boxes are dealt to tasks by the
    number of pairs.  Up to ``few`` blocks go to all tasks, those of one place and size as one
    row that is compared once; more of them are shuffled by cell, one by one.

    Where many blocks share a place, a task puts out the pairs of a run of them together: each
    box stands once for the whole run and the run repeats from box to box, which files store in
    a small part of the bytes.  Boxes are sorted for that once a run, not once a pair."""

    def spread(df, y0, y1, x0, x1):
        df = df.withColumn("gy", F.explode(F.sequence(F.floor(y0 / grid), F.floor((y1 - 1) / grid))))
        return df.withColumn("gx", F.explode(F.sequence(F.floor(x0 / grid), F.floor((x1 - 1) / grid))))

    def met(boxes, blocks, hint=lambda df: df):
        a = spread(boxes, c("y0"), c("y1"), c("x0"), c("x1"))
        b = spread(blocks, c("by0"), c("by0") + c("bh"), c("bx0"), c("bx0") + c("bw"))
        pairs = a.join(hint(b), [*key, "gy", "gx"]).where("by0 < y1 and by0 + bh > y0 and bx0 < x1 and bx0 + bw > x0")
        corner = (c("gy") == F.floor(F.greatest("y0", "by0") / grid)) & (c("gx") == F.floor(F.greatest("x0", "bx0") / grid))
        return pairs.where(corner).drop("gy", "gx")

    c = F.col
    boxes, blocks = boxes.where("y1 > y0 and x1 > x0"), blocks.where("bh > 0 and bw > 0")
    names, place = [x for x in blocks.columns if x not in key], ["by0", "bx0", "bh", "bw"]
    rest = [x for x in names if x not in place]
    n = blocks.count()
    if not rest or n > few:
        return met(boxes, blocks)

    lists = blocks.groupBy(*key, *place).agg(F.collect_list(F.struct(*rest)).alias("members"))
    n_boxes, long = boxes.count(), n >= 8 * lists.count() > 0
    parts = -(-n // TILE) if long else 1
    tasks = min(-(-n_boxes * n // (parts * TASK_PAIRS)), MOST_TASKS // parts)
    boxes = boxes.repartition(max(tasks, -(-n_boxes // TILE) if long else 1, 1))
    own = [x for x in boxes.columns if x not in key]
    run = [*key, *place, "run"]
    if long:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("members") - 1) / RUN).cast("int")), lambda i: F.slice("members", i * RUN + 1, F.lit(RUN)))
        lists = lists.select(*key, *place, F.posexplode(runs).alias("run", "members"))

    def part(lists):
        if not long:
            return met(boxes, lists, F.broadcast)
        pairs = met(boxes, lists.drop("members"), F.broadcast).sortWithinPartitions(*run)
        # Spark drops a sort below a join unless something between is not deterministic
        return pairs.where(F.spark_partition_id() >= 0).join(F.broadcast(lists), run)

    out = None
    for i in range(parts):
        some = lists if parts == 1 else lists.where(F.pmod(F.hash(*run), F.lit(parts)) == i)
        pairs = part(some).select(*key, *own, *place, F.explode("members").alias("member"))
        out = pairs if out is None else out.union(pairs)
    return out.select(*key, *own, *(c(f"member.{x}") if x in rest else c(x) for x in names))


def paste(cells: DataFrame, order: str, y: tuple[int, int], x: tuple[int, int], keys: Sequence[str] = (), fill=0) -> DataFrame:
    """(keys..., y, x, v) of every pixel of a region.  Where several tiles give a pixel the
    last in ``order`` does; what none gives holds ``fill``."""
    inside = cells.where((F.col("y") >= y[0]) & (F.col("y") < y[1]) & (F.col("x") >= x[0]) & (F.col("x") < x[1]))
    given = inside.groupBy(*keys, "y", "x").agg(F.max_by("v", order).alias("v"))
    if y[1] <= y[0] or x[1] <= x[0]:
        return given
    every = cells.select(*keys).distinct() if keys else cells.sparkSession.range(1).select()
    every = every.withColumn("y", F.explode(F.sequence(F.lit(y[0]), F.lit(y[1] - 1)))).withColumn("x", F.explode(F.sequence(F.lit(x[0]), F.lit(x[1] - 1))))
    return every.join(given, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("v", F.lit(fill)).alias("v"))


def move_axis(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """Axes under other names: {old: new}; swapping two transposes."""
    return cells.select(*(F.col(c).alias(names.get(c, c)) for c in cells.columns))


def squeeze(cells: DataFrame, axis: str, at: int = 0) -> DataFrame:
    """Without an axis of one place; a row elsewhere raises."""
    there = F.when(F.col(axis) == at, F.lit(True)).otherwise(F.raise_error(F.lit(f"axis {axis} has more than one place")).cast("boolean"))
    return cells.where(there).drop(axis)


def level_downscale(levels: DataFrame, source: Sequence[str]) -> DataFrame:
    """``levels`` (source..., level, h, w) with ``ds_y`` and ``ds_x``, how many times smaller
    each is than level 0; halves go to the even number."""
    base = Window.partitionBy(*source).orderBy("level")
    return levels.withColumns({f"ds_{a}": F.greatest(F.lit(1), F.rint(F.first(s).over(base) / F.col(s)).cast("int")) for a, s in (("y", "h"), ("x", "w"))})


def fill_missing(grid: DataFrame, chunks: DataFrame, on: Sequence[str], value: str, fill) -> DataFrame:
    """A grid of chunks with a fill value for those that are not stored."""
    return grid.join(chunks, list(on), "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def entries_at_level(df: DataFrame, source: Sequence[str], scale: Sequence[str], level: int) -> DataFrame:
    """Entries of one level; levels are numbered by ascending scale factor."""
    order = Window.partitionBy(*source).orderBy(*scale)
    return df.withColumn("level", F.dense_rank().over(order) - 1).where(F.col("level") == level)


def level_extent(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.col("y0") + F.col("h")).alias("height"), F.max(F.col("x0") + F.col("w")).alias("width"))
