"""Removal of repeated byte strings by suffix sorting with bucket pointers.

Every byte goes that is covered by a string of ``length`` bytes (a window) which also
starts anywhere else in the corpus.  Sorting all suffixes of a corpus would move each of
its bytes many times, so the sort is confined, without loss, to where repeats can be:

1. Anchors: the ``gram``-byte string of the smallest hash in a window is its anchor, so
   equal windows have equal anchors at equal places.  Neighbouring windows mostly share
   theirs; about one position in forty is one.  A window whose anchor occurs once in the
   corpus cannot repeat.
2. Contexts: the windows of one anchor are a run and form a context.  Equal contexts are
   repeats throughout, and one of them stands for all.
3. Where several different contexts have the same anchor, the suffixes at their windows
   are sorted by bucket-pointer refinement: buckets of equal 8-grams, then each bucket is
   sorted by the buckets that its suffixes point to 8, 16, 32 ... bytes later, every
   refined bucket serving the next step, down to ``length`` bytes.  Suffixes still in one
   bucket are equal windows.  Tasks first settle what repeats among their own, and send
   on one digest for each bucket; digests that meet elsewhere are repeats too.
4. What the found windows cover is cut out.

Steps 1 and 3 settle repeats within a task before they shuffle, so an anchor or window
that a third of all rows share reaches the others as one row per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tilespark.llm.bpe import slices, texts_of
from tilespark.llm.common import Scratch, tidy
from tilespark.llm.hashing import U, grams, mix, prefix, repeated, spans

#: Anchors that a task holds back so as to settle repeats among them.
TASK_ANCHORS = 1_000_000
#: Bytes of text whose anchors are sought at once, and of contexts suffix-sorted at once.
SCAN_BYTES, SORT_BYTES = 1 << 18, 1 << 19
#: Rows that a task sends on at once.
SETTLED_ROWS = 20_000

#: Rows on their way to ``_meeting``: seen once in the task; known to repeat; stands for
#: those of the task that are known to.
ONCE, KNOWN, STANDS = 0, 1, 2


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts that end at ``ends``: the anchors' positions and hashes, and
    the first window of each and how many it has."""
    n, w = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = grams(prefix(data), gram)
    m = len(hashes)
    low = U((1 << max(28, m.bit_length())) - 1)
    key = (hashes & ~low) | np.arange(m, dtype=U)  # a position needs more bits in a very long text only
    rows = -(-m // w) + 1
    block = np.full(rows * w, ~U(0), U)
    block[:m] = key
    block = block.reshape(rows, w)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.minimum(after[: n - length + 1], before[w - 1 : w + n - length]) & low
    last = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(at)]
    inside = np.arange(len(at)) + length <= last
    window = np.flatnonzero(inside)
    at = at[window].astype(np.int64)
    if not len(at):
        return at, hashes[:0], at, at
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    return at[first], hashes[at[first]], window[first], count


def windows_in_order(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bucket of the ``length`` bytes from each start, by bucket-pointer refinement.

    Two starts get one number exactly if these bytes are equal, and numbers are in the
    order of the strings.  ``data`` holds that many bytes after every start.
    """
    q = 8
    if length < q:
        raise ValueError("strings of 8 bytes at least")
    n = len(data) - q + 1
    # initial buckets: the q-gram at each position, first byte first
    gram = np.zeros(n, U)
    for k in range(q):
        gram = gram << U(8) | data[k : k + n].astype(U)
    size = len(data) + length + 1  # positions whose bucket is asked for
    need = np.bincount(starts, minlength=size) - np.bincount(starts + length - q + 1, minlength=size)
    active = np.flatnonzero(np.cumsum(need)[:n] > 0)
    bucket = np.zeros(n, np.int64)

    def refine(at: np.ndarray, base: np.ndarray, by: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Splits buckets by a second key and returns the positions still not alone.

        A bucket is numbered by the place of its first suffix, so parts of a bucket keep
        its range of numbers and suffixes that are alone need no more sorting.
        """
        b, k = base[order], by[order]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (k[1:] != k[:-1])])
        opens = np.concatenate([[True], b[1:] != b[:-1]])
        place = np.arange(len(b))
        first = np.maximum.accumulate(np.where(new, place, 0))
        top = np.maximum.accumulate(np.where(opens, place, 0))
        bucket[at[order]] = b + first - top
        alone = new & np.concatenate([new[1:], [True]])
        return np.sort(at[order[~alone]])

    if len(active):
        by = gram[active]
        active = refine(active, np.zeros(len(active), np.int64), by, np.argsort(by))
    depth = q
    while depth < length and len(active):
        step = min(depth, length - depth)
        # a position less than this depth before the end of what is needed keeps its bucket
        active = active[active + step < n]
        if not len(active):
            break
        base, by = bucket[active], bucket[active + step]
        active = refine(active, base, by, np.argsort(base << 32 | by))
        depth += step
    return bucket[starts]


def _settle(keys: np.ndarray, columns: dict[str, np.ndarray], twice: np.ndarray):
    """The rows of one task for ``_meeting``: ``twice`` says which keys repeat in it.  Only
    the rows that go out at once are copied."""
    known, once = np.flatnonzero(twice), np.flatnonzero(~twice)
    stands = np.sort(keys[known])
    stands = stands[np.concatenate([[True], stands[1:] != stands[:-1]])] if len(stands) else stands
    names = ["route", "mark", *columns]
    for mark, rows in ((ONCE, once), (KNOWN, known), (STANDS, stands)):
        for a in range(0, len(rows), SETTLED_ROWS):
            at = rows[a : a + SETTLED_ROWS]
            if mark == STANDS:
                route, rest = at, [np.zeros(len(at), np.int64) for _ in columns]
            else:
                route, rest = keys[at], [v[at] for v in columns.values()]
            if mark == KNOWN:
                route = mix(columns["doc"][at].view(U) + columns["value"][at].astype(U) * U(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (route.view(np.int64), np.full(len(at), mark, np.int8), *rest)], names=names)


def _meeting(rows: DataFrame) -> DataFrame:
    """The rows that repeat anywhere."""
    n = F.count(F.lit(1)).over(Window.partitionBy("route"))
    return rows.withColumn("n", n).where(f"mark = {KNOWN} or mark = {ONCE} and n > 1").drop("n")


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Each anchor with its context: ``key`` is the hash of the context's bytes, ``value``
    the first window's start and, in the low byte, how many windows follow it."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0

        def out():
            if held:
                hashes, doc, key, value = (np.concatenate([x.pop(0) for x in held]) for _ in range(4))
                held.clear()
                twice = repeated(hashes)
                anchor = np.where(twice, hashes, U(0)).view(np.int64)  # elsewhere it is the route
                yield from _settle(hashes, {"doc": doc, "anchor": anchor, "key": key.view(np.int64), "value": value}, twice)

        for batch in batches:
            for part in slices(batch, "text", SCAN_BYTES):
                texts = texts_of(part.column(1))
                data = np.frombuffer(b"".join(texts), np.uint8)
                ends = np.cumsum([len(x) for x in texts])
                at, hashes, first, count = anchors(data, ends, length, gram)
                if not len(at):
                    continue
                which = np.searchsorted(ends, at, "right")
                start = first - np.concatenate([[0], ends])[which]
                key = spans(prefix(data), first, first + count - 1 + length)
                held.append([hashes, np.asarray(part.column(0))[which], key, start << 8 | count - 1])
                size += len(at)
                if size >= TASK_ANCHORS:
                    yield from out()
                    size = 0
        yield from out()

    return docs.mapInArrow(tidy(run), "route long, mark byte, doc long, anchor long, key long, value long")


def _window_rows(docs: DataFrame, length: int) -> DataFrame:
    """The windows of the listed contexts, those equal within a task settled by suffix
    sorting.  A value is a window's start."""

    def run(batches):
        held: list[bytes] = []
        firsts: list[tuple[int, int, int]] = []  # document, first window, windows
        size = 0

        def out():
            if not held:
                return
            data = np.frombuffer(b"".join(held), np.uint8)
            doc, first, count = (np.array(x, np.int64) for x in zip(*firsts))
            base = np.cumsum([0, *map(len, held[:-1])])
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts = np.repeat(base, count) + step
            bucket = windows_in_order(data, starts, length)
            twice = repeated(bucket.view(U))
            keys = spans(prefix(data), starts, starts + length)
            held.clear()
            firsts.clear()
            yield from _settle(keys, {"doc": np.repeat(doc, count), "value": np.repeat(first, count) + step}, twice)

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text, listed in zip(part.column(0).to_pylist(), texts_of(part.column(1)), part.column(2)):
                    for v in sorted(set(listed.as_py())):
                        first, count = v >> 8, (v & 255) + 1
                        held.append(text[first : first + count - 1 + length])
                        firsts.append((doc, first, count))
                        size += len(held[-1])
                    if size >= SORT_BYTES:
                        yield from out()
                        size = 0
        yield from out()

    return docs.mapInArrow(tidy(run), "route long, mark byte, doc long, value long")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 200, gram: int = 128, carry: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """(id, n_bytes, kept, removed) of every row: ``kept`` what is left of the UTF-8 bytes,
    ``removed`` the maximal runs (start, end) that were cut out.

    Windows do not cross texts; a text may repeat itself, and a row's exact copy repeats
    all of it.  Repeats are judged on the input, so every occurrence goes.  Null texts
    are empty.  Texts shorter than ``length`` are kept.  Of the other columns those in
    ``carry`` are passed on, in one column ``rest``; no other is read.  Tables in between
    go to ``scratch``, which may be cleared once the result has been written.
    """
    if not 8 <= gram <= length or length - gram >= 255 or length < 128:
        raise ValueError("8 <= gram <= length < gram + 255, and length >= 128")
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "repeats")
    rest = [F.struct(*(df[c] for c in carry)).alias("rest")] if carry else []
    whole = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"), *rest)
    # rows that agree in id and text share this; what is found for one holds for the other
    whole = whole.withColumn("doc", F.xxhash64("id", "text"))
    docs = whole.where(F.octet_length("text") >= length).select("doc", "text")

    def per_doc(rows: DataFrame) -> DataFrame:
        return scratch.table(rows.groupBy("doc").agg(F.collect_set("value").alias("values")))

    met = _meeting(_anchor_rows(docs, length, gram))
    anchor = F.when(F.col("mark") == ONCE, F.col("route")).otherwise(F.col("anchor"))
    contexts = scratch.table(met.select("doc", anchor.alias("anchor"), "key", "value"))
    scratch.drop()
    kinds = scratch.table(contexts.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc")))
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor")
    # one document, and in it one place, stands for all of an equal context
    stands = kinds.join(several, "anchor", "left_semi").select("key", "doc")
    asked = contexts.join(stands, ["key", "doc"]).groupBy("key", "doc").agg(F.min("value").alias("value"))
    # the texts are shuffled to what is known of them, whatever its size
    listed = per_doc(asked)
    scratch.drop()
    windows = scratch.table(_meeting(_window_rows(docs.join(listed.hint("merge"), "doc"), length)).select("doc", "value"))
    scratch.drop(listed)

    # strings that start in one stretch of 128 bytes overlap, so their union is one run
    again = contexts.join(kinds.where("n > 1").select("key"), "key")
    again = again.select("doc", F.shiftright("value", 8).alias("start"), F.expr(f"shiftright(value, 8) + (value & 255) + {length}").alias("end"))
    covered = again.union(windows.select("doc", F.col("value").alias("start"), (F.col("value") + length).alias("end")))
    covered = covered.groupBy("doc", F.shiftright("start", 7).alias("stretch")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = per_doc(covered.select("doc", F.expr("shiftleft(start, 16) | (end - start)").alias("value")))
    scratch.drop(contexts, kinds, windows)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                kept, cut = [], []
                for text, values in zip(texts_of(part.column(1)), part.column(2)):
                    runs = []
                    if values.is_valid and len(values.values):
                        v = np.sort(np.asarray(values.values))
                        a, b = v >> 16, (v >> 16) + (v & 0xFFFF)
                        b = np.maximum.accumulate(b)
                        new = np.concatenate([[True], a[1:] > b[:-1]])
                        last = np.concatenate([new[1:], [True]])
                        runs = list(zip(a[new].tolist(), b[last].tolist()))
                    at, parts = 0, []
                    for a, b in runs:
                        parts.append(text[at:a])
                        at = b
                    kept.append(b"".join(parts) + text[at:])
                    cut.append([{"start": a, "end": b} for a, b in runs])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in texts_of(part.column(1))], pa.int64()), pa.array(kept, pa.binary()), pa.array(cut, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *part.columns[3:]],
                    names=schema.names,
                )

    last = whole.join(found.hint("merge"), "doc", "left").select("id", "text", "values", *(["rest"] if carry else []))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", whole.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("removed", span), *([whole.schema["rest"]] if carry else [])])
    return last.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
