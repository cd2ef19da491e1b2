"""Near duplicates by the Jaccard similarity of word shingles.

A token-group matrix decides which documents are compared.  Similar documents form
groups; the matrix holds, for each group, the union of its members' tokens (here:
shingles).  A document q can reach the similarity with a member of group G only if
``|q n union(G)|`` does, so this bound is counted from the matrix and only groups that
qualify are opened.

Which cells of the matrix are looked at is settled by the shingles' rarity.  Under one
order of all shingles, two documents similar enough share one of their first
``n - ceil(t * n) + 1`` shingles, and the places of the first shared one tell how many
they differ in at least.  The order takes counts of hash buckets over the whole corpus,
rarest first, so that a passage that many documents share comes last.  A sketch of some
hundred bytes then tells for most pairs that they differ in too much: it sums the hashes
in each range, and every range whose sums differ holds a shingle that only one set has.

1. Count the shingles' hash buckets (a table of fixed size, whatever the corpus).
2. Write each document's size, set fingerprint, rare shingles and sketch.
3. Group: for each rare shingle the document that has it earliest leads, and each document
   is compared with its nearest leader.  Linked ones are a component; a document that its
   leader is not similar to follows it into the group all the same.
4. Queries: what follows in a group, against the group; and documents that share a rare
   shingle with a larger group, one row for the whole group, against that.
5. Queries and members of a group meet in blocks.  Sketches tell first whose shingles are
   needed at all; then the matrix's bound opens blocks, and one product of matrices gives
   all overlaps in them.  A meeting returns the links that join what was apart, fewer than
   it has documents, never its pairs.
6. Components of all links, labelled with their smallest id.

Nothing is counted in pairs of copies: equal sets share a fingerprint and are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.llm.bpe import slices, texts_of
from tilespark.llm.common import Scratch, components, small_side, tidy
from tilespark.llm.hashing import U, mix, prefix, spans

#: Hash buckets whose counts order the shingles: 2 ** this.
BUCKET_BITS = 24
#: They are counted in pieces of 2 ** this, up to so many shingles at a time.
PIECE_BITS, COUNT_AT_ONCE = 18, 1_500_000
#: Fingerprints a task remembers so as to list a set's rare shingles once.
SEEN_SETS = 300_000
#: Bytes of text that are shingled at once.
SHINGLE_BYTES = 1 << 19
#: Documents of a group in a block, and their shingles, about.
GROUP_BLOCK, BLOCK_TOKENS = 128, 1 << 15
#: Partitions whose bucket counts are added up before all meet.
MERGED_AT_ONCE = 256

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_white = np.zeros(256, bool)
_white[[0x20, *range(9, 14)]] = True


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the hashes of its shingles, repeated ones included.

    A-Z count as a-z; words are separated by ASCII white space.  A text of fewer words
    has one shingle of all of them; one without words has none.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    n = len(data)
    if not n:
        return [np.zeros(0, U) for _ in texts]
    data = _lower[data]
    inside = np.zeros(n + 2, bool)
    np.logical_not(_white[data], out=inside[1:-1])
    cut = np.zeros(n + 1, bool)
    cut[ends] = True
    cut[0] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:n]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    word = spans(prefix(data), start, end)
    per = np.searchsorted(start, np.concatenate([[0], ends])).tolist()
    both = np.zeros(max(0, len(word) - words + 1), U)
    for k in range(words):
        both = (both + word[k : k + len(both)]) * U(0xC2B2AE3D27D4EB4F)
        both ^= both >> U(29)
    both = mix(both)
    out = []
    for a, b in zip(per, per[1:]):
        if b - a >= words:
            out.append(both[a : b - words + 1])
        elif b > a:
            x = np.full(1, b - a, U)
            for k in range(a, b):
                x = mix((x + word[k : k + 1]) * U(0x9FB21C651E98DF25))
            out.append(x)
        else:
            out.append(word[:0])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def fingerprint(tokens: np.ndarray) -> int:
    """Of a set, given as sorted distinct hashes."""
    x = mix(tokens + U(0x165667B19E3779F9)).sum(keepdims=True) + np.full(1, len(tokens), U) * U(0x27D4EB2F165667C5)
    return int(mix(x).view(np.int64)[0])


def rare_first(tokens: np.ndarray, ranks: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` tokens in the order of all tokens: bucket's rank, then hash."""
    order = np.lexsort((tokens, ranks[tokens >> U(64 - BUCKET_BITS)]))
    return tokens[order[:n]]


def prefix_length(n: int, percent: int) -> int:
    """How many of the first tokens two similar sets share one of; 0 if a set of this
    size is only similar to itself."""
    largest = n * 100 // percent
    if (n + largest) * (100 - percent) < 100 + percent:
        return 0
    return n - -(-n * percent // 100) + 1


def sketch(tokens: np.ndarray, percent: int) -> bytes:
    """Sums of the hashes in even ranges, modulo 256; more ranges than similar sets of
    this size may differ in.  The number of ranges is a power of two."""
    most = (len(tokens) * 100 // percent + len(tokens)) * (100 - percent) // (100 + percent)
    bits = max(4, (3 * most // 2).bit_length())
    value = (tokens & U(0xFF)).astype(np.float64)
    return np.bincount((tokens >> U(64 - bits)).astype(np.int64), value, 1 << bits).astype(np.int64).astype(np.uint8).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Ranges in which two sketches differ, after the finer one is folded."""
    return int(differences([x], [y])[0, 0])


def differences(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """:func:`differing` of each of x and each of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    by_size = [{n: np.flatnonzero([len(v) == n for v in side]) for n in {len(v) for v in side}} for side in (x, y)]
    for nx, i in by_size[0].items():
        for ny, j in by_size[1].items():
            n = min(nx, ny)
            a, b = (np.frombuffer(b"".join(side[k] for k in at), np.uint8).reshape(len(at), n, -1).sum(2, dtype=np.uint8) for side, at in ((x, i), (y, j)))
            step = max(1, (1 << 22) // (len(j) * n))
            for k in range(0, len(i), step):
                out[np.ix_(i[k : k + step], j)] = (a[k : k + step, None] != b[None]).sum(2)
    return out


def overlaps(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """(x, y): how many tokens two sets share; 0 throughout for an x whose overlap with the
    union of all of y is too small for any."""
    out = np.zeros((len(x), len(y)), np.int64)
    sizes = np.array([len(v) for v in x])
    flat, own = np.concatenate(x), np.repeat(np.arange(len(x)), sizes)
    other, theirs = np.concatenate(y), np.repeat(np.arange(len(y)), [len(v) for v in y])
    inside = np.isin(flat, other)
    opened = np.bincount(own[inside], minlength=len(x)) * 100 >= sizes * percent
    keep = inside & opened[own]
    tokens, column = np.unique(flat[keep], return_inverse=True)
    own = own[keep]
    if not len(tokens):
        return out
    at = np.minimum(np.searchsorted(tokens, other), len(tokens) - 1)
    known = tokens[at] == other
    at, theirs = at[known], theirs[known]
    width = max(1, (1 << 20) // max(len(x), len(y)))
    for a in range(0, len(tokens), width):
        left, right = (np.zeros((len(side), min(width, len(tokens) - a)), np.float32) for side in (x, y))
        for m, rows, cols in ((left, own, column), (right, theirs, at)):
            some = (cols >= a) & (cols < a + width)
            m[rows[some], cols[some] - a] = 1
        out += (left @ right.T).astype(np.int64)
    return out


def joining(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the edges (a, b) join what the ones before left apart."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append(k)
    return out


def _bucket_ranks(docs: DataFrame, words: int) -> np.ndarray:
    """How often each hash bucket occurs in the corpus, in steps of a twelfth or so (one
    byte for each bucket, on a logarithmic scale)."""
    piece = 1 << PIECE_BITS

    def count(batches):
        held, size = [], 0

        def out():
            buckets = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
            n = np.diff(np.concatenate([first, [len(buckets)]]))
            at = buckets[first].astype(np.int64)
            cuts = np.searchsorted(at, np.arange(0, (1 << BUCKET_BITS) + 1, piece))
            numbers, packed = [], []
            for k in range(len(cuts) - 1):
                if cuts[k + 1] > cuts[k]:
                    part = np.zeros(piece, np.uint32)
                    part[at[cuts[k] : cuts[k + 1]] - k * piece] = n[cuts[k] : cuts[k + 1]]
                    numbers.append(k)
                    packed.append(pa.compress(part.tobytes(), "zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packed, pa.binary())], names=["piece", "counts"])

        for batch in batches:
            for part in slices(batch, "text", SHINGLE_BYTES):
                for x in shingles(texts_of(part.column(0)), words):
                    held.append((x >> U(64 - BUCKET_BITS)).astype(np.uint32))
                    size += len(x)
                if size >= COUNT_AT_ONCE:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def added(batches) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(pa.decompress(packed, piece * 4, "zstd", asbytes=True), np.uint32)
                if k not in total:
                    total[k] = np.zeros(piece, np.uint64)
                total[k] += part
        return total

    def add(batches):
        total = {k: np.minimum(v, 2**32 - 1).astype(np.uint32) for k, v in added(batches).items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([pa.compress(v.tobytes(), "zstd", asbytes=True) for v in total.values()], pa.binary())], names=["piece", "counts"])

    def rank(batches):
        total = added(batches)
        ranks = [np.rint(np.log2(1.0 + v.astype(np.float64)) * 6).astype(np.uint8).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(ranks, pa.binary())], names=["piece", "counts"])

    # what neighbouring partitions have counted is added up before all of a piece meets
    schema = "piece int, counts binary"
    some = F.floor(F.spark_partition_id() / MERGED_AT_ONCE)
    found = docs.select("text").mapInArrow(tidy(count), schema).withColumn("some", some).repartition("piece", "some").select("piece", "counts")
    found = found.mapInArrow(tidy(add), schema).repartition(1 << BUCKET_BITS - PIECE_BITS, "piece").mapInArrow(tidy(rank), schema)
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in found.collect():
        out[r["piece"] * piece : (r["piece"] + 1) * piece] = np.frombuffer(r["counts"], np.uint8)
    return out


def _profiles(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, fp, rare, sketch): the last two are left empty where the task has listed the
    same set, or no other set of its size can be similar."""
    ranks = docs.sparkSession.sparkContext.broadcast(_bucket_ranks(docs, words))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", SHINGLE_BYTES):
                sizes, fps, rare, sketches = [], [], [], []
                for x in shingles(texts_of(part.column(1)), words):
                    x = distinct(x)
                    sizes.append(len(x))
                    fp = fingerprint(x) if len(x) else None
                    fps.append(fp)
                    k = prefix_length(len(x), percent)
                    if not k or fp in seen:
                        rare.append([])
                        sketches.append(None)
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(fp)
                    rare.append(rare_first(x, ranks.value, k).view(np.int64))
                    sketches.append(sketch(x, percent))
                arrays = [part.column(0), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "fp", "rare", "sketch"])

    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    return docs.mapInArrow(tidy(run), schema)


def _sets(docs: DataFrame, want: DataFrame, words: int) -> DataFrame:
    """(fp, tokens) of the wanted fingerprints; ``want``: (fp, id) with a document of each."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SHINGLE_BYTES):
                fps, sets = [], []
                for x, want_fp in zip(shingles(texts_of(part.column(1)), words), part.column(2).to_pylist()):
                    x = distinct(x)
                    if len(x) and fingerprint(x) == want_fp:  # an id may stand for several texts
                        fps.append(want_fp)
                        sets.append(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "tokens"])

    texts = docs.join(small_side(want.select("id", "fp")), "id").select("id", "text", "fp")
    return texts.mapInArrow(tidy(run), "fp long, tokens array<long>")


def _fits(a: str, b: str, percent: int) -> str:
    """Whether two sets can be similar that share a first token at these places."""
    return (
        f"least({a}n, {b}n) * 100 >= greatest({a}n, {b}n) * {percent}"
        f" and ({a}i + {b}i) * {100 + percent} <= ({a}n + {b}n) * {100 - percent}"
    )


def _meetings(queries: DataFrame, members: DataFrame, data: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each block of a group's queries and block of its members: g and, of either
    side, the lists fp, c (its component so far), n and data.

    Both sides are (g, fp, c, w), w a document's weight; ``data`` is (fp, n, data).  The
    number of blocks follows from a group's counts, so a row stays small however large a
    group is, and the blocks of a group are dealt over all tasks.
    """

    def count(side: DataFrame, name: str) -> DataFrame:
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK), F.ceil(F.sum("w") / BLOCK_TOKENS))
        return side.groupBy("g").agg(blocks.cast("int").alias(name))

    sizes = scratch.table(count(queries, "nq").join(count(members, "nm"), "g"))
    sized = small_side(sizes)

    def blocks(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        rows = side.join(sized, "g").join(data, "fp")
        rows = rows.groupBy("g", F.pmod(F.xxhash64("fp"), F.col(f"n{own}")).cast("int").alias(own)).agg(F.first(f"n{other}").alias("across"), F.collect_list(F.struct("fp", "c", "n", "data")).alias("x"))
        return rows.select("g", own, F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias(other), *(F.col(f"x.{c}").alias(f"{name}_{c}") for c in ("fp", "c", "n", "data")))

    met = blocks(queries, "x", "q", "m").join(blocks(members, "y", "m", "q"), ["g", "q", "m"])
    return met.drop("q", "m")


def _lists(batch: pa.RecordBatch):
    """The rows of meetings: g, then numbers as arrays and data as lists."""
    for k in range(batch.num_rows):
        row = [c[k] for c in batch.columns]
        numbers = [np.asarray(v.values) for v in row[1:4] + row[5:8]]
        yield row[0].as_py(), *numbers[:3], row[4].values, *numbers[3:], row[8].values


def _links(queries: DataFrame, members: DataFrame, sketches: DataFrame, docs: DataFrame, reps: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between components of queries and members of one group that hold similar
    sets; enough of them to connect whatever such pairs connect."""

    def sketched(batches):
        for batch in batches:
            out: list[tuple] = []
            for g, x_fp, x_c, x_n, x, y_fp, y_c, y_n, y in _lists(batch):
                low, high = np.minimum.outer(x_n, y_n), np.maximum.outer(x_n, y_n)
                near = (low * 100 >= high * percent) & (x_c[:, None] != y_c[None])
                if near.any():
                    near &= differences(x.to_pylist(), y.to_pylist()) * (100 + percent) <= (low + high) * (100 - percent)
                for query, fp, c, n, some in ((True, x_fp, x_c, x_n, near.any(1)), (False, y_fp, y_c, y_n, near.any(0))):
                    out += zip([g] * int(some.sum()), fp[some].tolist(), c[some].tolist(), n[some].tolist(), [query] * int(some.sum()))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.bool_())], names=["g", "fp", "c", "w", "query"])

    def compared(batches):
        for batch in batches:
            a, b = [], []
            for _, _, x_c, x_n, x, _, y_c, y_n, y in _lists(batch):
                x, y = ([np.asarray(v.values) for v in side] for side in (x, y))
                both = overlaps(x, y, percent)
                i, j = np.nonzero((both * 100 >= percent * (np.add.outer(x_n, y_n) - both)) & (x_c[:, None] != y_c[None]))
                if len(i):
                    edges = np.unique(np.stack([x_c[i], y_c[j]], 1), axis=0)
                    edges = edges[joining(*edges.T)]
                    a.append(edges[:, 0])
                    b.append(edges[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (a, b)], names=["a", "b"])

    met = _meetings(queries, members, sketches.withColumnRenamed("sketch", "data"), scratch)
    some = scratch.table(met.mapInArrow(tidy(sketched), "g long, fp long, c long, w long, query boolean").distinct())
    if not some.limit(1).count():
        return docs.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    want = scratch.table(reps.join(some.select("fp").distinct(), "fp", "left_semi"))
    sets = scratch.table(_sets(docs, want, words).groupBy("fp").agg(F.first("tokens").alias("data")))
    met = _meetings(some.where("query"), some.where("not query"), sets.withColumn("n", F.size("data").cast("long")), scratch)
    edges = scratch.table(met.mapInArrow(tidy(compared), "a long, b long").distinct())
    scratch.drop(some, want, sets)
    return edges


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the component is the smallest id that
    links lead to; two rows link if ``100 * |A n B| >= percent * |A u B|``.

    Null texts and texts without words have no shingles, link with nothing and are their
    own component.  Rows of equal sets always link, however many there are.  Rows with a
    null id link by equal sets only and never name a component another row could.  Only
    the two named columns are read; an empty table gives no rows.  Tables in between go to
    ``scratch``, which may be cleared once the result has been written.
    """
    scratch = scratch or Scratch(df.sparkSession, "jaccard")
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    profiles = scratch.table(_profiles(docs, words, percent))
    reps = scratch.table(profiles.where("fp is not null").groupBy("fp").agg(F.min("id").alias("id")))
    # a set that several tasks list has its sketch once
    sketches = scratch.table(profiles.where("sketch is not null").groupBy("fp").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    # size and place in one number: most of what is shuffled here is dropped right after
    rare = profiles.select("fp", "n", F.posexplode("rare").alias("i", "token")).select("token", "fp", (F.shiftleft("n", 24) + F.col("i")).alias("ni"))
    several = rare.groupBy("token").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("token")
    shared = scratch.table(rare.join(scratch.table(several), "token").select("token", "fp", F.shiftright("ni", 24).alias("n"), F.col("ni").bitwiseAND((1 << 24) - 1).alias("i")))
    scratch.drop()
    order = F.shiftleft("i", 40).bitwiseOR(F.shiftrightunsigned("fp", 24))
    leaders = shared.groupBy("token").agg(F.min_by("fp", order).alias("l_fp"), F.min_by("n", order).alias("l_n"), F.min_by("i", order).alias("l_i"))
    led = shared.join(scratch.table(leaders), "token")
    nearest = F.shiftleft(F.col("i") + F.col("l_i"), 40).bitwiseOR(F.shiftrightunsigned("l_fp", 24))
    star = led.where("fp <> l_fp and " + _fits("", "l_", percent)).groupBy(F.col("fp").alias("a"))
    star = scratch.table(star.agg(F.min_by("l_fp", nearest).alias("b"), F.min("n").alias("n"), F.min_by("l_n", nearest).alias("l_n")))
    follow = star.select(F.col("b").alias("g"), F.col("a").alias("fp"), F.col("a").alias("c"), F.col("n").alias("w"))
    lead = star.groupBy(F.col("b").alias("g")).agg(F.min("l_n").alias("w")).select("g", F.col("g").alias("fp"), F.col("g").alias("c"), "w")
    links = _links(follow, lead, sketches, docs, reps, words, percent, scratch)
    groups = components(scratch, links, "a", "b")

    # (fp, component so far, group): what is linked is a group, and who follows it is in it too
    alone = star.select("a", "b").join(groups, F.col("a") == F.col("node"), "left_anti").join(groups, F.col("b") == F.col("node"), "left")
    member = groups.select("node", F.col("component").alias("c"), F.col("component").alias("g")).union(alone.select("a", "a", F.coalesce("component", "b")))
    member = scratch.table(member)
    sizes = scratch.table(member.groupBy("g").agg(F.count(F.lit(1)).alias("size")))
    placed = shared.select("token", "fp", "n", "i").join(member, F.col("fp") == F.col("node"), "left")
    placed = placed.select("token", "fp", "n", "i", F.coalesce("c", "fp").alias("c"), F.coalesce("g", "fp").alias("g"))
    placed = scratch.table(placed.join(small_side(sizes), "g", "left").withColumn("size", F.coalesce("size", F.lit(1))))
    several = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("i").alias("least")).where("lo <> hi").select("token", "least")
    kept = scratch.table(placed.join(scratch.table(several), "token").where(f"(i + least) * {(100 + percent) * percent} <= n * {(100 + percent) * (100 - percent)}").drop("least"))
    scratch.drop(shared, placed)
    sides = scratch.table(kept.select("g", "fp", "c", F.col("n").alias("w")).distinct())
    followers = sides.where("c <> g")
    # a group is one row for each token, so a query meets it once however many members share the token
    q = kept.select("token", *(F.col(c).alias(f"q_{c}") for c in ("fp", "n", "i", "c", "g", "size")))
    matrix = kept.groupBy("token", "g", "size").agg(F.min("i").alias("i"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    met = q.join(matrix, "token").where(
        f"(q_size < size or q_size = size and q_g < g) and q_n * 100 >= lo * {percent} and hi * 100 >= q_n * {percent}"
        f" and (q_i + i) * {100 + percent} <= (q_n + least(hi, q_n * 100 div {percent})) * {100 - percent}"
    )
    met = met.select("g", F.col("q_fp").alias("fp"), F.col("q_c").alias("c"), F.col("q_n").alias("w")).distinct()
    met = scratch.table(met.union(followers.select("g", "fp", "c", "w")))
    scratch.drop(kept)
    if met.limit(1).count():
        links = scratch.table(links.union(_links(met, sides, sketches, docs, reps, words, percent, scratch)))
        groups = components(scratch, links, "a", "b")

    whole = reps.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("g"))
    least = whole.groupBy("g").agg(F.min("id").alias("component_id"))
    labels = scratch.table(whole.join(least, "g").select("fp", "component_id"))
    out = profiles.select("id", F.col("n").alias("n_shingles"), "fp").join(labels, "fp", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
