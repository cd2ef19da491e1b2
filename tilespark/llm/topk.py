"""Exact top-k search by inner product.

Vectors are dealt into blocks in descending order of length, and blocks are taken in rounds,
the longest first, each round some times as many as the one before.  Queries form blocks
too and meet one block of vectors at a time.  In each meeting:

* the length bound drops queries whose ``|q| * |v|`` cannot reach their k-th score;
* both sides are rotated by the corpus' right singular vectors, so that the first
  coordinates hold most of a product; partial sums over them plus the Cauchy-Schwarz
  bound of the rest, ``|q_rest| * |v_rest|``, drop most pairs;
* what is left is scored exactly, in integers if the components are.

After each round every query has a new k-th score; only what can still beat it (or ties with
it by a smaller id) comes back from the next, and once no block's length can, the search
ends.  The singular vectors take the second moments of all vectors, summed as ``d * d``
numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilespark.llm.common import Scratch, small_side, tidy

#: Vectors and queries in a block, at most, and components of a block's vectors.
BLOCK, QUERY_BLOCK, BLOCK_VALUES = 4096, 512, 1 << 18
#: Times as many parts as in the round before.
GROWTH = 4
#: Rotated coordinates whose partial sums are taken first: this share of the length.
HEAD = 0.25
#: Share of pairs left from which all of a block are scored at once.
DENSE = 0.05


def _matrix(column: pa.Array) -> list[np.ndarray]:
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values)
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _square(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def second_moments(vectors: DataFrame, width: int) -> np.ndarray:
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _square(_matrix(batch.column(0)), width)
            total += x.T @ x
        at = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "value"])

    out = np.zeros(width * width)
    found = vectors.select("vector").mapInArrow(tidy(run), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    for r in found:
        out[r["at"]] = r["value"]
    return out.reshape(width, width)


def _blocks(rows: DataFrame, size: int, id_type: str) -> DataFrame:
    """Rows of a partition in blocks: (block, most, ids, data); ``most`` is the greatest
    length in it."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ids, vectors = part.column(0), _matrix(part.column(1))
                lists = pa.array([ids.to_pylist()], pa.list_(ids.type))
                sizes = pa.array([[len(r) for r in vectors]], pa.list_(pa.int32()))
                vectors = pa.array([np.concatenate(vectors)], pa.list_(pa.float64()))
                most = max(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([most], pa.float64()), lists, vectors, sizes], names=["block", "most", "ids", "data", "sizes"])
                number += 1

    return rows.mapInArrow(tidy(run), f"block long, most double, ids array<{id_type}>, data array<double>, sizes array<int>")


def _unpack(data: pa.Scalar, sizes: pa.Scalar, width: int) -> np.ndarray:
    n = np.asarray(sizes.values)
    flat = np.asarray(data.values)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    ends = np.cumsum(n)
    for k in range(len(n)):
        out[k, : n[k]] = flat[ends[k] - n[k] : ends[k]]
    return out


def meet(queries: np.ndarray, q_ids: np.ndarray, least: np.ndarray, vectors: np.ndarray, v_ids: np.ndarray, rotation: np.ndarray, k: int, least_ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, row of the vector, score) of all that can be among the k best of a
    query, given its k-th score so far (``least``); ties go to the smaller id, those with
    the k-th score too where its id is given (``least_ids``)."""
    head = max(1, int(len(rotation) * HEAD))
    norms = np.sqrt((queries**2).sum(1))
    longest = np.sqrt((vectors**2).sum(1)).max(initial=0.0)
    slack = 1e-9 * (1 + norms * longest)
    alive = np.flatnonzero(norms * longest + slack >= least)
    if not len(alive) or not len(vectors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q_rot, v_rot = queries[alive] @ rotation, vectors @ rotation
    q_rest = np.sqrt((q_rot[:, head:] ** 2).sum(1))
    v_rest = np.sqrt((v_rot[:, head:] ** 2).sum(1))
    by_id = np.argsort(v_ids, kind="stable")
    order = np.empty(len(v_ids), np.int64)
    order[by_id] = np.arange(len(v_ids))
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(alive), 128):
        rows = alive[a : a + 128]
        part = slice(a, a + 128)
        floor = least[rows] - slack[rows]
        own = q_ids[rows][:, None] == v_ids[None, :]
        if np.isfinite(floor).any():
            bound = q_rot[part, :head] @ v_rot[:, :head].T
            bound += np.outer(q_rest[part], v_rest)
            left = bound >= floor[:, None]
        else:
            left = np.ones(own.shape, bool)
        left &= ~own
        if left.mean() > DENSE:  # one product of matrices costs less than many of pairs
            score = np.where(left, queries[rows] @ vectors.T, -np.inf)
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1] if score.shape[1] > k else np.full(len(rows), -np.inf)
            i, j = np.nonzero((score >= np.maximum(kth, least[rows])[:, None]) & left)
            score = score[i, j]
        else:
            i, j = np.nonzero(left)
            score = np.einsum("ij,ij->i", queries[rows[i]], vectors[j])
            good = score >= least[rows[i]]
            i, j, score = i[good], j[good], score[good]
        if least_ids is not None:
            ahead = (score > least[rows[i]]) | (v_ids[j] < least_ids[rows[i]])
            i, j, score = i[ahead], j[ahead], score[ahead]
        best = np.lexsort((order[j], -score, i))  # k best of each query in this block
        i, j, score = i[best], j[best], score[best]
        keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(rows)))[i] < k
        out_q.append(rows[i[keep]])
        out_v.append(j[keep])
        out_s.append(score[keep])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def exact_top_k(df: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, id, score) of each query's ``k`` largest inner products with all rows
    but those of its own id; ties go to the smaller id.

    Rows with a null id, a null vector, or null or non-finite components take no part,
    neither as queries nor as candidates.  Shorter vectors count as filled up with zeros.
    Repeated candidate rows count each; a repeated query row is answered once.  Scores
    are doubles, exact where components are integers below 2**53 in sum.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    vector = df[vector_col]
    sound = df[id_col].isNotNull() & vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.coalesce(sound, F.lit(False))).select(df[id_col].alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"), is_query.alias("is_query"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("norm", norm)
    id_type = rows.schema["id"].dataType.simpleString()
    found = rows.agg(F.max(F.size("vector")).alias("width"), F.count(F.lit(1)).alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).first()
    width, n, n_queries = found["width"] or 0, found["n"], found["q"] or 0
    empty = spark.createDataFrame([], f"query_id {id_type}, rank int, id {id_type}, score double")
    if not width or not n_queries or n < 1:
        return empty
    moments = second_moments(rows, width)
    _, vectors = np.linalg.eigh(moments)  # of X'X: the right singular vectors of X
    rotation = np.ascontiguousarray(vectors[:, ::-1])

    size = max(64, min(BLOCK, BLOCK_VALUES // width))
    # equal lengths are split by the id, so that many of one make several parts
    ordered = rows.repartitionByRange(max(1, -(-n // size)), F.col("norm").desc(), F.xxhash64("id"))
    # blocks are numbered anew, the longest vectors first
    blocks = scratch.table(_blocks(ordered.select("id", "vector", "norm"), size, id_type).withColumn("part", F.shiftright("block", 32)))
    lengths = scratch.table(blocks.select("part", "block", "most"))
    parts = lengths.agg(F.max("part")).first()[0] + 1
    queries = rows.where("is_query").dropDuplicates(["id"]).select("id", "vector", "norm")
    q_size = max(16, min(QUERY_BLOCK, size))
    queries = _blocks(queries.repartition(max(1, -(-n_queries // q_size)), "id"), q_size, id_type)
    queries = scratch.table(queries.select(F.col("block").alias("q_block"), F.col("most").alias("q_most"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("sizes").alias("q_sizes")))

    def run(batches):
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                q = _unpack(col["q_data"][i], col["q_sizes"][i], width)
                v = _unpack(col["data"][i], col["sizes"][i], width)
                q_ids, v_ids, least_ids = (np.asarray(col[c][i].values) for c in ("q_ids", "ids", "least_ids"))
                least = np.asarray(col["least"][i].values, float)
                a, b, score = meet(q, q_ids, least, v, v_ids, rotation, k, least_ids)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[a]), pa.array(v_ids[b]), pa.array(score)], names=["query_id", "id", "score"])

    def best(found: DataFrame) -> DataFrame:
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    # a query block is sent to each part of the vectors by number: a stated query set in blocks
    none = F.lit(float("-inf"))
    top, a, b = None, 0, 1
    while a < parts:
        if top is None:
            known = queries.select("q_block", "q_most", F.transform("q_ids", lambda _: none).alias("least"), F.col("q_ids").alias("least_ids"))
        else:
            kth = top.where(F.col("rank") == k).select("query_id", F.col("score").alias("s"), F.col("id").alias("i"))
            members = queries.select("q_block", "q_most", F.posexplode("q_ids").alias("at", "query_id")).join(kth, "query_id", "left")
            # without a k-th score the id never decides
            one = F.struct("at", F.coalesce("s", none).alias("s"), F.coalesce("i", "query_id").alias("i"))
            known = members.groupBy("q_block", "q_most").agg(F.array_sort(F.collect_list(one)).alias("x")).select("q_block", "q_most", F.col("x.s").alias("least"), F.col("x.i").alias("least_ids"))
        known = scratch.table(known)
        # the lengths alone decide which blocks meet, before any vector moves
        asked = known.select("q_block", "q_most", F.array_min("least").alias("floor"), F.explode(F.sequence(F.lit(a), F.lit(min(b, parts) - 1)).cast("array<bigint>")).alias("part"))
        pairs = asked.join(small_side(lengths), "part").where(F.col("q_most") * F.col("most") * (1 + 1e-9) + 1e-9 >= F.col("floor")).select("q_block", "block")
        pairs = scratch.table(pairs)
        if not pairs.limit(1).count():
            break  # nor can shorter ones
        met = pairs.join(known.select("q_block", "least", "least_ids"), "q_block").join(queries, "q_block").join(blocks, "block")
        found = met.select("q_ids", "q_data", "q_sizes", "ids", "data", "sizes", "least", "least_ids").mapInArrow(tidy(run), f"query_id {id_type}, id {id_type}, score double")
        merged = scratch.table(best(found if top is None else found.union(top.select("query_id", "id", "score"))))
        scratch.drop(*([top] if top is not None else []), known, pairs)
        top, a, b = merged, b, b + GROWTH * (b - a)
    return top
