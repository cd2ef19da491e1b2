"""Cost-balanced packing of documents into training sequences.

The cost of a piece of n tokens in a sequence is estimated as ``linear * n +
quadratic * n ** 2`` (projections and feed-forward layers grow with n, attention
within a document with its square).  Documents are taken in descending order; each
goes to the sequence of the lowest cost that still has room for it.

A document longer than a sequence first gives whole sequences; what is left of it
takes part in the balancing.  Where no sequence has room, the document is cut at the
room of the cheapest one.  The sequences of a block hold exactly the block's tokens;
only the last may be short, and its pieces move on to the next block.  The last short
sequence of a partition is cut into lengths that are powers of two, which need no
padding, so nothing is padded at all.

Blocks are local to a partition: no shuffle, memory bounded by a block, and a lost
task is redone alone with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tilespark.llm.bpe import RankBpe, model, slices, texts_of
from tilespark.llm.common import tidy

#: A sequence's id: the partition's number times this, plus a count within it.
IDS_PER_PARTITION = 1 << 36


def balance(sizes: list[int], width: int, linear: float, quadratic: float) -> tuple[list[list[tuple[int, int, int]]], int]:
    """Packs items of at most ``width`` tokens.

    Returns the pieces (item, start within it, length) of each sequence, and the number
    of sequences that are full; one short sequence may follow them.
    """
    total = sum(sizes)
    if not total:
        return [], 0
    count = -(-total // width)
    room = np.full(count, width, np.int64)
    room[-1] = total - (count - 1) * width
    full = count - (room[-1] < width)
    cost = np.zeros(count)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        start, left = 0, sizes[item]
        while left:
            fits = np.where(room >= left, cost, np.inf)
            k = int(fits.argmin())
            if fits[k] == np.inf:
                k = int(np.where(room > 0, cost, np.inf).argmin())
            n = min(left, int(room[k]))
            out[k].append((item, start, n))
            room[k] -= n
            cost[k] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out, int(full)


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a short sequence, cut into sequences of powers of two."""
    total = sum(n for _, _, n in pieces)
    out, queue = [], pieces[::-1]
    for bit in reversed(range(total.bit_length())):
        want = total & 1 << bit
        if want:
            out.append([])
        while want:
            item, start, n = queue.pop()
            if n > want:
                queue.append((item, start + want, n - want))
                n = want
            out[-1].append((item, start, n))
            want -= n
    return out


class _Packer:
    def __init__(self, width: int, linear: float, quadratic: float, first_id: int):
        self.width, self.linear, self.quadratic, self.next = width, linear, quadratic, first_id
        self.docs: list[tuple[object, np.ndarray]] = []
        self.tokens = 0
        self.carried: list[tuple[object, int, np.ndarray, int]] = []  # id, start, tokens, tokens of the document

    def add(self, key, ids: np.ndarray) -> None:
        self.docs.append((key, ids))
        self.tokens += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """(id, start, tokens, tokens of the document, sequence, offset) of what is placed."""
        rows: list[tuple] = []
        width, items = self.width, self.carried
        for key, ids in self.docs:
            n = len(ids)
            whole = n // width * width
            for start in range(0, whole, width):
                rows.append((key, start, ids[start : start + width], n, self.next, 0))
                self.next += 1
            if n > whole:
                items.append((key, whole, ids[whole:], n))
        made, full = balance([len(x[2]) for x in items], width, self.linear, self.quadratic)
        short = made[full:]
        for pieces in made[:full] + (powers(short[0]) if short and last else []):
            offset = 0
            for item, start, n in pieces:
                key, base, ids, size = items[item]
                rows.append((key, base + start, ids[start : start + n], size, self.next, offset))
                offset += n
            self.next += 1
        self.carried = [] if last else [(items[i][0], items[i][1] + s, items[i][2][s : s + n], items[i][3]) for x in short for i, s, n in x]
        self.docs, self.tokens = [], 0
        return rows


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    path: str | None = None,
    block_docs: int = 4096,
    block_tokens: int = 4_000_000,
) -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` holds the piece's tokens as little-endian unsigned 32-bit integers.  Every
    document ends with ``end_id``.  Null and empty texts are documents of that token
    alone; repeated rows are packed each; an empty table gives no rows.  ``width``
    must be a power of two.  Only the two named columns are read.
    """
    if width < 1 or width & (width - 1):
        raise ValueError("width must be a power of two")

    def run(batches):
        bpe = model(path, RankBpe)
        context = TaskContext.get()
        packer = _Packer(width, linear, quadratic, (context.partitionId() if context else 0) * IDS_PER_PARTITION)
        end = np.array([end_id], "<u4").tobytes()

        def out(rows):
            for at in range(0, len(rows), 2_000):
                cols = list(zip(*rows[at : at + 2_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array([len(x) for x in cols[2]], pa.int64()), pa.array([x.tobytes() for x in cols[2]], pa.binary()), *(pa.array(x, pa.int64()) for x in cols[3:])],
                    names=schema.names,
                )

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch, "text"):
                for key, ids in zip(part.column(0).to_pylist(), bpe.encode_batch(texts_of(part.column(1)))):
                    packer.add(key, np.frombuffer(ids + end, "<u4"))
                    if len(packer.docs) >= block_docs or packer.tokens >= block_tokens:
                        yield from out(packer.flush(False))
        if packer.docs or packer.carried:
            yield from out(packer.flush(True))
        # the worker goes on to other stages
        bpe.cache.clear()
        del bpe
        model.cache_clear()

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    long = T.LongType()
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("start", long), T.StructField("length", long), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long)])
    return src.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
