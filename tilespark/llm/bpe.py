"""Byte-level BPE: pre-tokenisation, encoding by merge ranks, decoding.

Encoding follows the priority-queue form of BPE.  The symbols of a piece form a
doubly linked list; a heap holds the ranks of mergeable neighbours; an entry is
stale, and is skipped, when one of its symbols has been merged since it was put in.
A piece of n bytes takes O(n log n), so a text without any white space is no
special case.  Decoding concatenates the vocabulary's strings.

Nulls count as the empty text.  An empty text has no ids.  Strings of special
tokens inside a text become those tokens, as in the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Entries of a worker's piece cache; a full cache is emptied, which costs time only.
CACHE_PIECES = 300_000
#: Longer pieces are encoded each time.
CACHE_BYTES = 64
#: Bytes of text that are split into pieces at once.
SLICE_BYTES = 2 << 20

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    keep = set(plain)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """Class of each code point: letter (L*), number (N*), white space, other."""
    out = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    category = unicodedata.category
    for c in range(0x110000):
        if k := kinds.get(category(chr(c))[0]):
            out[c] = k
    # White_Space of Unicode
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of valid UTF-8 belongs to."""
    table = code_point_classes()
    cls = table[data]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        lead = data[high].astype(np.int32)
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        tail = [padded[high + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        code = np.where(
            lead < 0xE0,
            (lead & 0x1F) << 6 | tail[0],
            np.where(lead < 0xF0, (lead & 0x0F) << 12 | tail[0] << 6 | tail[1], (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]),
        )
        cls[high] = table[np.minimum(code, 0x10FFFF)]
        follow = np.flatnonzero((data & 0xC0) == 0x80)
        for _ in range(3):
            cls[follow] = cls[follow - 1]
    return cls


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of the concatenated texts begin; texts begin at ``starts``.

    A run of letters, of numbers or of other characters is a piece, with one space
    before it if there is one.  Of white space before such a run the last character
    stands alone unless it is that space.  An apostrophe that begins a piece forms
    one with s, t, m, d, re, ve or ll after it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(data)
    first = np.zeros(n + 1, bool)
    first[starts[starts < n]] = True
    first[n] = True
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(cls[1:], cls[:-1], out=begin[1:])
    begin |= first[:n]
    space = cls == SPACE
    # the last character of white space that has text after it
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    after = last + 1
    plain = data[last] == 0x20
    begin[after[plain]] = False
    at = last.copy()
    for _ in range(3):  # to the lead byte of a wide white space
        at -= (data[at] & 0xC0) == 0x80
    begin[at] = True
    quote = np.flatnonzero((data == 0x27) & begin)
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        ends = np.flatnonzero(first)
        room = ends[np.searchsorted(ends, quote, "right")] - quote
        one, two = padded[quote + 1], padded[quote + 2]
        short = (room >= 2) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = one.astype(np.int32) << 8 | two
        long = (room >= 3) & np.isin(pair, [ord(x[0]) << 8 | ord(x[1]) for x in ("re", "ve", "ll")])
        size = np.where(short, 2, np.where(long, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = first[quote + 1]
        ends = quote + size
        begin[ends[ends < n]] = True
    return np.flatnonzero(begin)


class Bpe:
    """A byte-level BPE vocabulary read from a ``tokenizers`` file."""

    def __init__(self, path: str | None = None):
        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        of = {c: b for b, c in enumerate(letters)}
        self.specials = {x["content"].encode(): x["id"] for x in spec.get("added_tokens", [])}
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for word, i in vocab.items():
            self.strings[i] = bytes(of[c] for c in word) if all(c in of for c in word) else word.encode()
        for word, i in self.specials.items():
            self.strings[i] = word
        self.byte_ids = [vocab[c] for c in letters]
        #: (left id, right id) as one integer -> (rank, merged id) as one integer
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        self.cache: dict[bytes, bytes] = {}

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        ranks = self.merges
        # an entry is rank, position of the left symbol, and the two ids it was made for
        heap = [(m >> 32, i, ids[i], ids[i + 1], m & 0xFFFFFFFF) for i in range(n - 1) if (m := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            _, i, left, right, merged = heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := ranks.get(merged << 32 | ids[k])) is not None:
                    heappush(heap, (m >> 32, i, merged, ids[k], m & 0xFFFFFFFF))
            if (h := before[i]) >= 0 and (m := ranks.get(ids[h] << 32 | merged)) is not None:
                heappush(heap, (m >> 32, h, ids[h], merged, m & 0xFFFFFFFF))
        return [x for x in ids if x >= 0]

    def look_up(self, piece: bytes) -> bytes:
        out = array("I", self.piece(piece)).tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[bytes] = []
        size = 0
        for x in texts:
            if any(s in x for s in self.specials):
                out += self._group(group)
                group, size = [], 0
                out.append(self._with_specials(x))
                continue
            group.append(x)
            size += len(x)
            if size >= SLICE_BYTES:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _with_specials(self, text: bytes) -> bytes:
        parts, at = [], 0
        while True:
            found = [(p, -len(s), s) for s in self.specials if (p := text.find(s, at)) >= 0]
            if not found:
                parts += self._group([text[at:]])
                return b"".join(parts)
            p, _, s = min(found)
            parts += [*self._group([text[at:p]]), np.array([self.specials[s]], "<u4").tobytes()]
            at = p + len(s)

    def _group(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        data = b"".join(texts)
        ends = np.cumsum([len(x) for x in texts])
        cuts = piece_starts(np.frombuffer(data, np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64))
        per = np.searchsorted(cuts, ends).tolist()
        at = cuts.tolist()
        at.append(len(data))
        known, look_up = self.cache.get, self.look_up
        ids = [known(p := data[a:b]) or look_up(p) for a, b in zip(at, at[1:])]
        out, last = [], 0
        for k in per:
            out.append(b"".join(ids[last:k]))
            last = k
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class RankBpe(Bpe):
    """The same ids where only they matter: ``tiktoken`` merges a piece that is not in the
    cache.  It takes ids as ranks, so a vocabulary whose ids are not in the order of its
    merges falls back on the parent's merging."""

    def __init__(self, path: str | None = None):
        super().__init__(path)
        import tiktoken

        ranks = [m >> 32 for m in self.merges.values()]
        made = [m & 0xFFFFFFFF for m in self.merges.values()]
        self.ordered = ranks == sorted(ranks) and made == sorted(made) and max(self.byte_ids) < min(made, default=1 << 40)
        if self.ordered:
            own = {self.strings[i]: i for i in [*self.byte_ids, *made]}
            self.core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=own, special_tokens={})

    def piece(self, piece: bytes) -> list[int]:
        return self.core._encode_single_piece(piece) if self.ordered else super().piece(piece)


@lru_cache(4)
def model(path: str | None, kind: type = Bpe) -> Bpe:
    """One per Python worker."""
    return kind(path)


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each value; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """Parts of a batch with about ``limit`` bytes of text (one row at least)."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0))
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row: ``ids`` little-endian unsigned 32-bit
    integers in one binary value, ``decoded`` the UTF-8 of their strings.

    A map without a shuffle.  Null text: as the empty text, no tokens.  Repeated rows
    give repeated results; other columns are not read.
    """

    def run(batches):
        bpe = model(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = bpe.encode_batch(texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                    names=["id", "n_tokens", "ids", "decoded"],
                )

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
