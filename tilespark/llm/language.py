"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in strips of ``STRIP`` bytes, in both directions; the two states at a
position give a distribution over the languages for it, so every position is labelled.
A document's probabilities are the mean over all its positions.  Strips make long texts
as parallel as short ones; each is read with ``CONTEXT`` bytes more on either side (blanks
beyond the text), so that a position at a strip's edge has both contexts too.

The network is written in numpy: the input weights are one row per byte value, the gates
are those of a GRU, and training is backpropagation through time with Adam.  It is
trained on the driver on pieces of a bounded sample of labelled rows; its weights (some
tens of kB, whatever the corpus) go to the executors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.bpe import slices, texts_of
from tilespark.llm.common import fresh, let_go

#: Labelled rows that the network learns from, at most, of each language and in all; but
#: up to ``LEAST_ROWS`` of each language, however many languages there are.
ROWS_PER_LANGUAGE, LEARNING_ROWS, LEAST_ROWS = 400, 4000, 10
#: What is learned from a row: so many pieces of it at most, from anywhere in it, and a
#: piece's characters.
PIECES, PIECE_CHARS = 8, 512
#: Bytes of a strip, those read on either side of it, and those of a strip in training.
STRIP, CONTEXT, LEARNED_STRIP = 128, 16, 64
HIDDEN = 8
#: Strips that are read side by side.
LANES = 2048
UNKNOWN = "und"


@dataclass
class Network:
    """``x``: (2, 256, 3 H) input rows by direction; ``u``: (2, H, 2 H) to the gates;
    ``c``: (2, H, H) to the candidate; ``w``, ``b``: output.  Gates are update, reset."""

    labels: list[str]
    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    w: np.ndarray
    b: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        rnd = np.random.default_rng(seed)

        def init(*shape):
            return rnd.normal(0, 0.3, shape).astype(np.float32)

        return cls(labels, init(2, 256, 3 * hidden), init(2, hidden, 2 * hidden), init(2, hidden, hidden), init(2 * hidden, len(labels)), np.zeros(len(labels), np.float32))

    def states(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(steps, 2, lanes, H) states for bytes (steps, lanes); at ``[t]`` the first
        direction has read bytes 0..t, the second bytes t..end.  ``keep`` collects what
        training needs of each step."""
        steps, lanes = data.shape
        h_size = self.c.shape[1]
        rows = self.x.reshape(512, 3 * h_size)
        both = np.stack([data.astype(np.int64), data[::-1].astype(np.int64) + 256], axis=1)
        h = np.zeros((2, lanes, h_size), np.float32)
        out = np.empty((steps, 2, lanes, h_size), np.float32)
        for t in range(steps):
            x = rows.take(both[t], axis=0)
            gates = np.matmul(h, self.u)
            gates += x[..., : 2 * h_size]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5  # the logistic function
            z, r = gates[..., :h_size], gates[..., h_size:]
            rh = r * h
            n = np.matmul(rh, self.c)
            n += x[..., 2 * h_size :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((both[t], h, z, r, rh, n))
            step = n - h
            step *= z
            h = h + step
            out[t, 0], out[steps - 1 - t, 1] = h[0], h[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states[:, 0] @ self.w[: self.c.shape[1]]
        logits += states[:, 1] @ self.w[self.c.shape[1] :]
        logits += self.b
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions with ``mask``, and its gradients."""
        kept: list = []
        states = self.states(data, kept)
        steps, h_size = len(data), self.c.shape[1]
        p = self.probabilities(states)
        total = max(1, mask.sum())
        lanes = np.arange(data.shape[1])
        loss = -float((np.log(p[:, lanes, label] + 1e-9) * mask).sum() / total)
        d = p.copy()
        d[:, lanes, label] -= 1
        d *= (mask / total)[..., None]
        gw = np.concatenate([np.einsum("tlh,tlk->hk", states[:, k], d) for k in (0, 1)])
        gb = d.sum((0, 1))
        back = np.stack([d @ self.w[:h_size].T, (d @ self.w[h_size:].T)[::-1]], axis=1)
        gx = np.zeros((512, 3 * h_size), np.float32)
        gu, gc = np.zeros_like(self.u), np.zeros_like(self.c)
        dh = np.zeros_like(kept[0][1])
        index, parts = [], []
        for t in reversed(range(steps)):
            rows, h, z, r, rh, n = kept[t]
            dh = dh + back[t]
            dn = dh * z * (1 - n * n)
            drh = np.matmul(dn, self.c.transpose(0, 2, 1))
            dz = dh * (n - h) * z * (1 - z)
            dr = drh * h * r * (1 - r)
            gates = np.concatenate([dz, dr], axis=-1)
            gu += np.matmul(h.transpose(0, 2, 1), gates)
            gc += np.matmul(rh.transpose(0, 2, 1), dn)
            dh = dh * (1 - z) + drh * r + np.matmul(gates, self.u.transpose(0, 2, 1))
            index.append(rows.ravel())
            parts.append(np.concatenate([gates, dn], axis=-1).reshape(-1, 3 * h_size))
        index, parts = np.concatenate(index), np.concatenate(parts)
        for k in range(3 * h_size):
            gx[:, k] = np.bincount(index, parts[:, k], 512)
        return loss, [gx.reshape(self.x.shape), gu, gc, gw.astype(np.float32), gb]

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c, self.w, self.b]


def train(samples: list[tuple[bytes, str]], *, hidden: int = HIDDEN, steps: int = 260, lanes: int = 256, rate: float = 0.02, seed: int = 0) -> Network | None:
    """A network for the labels of the samples; None without any.

    Each step draws languages evenly and strips from anywhere in their texts; a strip may
    begin before a text or end after it, with blanks there.
    """
    labels = sorted({y for x, y in samples if x})
    if not labels:
        return None
    net = Network.fresh(labels, hidden, seed)
    if len(labels) == 1:
        return net
    rnd = np.random.default_rng(seed + 1)
    own = {y: [np.frombuffer(x, np.uint8) for x, k in samples if k == y and x] for y in labels}
    weight = {y: np.cumsum([len(x) for x in own[y]]) for y in labels}
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    for step in range(1, steps + 1):
        data, mask = np.full((LEARNED_STRIP, lanes), 32, np.uint8), np.zeros((LEARNED_STRIP, lanes), np.float32)
        label = rnd.integers(0, len(labels), lanes)
        for k, y in enumerate(label):
            ends = weight[labels[y]]
            at = int(rnd.integers(0, ends[-1]))
            which = int(np.searchsorted(ends, at, "right"))
            text = own[labels[y]][which]
            start = at - (int(ends[which]) - len(text)) - int(rnd.integers(0, LEARNED_STRIP))
            start = max(-CONTEXT, min(start, len(text) + CONTEXT - LEARNED_STRIP))
            part = text[max(0, start) : start + LEARNED_STRIP]
            inside = slice(max(0, -start), max(0, -start) + len(part))
            data[inside, k], mask[inside, k] = part, 1
        _, grads = net.gradients(data, label, mask)
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
        now = rate * min(1.0, 2.0 - 2.0 * step / steps)
        for w, g, (m, v) in zip(net.weights(), grads, moments):
            g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, labels): the mean distribution over the positions of each text; zeros for an
    empty one."""
    sizes = np.array([len(x) for x in texts], np.int64)
    out = np.zeros((len(texts), len(net.labels)), np.float64)
    strips = -(-sizes // STRIP)
    total = int(strips.sum())
    if not total:
        return out
    room = strips * STRIP + 2 * CONTEXT
    base = np.cumsum(room) - room
    data = np.full(int(room.sum()), 32, np.uint8)
    for x, k in zip(texts, (base + CONTEXT).tolist()):
        data[k : k + len(x)] = np.frombuffer(x, np.uint8)
    read = np.lib.stride_tricks.sliding_window_view(data, STRIP + 2 * CONTEXT)
    first = np.cumsum(strips) - strips
    owner = np.repeat(np.arange(len(texts)), strips)
    nth = np.arange(total) - first[owner]
    at = base[owner] + nth * STRIP
    fill = np.minimum(sizes[owner] - nth * STRIP, STRIP)
    sums = np.empty((total, len(net.labels)), np.float64)
    for a in range(0, total, LANES):
        b = min(total, a + LANES)
        states = net.states(np.ascontiguousarray(read[at[a:b]].T))
        p = net.probabilities(states[CONTEXT : CONTEXT + STRIP])
        for k in np.flatnonzero(fill[a:b] < STRIP):
            p[fill[a + k] :, k] = 0
        sums[a:b] = p.sum(0)
    for k in range(len(net.labels)):
        out[:, k] = np.bincount(owner, sums[:, k], len(texts))
    return out / np.maximum(sizes, 1)[:, None]


def learning_rows(
    df: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    held_out: Column,
    *,
    rows_per_language: int = ROWS_PER_LANGUAGE,
    rows: int = LEARNING_ROWS,
    least_rows: int = LEAST_ROWS,
    pieces: int = PIECES,
    piece_chars: int = PIECE_CHARS,
) -> list[tuple[bytes, str]]:
    """Pieces of the same number of rows of each language (of all, where there are fewer),
    spread over the whole table by a hash of the id.  A row's pieces begin anywhere in its
    text; a short text is one piece."""
    src = df.where(df[lang_col].isNotNull() & df[text_col].isNotNull() & ~held_out)
    text, n = df[text_col], F.length(df[text_col])
    place = F.pmod(F.xxhash64(df[id_col]), F.lit(1 << 20)) / float(1 << 20)
    many = F.greatest(F.lit(1), F.least(F.lit(pieces), F.ceil(n / piece_chars).cast("int")))
    start = lambda j: F.pmod(F.xxhash64(df[id_col], j), F.greatest(n - piece_chars, F.lit(0)) + 1).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(1), many), lambda j: F.substring(text, start(j), F.lit(piece_chars)))
    src = src.select(df[id_col].alias("id"), df[lang_col].alias("lang"), place.alias("place"), cut.alias("pieces"))
    counts = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    quota = max(least_rows, min(rows_per_language, rows // len(counts)))

    def drawn(shares: dict[str, float]) -> list:
        # from Arrow, as rows of Python's would start further workers on the executors
        known = pa.table({"lang": pa.array(list(shares), pa.string()), "share": pa.array(list(shares.values()), pa.float64())})
        near = src.join(F.broadcast(df.sparkSession.createDataFrame(known)), "lang").where("place < share")
        order = Window.partitionBy("lang").orderBy("place", "id", "pieces")
        return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= quota).select("lang", "pieces", "place", "nth").collect()

    # a share of each language that is some deviations above the quota keeps the windows small
    found = drawn({k: min(1.0, (quota + 4 * quota**0.5 + 8) / n) for k, n in counts.items()})
    have = Counter(r["lang"] for r in found)
    short = {k: 1.0 for k, n in counts.items() if have[k] < min(quota, n)}
    if short:  # of many rows with few ids
        found = [r for r in found if r["lang"] not in short] + drawn(short)
    return [(x.encode(), r["lang"]) for r in sorted(found, key=lambda r: (r["place"], r["lang"], r["nth"])) for x in r["pieces"]]


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, **bounds: int) -> Network | None:
    """A network that is trained on the rows with a text and a language that are not held
    out; None if there is none.

    ``bounds`` are those of :func:`learning_rows`: what reaches the driver is a few pieces
    of each of some thousand rows, at least one row of every language.  A null
    ``held_out`` holds nothing out.  Repeated rows and rows of one id count each; empty
    texts teach nothing; one language alone is learned without training.
    """
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    return train(learning_rows(df, id_col, text_col, lang_col, held_out, **bounds))


def identify(df: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``, the pooled probability of that language.

    The whole text is read and nothing but the text.  Null texts, texts without a letter
    and all texts where nothing was learned get ``und`` and 0.  Columns of these two
    names are replaced, all others stay.  A row's result depends on its text alone, so
    repeated rows agree; an empty table stays empty.
    """
    src = df.drop("lang_pred", "score")
    if net is None:
        return src.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})

    def judged(column: pa.Array) -> pa.Array:
        texts = texts_of(column)  # empty exactly where null or without a letter
        p = pooled(net, texts)
        best = p.argmax(1)
        pred = [net.labels[k] if x else UNKNOWN for k, x in zip(best.tolist(), texts)]
        score = np.minimum(p[np.arange(len(best)), best], 1.0)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in batches:
                batch = pa.RecordBatch.from_arrays([column], names=["text"])
                parts = [judged(part.column(0)) for part in slices(batch, "text", 1 << 20)]
                yield pa.concat_arrays(parts) if parts else judged(column)
        finally:
            let_go()

    # only the text goes to Python, and only once however often its label is asked for
    asked = F.arrow_udf(label, "struct<lang_pred:string,score:double>").asNondeterministic()
    text = F.col(text_col)
    (name,) = fresh(src.columns, "label")
    out = src.withColumn(name, asked(F.when(text.rlike(r"\p{L}"), text)))
    return out.select(*(F.col(f"`{c}`") for c in src.columns), F.col(f"{name}.lang_pred").alias("lang_pred"), F.col(f"{name}.score").alias("score"))
