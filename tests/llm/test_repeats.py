"""Removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from tilespark.llm import queries, repeats

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc", T.StringType()), T.StructField("value", T.IntegerType())])


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, np.int64)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length if i + length < len(gone) else -1] -= 1
        gone = np.cumsum(gone)[: len(x)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(4).write.parquet(path)
    got = queries.op5_suffix_dedup(spark, str(tmp_path)).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def noise(rnd, n, letters="abcdefghij é\n"):
    return "".join(rnd.choice(letters) for _ in range(n))


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    a, b, c = noise(rnd, 700), noise(rnd, 205), noise(rnd, 199)
    texts = [None, "", "short", "short", "z" * 900, "z" * 199, "ab" * 400, c + "1", c + "2", a, a, a[:350] + "#" + a[351:]]
    for k in range(40):
        texts.append(noise(rnd, rnd.randint(0, 300)) + a[rnd.randint(0, 300) : rnd.randint(350, 700)] + noise(rnd, rnd.randint(0, 300)))
        texts.append(noise(rnd, rnd.randint(0, 60)) + b + noise(rnd, rnd.randint(0, 60)))
    for k in range(30):  # edits at all distances
        x = list(a)
        for _ in range(rnd.randint(1, 6)):
            x[rnd.randrange(len(x))] = rnd.choice("XYZ")
        texts.append("".join(x))
    texts.append(a[:230] * 3)
    rows = list(enumerate(texts))
    want = sorted((i, *x) for (i, _), x in zip(rows, brute(texts)))
    assert run(spark, rows, tmp_path) == want


def test_repeated_rows(spark, tmp_path):
    rnd = random.Random(4)
    a = noise(rnd, 400)
    rows = [(1, a), (1, a), (None, a), (2, None), (2, noise(rnd, 500)), (2, noise(rnd, 500))]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).write.parquet(path)
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, str(tmp_path)).collect())
    assert got == Counter(brute([t for _, t in rows]))


def test_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows])))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_dedup(spark, sf_dir).collect())
    assert got == want


def test_bucket_pointers_sort_and_join_equal_strings():
    rnd = random.Random(6)
    for length in (8, 9, 16, 24, 131, 200):
        data = np.frombuffer(("".join(rnd.choice("ab") for _ in range(300)) * 3 + noise(rnd, 300)).encode(), np.uint8)
        starts = np.arange(len(data) - length + 1)
        rnd_starts = np.sort(np.array(rnd.sample(list(starts), len(starts) // 2)))
        for at in (starts, rnd_starts):
            bucket = repeats.windows_in_order(data, at, length)
            strings = [data[i : i + length].tobytes() for i in at]
            order = np.argsort(bucket, kind="stable")
            assert [strings[i] for i in order] == sorted(strings)
            assert len(set(bucket.tolist())) == len(set(strings))


def test_settling_copies_only_what_goes_out():
    import tracemalloc

    n = 2_000_000
    keys = np.arange(n, dtype=np.uint64)
    keys[: n // 4] = keys[n // 4 : n // 2]
    columns = {c: np.arange(k, n + k) for k, c in enumerate(("doc", "anchor", "key", "value"))}
    twice = repeats.repeated(keys)
    tracemalloc.start()
    marks = Counter()
    for batch in repeats._settle(keys, columns, twice):
        for mark, count in Counter(batch.column(1).to_numpy().tolist()).items():
            marks[mark] += count
        if batch.column(1)[0].as_py() == repeats.ONCE:
            assert batch.column(0).equals(batch.column(2))  # the key of a row seen once is its route
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert marks == {repeats.ONCE: n // 2, repeats.KNOWN: n // 2, repeats.STANDS: n // 4}
    assert most < 40 * n  # one copy of the rows
