"""The n-gram Jaccard join against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from tilespark.llm import queries, similarity

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType()), T.StructField("fp", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, words):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= words:
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    return {tuple(w)} if w else set()


def brute(rows, words, percent):
    """Components by comparing any two documents that share a shingle."""
    sets = [shingle_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in by[x]:
                shared[j] += 1
        for j, both in shared.items():
            if j < i and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def run(df, **kw):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in similarity.ngram_jaccard_join(df, **kw).collect())


def family(rnd, n, size, edits):
    vocab = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(vocab) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            k = rnd.randrange(len(w))
            w[k] = rnd.choice(vocab)
            if rnd.random() < 0.2:
                del w[k]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 100)])
def test_against_brute_force(spark, words, percent):
    rnd = random.Random(words)
    texts = [None, "", " \n\t", "One", "one", "one two", "ONE two", "é", "É", "x " * 40]
    for size in (6, 9, 10, 11, 14, 19, 40, 150, 600):
        texts += family(rnd, 14, size, 1 + size // 12)
    texts += ["the same text in many rows and more " * 3] * 60
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {' '.join(f'u{k}x{i}' for i in range(80))}" for k in range(60)]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(5)
    assert run(df, words=words, percent=percent) == brute(rows, words, percent)


def test_repeated_ids_nulls_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text, "", ""), (1, text, "", ""), (None, text, "", ""), (None, None, "", ""), (7, text + " more", "", "")], SCHEMA)
    got = similarity.ngram_jaccard_join(df, words=3, percent=90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == [("1", 48, "1"), ("1", 48, "1"), ("7", 49, "1"), ("None", 0, "None"), ("None", 48, "1")]
    assert similarity.ngram_jaccard_join(df.limit(0)).collect() == []


def test_prefix_length_is_safe():
    for percent in (80, 90, 100):
        for n in range(1, 300):
            k = similarity.prefix_length(n, percent)
            for m in range(n, n * 100 // percent + 1):
                most = max(0, (n + m) * (100 - percent) // (100 + percent))  # in one of the sets only
                if m == n and most == 0:
                    continue
                if most:
                    assert k > n - -(-n * percent // 100), (n, m)


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op4_jaccard_join(spark, sf_dir).collect())
    assert got == brute(rows, 3, 90)


def test_shingles_take_distinct_hashes():
    texts = [b"a b c d", b"ab c d", b"a bc d", b"", b"A B C D"]
    x = similarity.shingles(texts, 3)
    assert len(x[0]) == 2 and len(x[3]) == 0 and np.array_equal(x[0], x[4])
    assert x[1][0] != x[2][0]


def test_sketches_never_rule_out_similar_sets():
    rnd = np.random.default_rng(0)
    for n in (9, 20, 100, 700, 5000):
        for percent in (80, 90):
            a = similarity.distinct(rnd.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            for extra in (0, n // 20, n // 8):
                b = similarity.distinct(np.concatenate([a[extra:], rnd.integers(0, 1 << 63, extra).astype(np.uint64)]))
                apart = 2 * extra
                assert similarity.differing(similarity.sketch(a, percent), similarity.sketch(b, percent)) <= apart


def test_overlaps_and_joining_edges():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        x, y = ([np.unique(rnd.integers(0, 60, rnd.integers(1, 30))) for _ in range(n)] for n in rnd.integers(1, 9, 2))
        got, union = similarity.overlaps(x, y, 60), set(np.concatenate(y).tolist())
        for i, a in enumerate(x):
            opened = len(set(a.tolist()) & union) * 100 >= 60 * len(a)
            assert got[i].tolist() == [len(np.intersect1d(a, b)) if opened else 0 for b in y]
    a, b = np.array([1, 2, 3, 1, 9, 3]), np.array([2, 3, 1, 3, 8, 9])
    assert similarity.joining(a, b) == [0, 1, 4, 5]


def test_a_family_gives_links_in_proportion(spark, monkeypatch, percent=90):
    """Near copies, many of them just below the similarity: what the comparisons return grows
    with the family, not with its pairs."""
    made = []
    kept = similarity._links

    def counted(*args):
        out = kept(*args)
        made[-1] += out.count()
        return out

    monkeypatch.setattr(similarity, "_links", counted)
    monkeypatch.setattr(similarity, "GROUP_BLOCK", 16)
    rnd = random.Random(6)
    base = [rnd.randrange(5000) for _ in range(120)]
    for n in (60, 120):
        texts = []
        for _ in range(n):
            w = list(base)
            for k in rnd.sample(range(len(w)), rnd.randint(2, 4)):
                w[k] = rnd.randrange(5000)
            texts.append(" ".join(f"w{x}" for x in w))
        rows = list(enumerate(texts))
        made.append(0)
        df = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA).repartition(3)
        assert run(df, words=3, percent=percent) == brute(rows, 3, percent)
        assert made[-1] <= 3 * n
