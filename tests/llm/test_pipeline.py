"""Every stage of the pipeline against brute force on its own input."""

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rsplit("/", 1)[0])
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import test_bpe_packing
import test_secrets_quality
import test_similarity

from tilespark.llm import bpe, common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(9001, None, None, "s", 0), (9002, "123 456", "en", "s", 7), (9003, "x " * 3000, None, None, None), (9004, "Fresh words stand here alone, with many a letter in them.", "en", "s", 5)]
    odd += [(9005, docs.first()["text"], "en", "s", 1)] * 2
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        frames.append(docs)
    return [x.collect() for x in frames]


def test_columns(stages):
    for rows in stages[1:-1]:
        assert list(rows[0].asDict()) == COLUMNS


def test_language_keeps_clean_documents(stages):
    ids = Counter(r.doc_id for r in stages[1])
    assert not {9001, 9002} & set(ids) and {9003, 9004, 9005} <= set(ids)
    lettered = [r for r in stages[0] if r.text and any(c.isalpha() for c in r.text)]
    assert sum(ids.values()) >= 0.99 * len(lettered)
    assert all(r.lang for r in stages[1])


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    want = {d for d, _, c in test_similarity.brute(rows, 5, 80) if d == c}
    assert Counter(r.doc_id for r in stages[2]) == Counter(want)


def test_repeats_are_cut(stages):
    raw = {r.doc_id: r.text.encode() for r in stages[2]}
    n = corpus_pipeline.REPEAT_BYTES
    count = Counter(x[i : i + n] for x in raw.values() for i in range(len(x) - n + 1))
    want = {}
    for d, x in raw.items():
        keep = np.ones(len(x), bool)
        for i in range(len(x) - n + 1):
            if count[x[i : i + n]] > 1:
                keep[i : i + n] = False
        left = bytes(np.frombuffer(x, np.uint8)[keep])
        if keep.all() or left.decode("utf-8", "ignore").strip():
            want[d] = left.decode("utf-8", "ignore")
    assert {r.doc_id: r.text for r in stages[3]} == want
    assert all(r.n_chars == len(r.text) for r in stages[3] if r.text.encode() != raw[r.doc_id])


def test_secrets_are_masked(stages):
    after = {r.doc_id: r.text for r in stages[4]}
    assert set(after) == {r.doc_id for r in stages[3]}
    for r in stages[3]:
        assert not test_secrets_quality.base_spans(after[r.doc_id])
        if not test_secrets_quality.base_spans(r.text) and "[REDACTED]" not in after[r.doc_id]:
            assert after[r.doc_id] == r.text


def test_packing_holds_every_token(stages):
    tokenizer = Tokenizer.from_file(bpe.default_path())
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4])
    assert sum(r.length for r in stages[5]) == want
    assert test_bpe_packing.packing.IDS_PER_PARTITION > len(stages[5])


def test_run(spark, tmp_path, sf_dir, stages):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_near_duplicates_of_odd_rows(spark, sf_dir):
    rnd = np.random.default_rng(2)
    a, b, c, d = (" ".join(f"w{x}" for x in rnd.integers(0, 9000, 60)) for _ in range(4))
    rows = [(1, a, "en", "s", 1), (1, a, "de", "s", 1), (1, b, None, None, None), (None, a, "en", "s", 1), (None, c, "en", "s", 1), (None, d, "en", "s", 1), (2, a + " more", "en", "s", 1), (3, None, "en", "s", 1), (3, None, "en", "s", 1), (4, None, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, kept_row string")
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, a), (1, b), (None, c), (None, d), (3, None), (4, None)])


def test_stages_of_an_empty_table_and_of_further_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            more = docs.where("doc_id < 12").selectExpr("*", "'a' as rest", "'b' as label", "'c' as spans", "'d' as removed")
            out = stage(spark, more, sf_dir)
            assert out.columns == more.columns
            assert {(r.rest, r.label, r.spans, r.removed) for r in out.collect()} == {("a", "b", "c", "d")}


def test_very_long_texts(spark, sf_dir):
    rnd = np.random.default_rng(3)
    text = " ".join(f"word{x}" for x in rnd.integers(0, 50_000, 150_000))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "Short and clean words stand here.", "en", "s", 33)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), docs.schema)
    assert {r.doc_id for r in kept.collect()} == {1, 2}


def test_batches_to_python_stay_small(spark):
    docs = spark.range(5000, numPartitions=1).selectExpr("id as doc_id", "repeat('a word ', 300) as text", "'en' as lang", "'s' as source", "2100L as n_chars")
    corpus_pipeline.ship(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 6_000_000


def test_batches_from_python_stay_small():
    rows = pa.RecordBatch.from_pydict({"id": list(range(3000)), "text": ["x" * 3000] * 3000})
    out = list(common.tidy(lambda batches: batches)(iter([rows])))
    assert pa.Table.from_batches(out).equals(pa.Table.from_batches([rows]))
    assert max(b.nbytes for b in out) <= 1.1 * common.BATCH_BYTES
    one = pa.RecordBatch.from_pydict({"text": ["x" * 3_000_000]})
    assert [b.num_rows for b in common.tidy(lambda batches: batches)(iter([one]))] == [1]


def test_batches_to_python_fit_a_chunk(spark):
    docs = spark.range(5000, numPartitions=1).selectExpr("id as doc_id", "repeat('a word ', 300) as text")
    corpus_pipeline.ship(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 2_000_000


def test_packing_leaves_no_vocabulary_in_workers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    assert corpus_pipeline.packing(spark, docs, sf_dir).count()

    def left(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [bpe.model.cache_info().currsize]})

    assert max(r.n for r in spark.range(64).mapInArrow(left, "n long").collect()) == 0
