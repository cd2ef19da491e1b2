"""BPE and packing against the tokenizers library and plain Python."""

import os
import random
import struct
import zlib
from collections import defaultdict

os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tilespark.llm import bpe, packing, queries

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("start", T.IntegerType())])
TEXTS = [None, "", "a", "word " * 3000, "x" * 20000, "it's  I'll\n\n ''s", "<|endoftext|> and<|endoftext|>", "naïve 中文 \U0001f600", "same", "same", " ", "\n \n"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash", 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_encoding_equals_the_library(tokenizer):
    rnd = random.Random(5)
    parts = ["'s", "'t", "'re", "'ve", "'ll", "'d", "'m", " ", "  ", "\n", "a", "zb", "1", "é", "!", "<|endoftext|>", "　", "\x85", "\x1c", "THE", "tion"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(rnd.randint(0, 9))) for _ in range(500)]
    own, ranks = bpe.Bpe(), bpe.RankBpe()
    raw = [t.encode() for t in texts]
    got = own.encode_batch(raw)
    assert got == ranks.encode_batch(raw)
    for text, ids in zip(texts, got):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids).decode() == tokenizer.decode(want, skip_special_tokens=False) == text


def test_encode_decode(docs, tokenizer):
    rows = bpe.encode_decode(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids)) == (len(want), struct.pack(f"<{len(want)}I", *want))
        assert bytes(r.decoded).decode() == text


def check_packing(rows, texts, tokenizer, width=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        copies = texts.count((doc, text))
        got = sorted(by_doc[doc], key=lambda r: r.start)
        assert sum(r.length for r in got) == copies * len(ids)
        if copies == 1:
            at = 0
            for r in got:
                assert r.start == at
                at += r.length
        for r in got:
            assert r.doc_tokens == len(ids)
            piece = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width and at & (at - 1) == 0  # nothing is padded


def test_packing(spark, docs, tokenizer, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op1_packing(spark, str(tmp_path)).collect()
    check_packing(rows, [*enumerate(TEXTS), (3, TEXTS[3])], tokenizer)


def test_packing_of_the_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check_packing(queries.op1_packing(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs], tokenizer)


def test_packing_in_small_blocks_and_of_nothing(docs, tokenizer):
    rows = packing.pack(docs, width=64, block_docs=2).collect()
    assert sum(r.length for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*TEXTS, TEXTS[3]])
    assert packing.pack(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        packing.pack(docs, width=100)


def test_balance_fills_and_evens_out():
    rnd = random.Random(2)
    sizes = [rnd.randint(1, 1023) for _ in range(700)]
    made, full = packing.balance(sizes, 1024, 1.0, 1 / 1024)
    assert all(sum(n for _, _, n in x) == 1024 for x in made[:full]) and len(made) - full <= 1
    cost = [sum(n + n * n / 1024 for _, _, n in x) for x in made[:full]]
    room, first_fit = [], []
    for s in sorted(sizes, reverse=True):
        k = next((k for k, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(1024)
            first_fit.append(0.0)
        room[k] -= s
        first_fit[k] += s + s * s / 1024
    assert np.std(cost) < np.std(first_fit)
