"""The queries of this subpackage over the shared tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.similarity import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), words=3, percent=90)


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.secrets import find_secrets, span_text

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.quality import judge, learn_from

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_from(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.language import fit, identify

    docs = table(spark, sf_dir, "documents")
    # a null id is not held out: its remainder is unknown
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    net = fit(docs, held_out=held_out)
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.urls import judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


@query
def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.topk import exact_top_k

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # a null or non-finite component stays what it is, so the operator leaves the row out
    scaled = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(x.cast("double") * 64).cast("double")))
    found = exact_top_k(rows.withColumn("vector", scaled), 20, F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilespark.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


ORACLES["op9_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES["op4_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
    ELSE list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
), link AS (
  SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 90 * (p.n + q.n - both_)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
