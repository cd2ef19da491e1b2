"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
``documents``; the last returns pieces of sequences.  Between stages everything is
written as Parquet and read again, so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm.common import Scratch, fresh, small_side
from tilespark.llm.language import UNKNOWN, fit, identify
from tilespark.llm.packing import pack
from tilespark.llm.repeats import remove_repeats
from tilespark.llm.secrets import redact
from tilespark.llm.similarity import ngram_jaccard_join
from tilespark.session import ship

#: A text whose pooled language probability is lower is taken for no language at all.  0 is
#: what chance gives with the languages learned, 1 is certainty.
LEAST_SCORE = 0.1
#: Near duplicates share this percentage of their five-word shingles, or more.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80
#: Shortest repeated byte string that is cut out.
REPEAT_BYTES = 200


_scratch: dict[str, Scratch] = {}


def _tables(spark: SparkSession, name: str) -> Scratch:
    """A stage's scratch tables.  A stage's result is written before the next one begins, so
    what the stage before left in the same application goes first."""
    app = spark.sparkContext.applicationId
    if app in _scratch:
        _scratch.pop(app).clear()
    _scratch[app] = Scratch(spark, name)
    return _scratch[app]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language.  Null texts, texts without letters and those whose pooled
    probability stays below ``LEAST_SCORE`` are rejected; where no language or only one
    could be learned nothing but the former is.  A null ``lang`` is filled in."""
    ship(spark)
    net = fit(docs)
    if net is None:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    chance = 1 / len(net.labels)
    least = chance + LEAST_SCORE * (1 - chance)
    judged = identify(docs.select(*docs.columns), net).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; a null id
    comes last.  Rows of one id or of none are documents of their own if their texts
    differ; of rows that agree in id and text one stays."""
    ship(spark)
    scratch = _tables(spark, "near")
    row, kept_row, rows = fresh(docs.columns, "row", "kept_row", "rows")
    unknown = F.col("doc_id").isNull()
    key = F.struct(unknown.alias("unknown"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    keyed = docs.withColumn(row, key)
    groups = ngram_jaccard_join(keyed, id_col=row, words=SHINGLE_WORDS, percent=SHINGLE_PERCENT, scratch=scratch)
    kept = groups.where(F.col(row) == F.col("component_id")).groupBy(F.col(row).alias(kept_row)).agg(F.count(F.lit(1)).alias(rows))
    kept = scratch.table(kept)
    out = keyed.join(small_side(kept), F.col(row) == F.col(kept_row))
    once = out.where(F.col(rows) == 1).select(*docs.columns)
    if not kept.where(F.col(rows) > 1).limit(1).count():
        return once
    return once.union(out.where(F.col(rows) > 1).dropDuplicates([row]).select(*docs.columns))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur elsewhere too.  Characters that a cut goes
    through go whole; a document of which only blanks are left goes."""
    ship(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = remove_repeats(docs, length=REPEAT_BYTES, carry=others, scratch=_tables(spark, "repeats"))
    text = F.col("kept").cast("string")
    text = F.when(F.size("removed") > 0, F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))).otherwise(text)
    cut = cut.where((F.size("removed") == 0) | text.rlike(r"\S"))
    fields = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.when(F.size("removed") > 0, F.length(text).cast("long")).otherwise(F.col("rest.n_chars"))}
    return cut.select(*(fields.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked; no document goes."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of cost-balanced sequences, with their tokens."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("secret scans", secret_redaction),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of sequences that ``documents`` become.  An empty table gives none; null
    texts and ids, repeated rows and ids, very long texts and further columns are dealt
    with as each stage says."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs


#: Language identification and packing are beyond SQL; tests hold every stage against a
#: brute-force version on its own input.
ORACLE_SQL = None
