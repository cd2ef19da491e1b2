"""How the rows that the language network learns from are drawn."""

from collections import Counter

from pyspark.sql import functions as F

from tilespark.llm import language


def drawn(df):
    return Counter(k for _, k in language.learning_rows(df, "doc_id", "text", "lang", F.lit(False)))


def test_small_languages_are_not_starved(spark):
    big = spark.range(800_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.concat(F.lit("l"), (F.col("id") % 8).cast("string")).alias("lang"))
    small = spark.range(800_000, 800_100).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit("small").alias("lang"))
    assert drawn(big.union(small)) == Counter({f"l{k}": 400 for k in range(8)} | {"small": 100})


def test_no_language_is_left_out(spark):
    df = spark.range(15_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), (F.col("id") % 300).cast("string").alias("lang"))
    assert drawn(df) == Counter({str(k): 13 for k in range(300)})
