"""Term search: queried words to their posting lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.operators import barrels, inverted, lexicon


def words_frame(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def search(lex: DataFrame, postings: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """The preview of each queried word over an index held as DataFrames; missing words keep a row."""
    hits = lexicon.details(lex, queries).select("word", "word_id")
    own = postings.select(F.col("word_id").alias("_id"), "doc_id", "frequency")
    return inverted.preview(hits.join(own, F.col("word_id") == F.col("_id"), "left"), n)


def search_stored(spark: SparkSession, path: str, words: list[str], n: int = 5) -> DataFrame:
    """The same over a stored index: only the barrels of the words found are read.

    The words of one request and their barrels are all that passes the driver.
    """
    found = lexicon.details(spark.read.parquet(f"{path}/lexicon").where(F.col("word").isin(words)), words_frame(spark, words)).select("word", "word_id")
    located = barrels.locate(barrels.load_metadata(spark, path), found).collect()
    ids = sorted({r["barrel_id"] for r in located if r["barrel_id"] is not None})
    wanted = [r["word_id"] for r in located if r["word_id"] is not None]
    read = spark.read.parquet(f"{path}/barrels").where(F.col("barrel_id").isin(ids) & F.col("word_id").isin(wanted))
    own = read.select(F.col("word_id").alias("_id"), "doc_id", "frequency")
    hits = spark.createDataFrame([(r["word"], r["word_id"]) for r in located], "word string, word_id long")
    return inverted.preview(hits.join(own, F.col("word_id") == F.col("_id"), "left"), n)
