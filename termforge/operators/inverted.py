"""The inverted index: words with the documents that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build(forward: DataFrame) -> DataFrame:
    """word_id, word, doc_id (the document's number), frequency."""
    return forward.select("word_id", "word", F.col("doc_num").alias("doc_id"), "frequency")


def append(postings: DataFrame, more: DataFrame) -> DataFrame:
    """Postings of later documents added as they are."""
    return postings.unionByName(more)


def nested(postings: DataFrame) -> DataFrame:
    """word_id, word and postings: an array of (doc_id, frequency) by doc_id.

    Rows hold whole posting lists; for words in very many documents read the flat form instead.
    """
    return postings.groupBy("word_id", "word").agg(F.array_sort(F.collect_list(F.struct("doc_id", "frequency"))).alias("postings"))


def terms(postings: DataFrame, word_id: int) -> DataFrame:
    """doc_id, frequency of one word."""
    return postings.where(F.col("word_id") == word_id).select("doc_id", "frequency")


def statistics(postings: DataFrame) -> DataFrame:
    """One row: words, postings, and average, least and most documents per word."""
    n = postings.groupBy("word_id").agg(F.count("*").alias("n"))
    return n.agg(
        F.count("*").alias("unique_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_postings"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 2).alias("avg_docs_per_word"),
        F.coalesce(F.min("n"), F.lit(0)).alias("min_docs_per_word"), F.coalesce(F.max("n"), F.lit(0)).alias("max_docs_per_word"),
    )


def first_words(postings: DataFrame, n: int) -> DataFrame:
    """All postings of the ``n`` words of smallest id that have any; the cut is a top-n, not a sort of all words."""
    ids = postings.select("word_id").distinct().orderBy("word_id").limit(n)
    return postings.join(ids, "word_id", "left_semi").select("word_id", "word", "doc_id", "frequency")


def preview(found: DataFrame, n: int = 5) -> DataFrame:
    """word, found, word_id, doc_count and the first ``n`` postings by document, of rows (word, word_id, doc_id, frequency).

    A word without postings keeps one row, with nulls. Spark limits the rank before the shuffle.
    """
    counts = found.groupBy(F.col("word").alias("_word")).agg(F.count("doc_id").alias("doc_count"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("doc_id"))
    few = found.withColumn("rank", rank.cast("long")).where(f"rank <= {n}")
    return few.join(counts, F.col("word") == F.col("_word")).select("word", F.col("word_id").isNotNull().alias("found"), "word_id", "doc_count", "rank", "doc_id", "frequency")
