"""The forward index: documents with their term frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termforge.operators.numbering import dense_number

DOC_RANGE_BITS = 10


def indexed(terms: DataFrame) -> DataFrame:
    """doc_ord, doc_num, doc_id, doc_length, n_unique of the papers that are indexed.

    A paper without words is not; of papers with the same id the first with words is. Numbers are dense in paper order.
    """
    sizes = terms.groupBy("doc_ord", "paper_id").agg(F.sum("frequency").alias("doc_length"), F.count("*").alias("n_unique"))
    first = Window.partitionBy("paper_id").orderBy("doc_ord")
    rows = sizes.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return dense_number(rows, "doc_ord", "doc_num", DOC_RANGE_BITS).select("doc_ord", "doc_num", F.col("paper_id").alias("doc_id"), "doc_length", "n_unique")


def documents_dim(terms: DataFrame, papers: DataFrame) -> DataFrame:
    """doc_num, doc_id, title, abstract, doc_length."""
    return indexed(terms).join(papers.select("doc_ord", "title", F.col("abstract_text").alias("abstract")), "doc_ord").select("doc_num", "doc_id", "title", "abstract", "doc_length")


def build(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_num, doc_id, word_id, word, frequency: one row per document and word."""
    own = indexed(terms).select("doc_ord", "doc_num", "doc_id")
    return terms.join(own, "doc_ord").join(lexicon.select("word", "word_id"), "word").select("doc_num", "doc_id", "word_id", "word", "frequency")


def nested(forward: DataFrame) -> DataFrame:
    """doc_num, doc_id, doc_length and terms: an array of (word_id, frequency) by word_id."""
    pair = F.struct("word_id", "frequency")
    return forward.groupBy("doc_num", "doc_id").agg(F.sum("frequency").alias("doc_length"), F.array_sort(F.collect_list(pair)).alias("terms"))


def document(forward: DataFrame, doc_id) -> DataFrame:
    """The nested row of one document; no row if it is not indexed."""
    return nested(forward.where(F.col("doc_id") == doc_id))


def lengths(forward: DataFrame, queries: DataFrame) -> DataFrame:
    """doc_id and doc_length of each queried id; 0 if it is not indexed."""
    sums = forward.groupBy(F.col("doc_id").alias("_id")).agg(F.sum("frequency").alias("n"))
    return queries.join(sums, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("doc_length"))


def term_frequencies(forward: DataFrame, queries: DataFrame) -> DataFrame:
    """doc_id, word_id and frequency of each queried pair; 0 if document or word is absent."""
    hit = forward.select(F.col("doc_id").alias("_doc"), F.col("word_id").alias("_word"), "frequency")
    on = (F.col("doc_id") == F.col("_doc")) & (F.col("word_id") == F.col("_word"))
    return queries.join(hit, on, "left").select("doc_id", "word_id", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def statistics(forward: DataFrame) -> DataFrame:
    """One row: documents, total terms, average length and average number of different words (0.0 if empty)."""
    docs = forward.groupBy("doc_num").agg(F.sum("frequency").alias("n"), F.count("*").alias("u"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return docs.agg(
        F.count("*").alias("total_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_terms"),
        F.round(zero(F.avg("n")), 2).alias("avg_doc_length"), F.round(zero(F.avg("u")), 2).alias("avg_unique_terms"),
    )


def first_documents(forward: DataFrame, n: int) -> DataFrame:
    """doc_id, word_id, frequency of the first ``n`` documents by number."""
    return forward.where(F.col("doc_num") < n).select("doc_id", "word_id", "frequency")
