"""The lexicon: words with dense ids in the order of first occurrence, and collection frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.operators.numbering import dense_number
from termforge.operators.terms import POSITION_BITS

RANGE_BITS = POSITION_BITS + 10  # ids are ranked per 1024 documents


def build(terms: DataFrame) -> DataFrame:
    """word, word_id, frequency from (word, frequency, first_pos) rows; every paper counts, repeated ids too."""
    words = terms.groupBy("word").agg(F.sum("frequency").alias("frequency"), F.min("first_pos").alias("first_pos"))
    return dense_number(words, "first_pos", "word_id", RANGE_BITS).select("word", "word_id", "frequency")


def extend(lexicon: DataFrame, terms: DataFrame) -> DataFrame:
    """``lexicon`` with later papers added: known words keep their ids, new ones go on after the largest."""
    words = terms.groupBy("word").agg(F.sum("frequency").alias("more"), F.min("first_pos").alias("first_pos"))
    following = lexicon.agg(F.coalesce(F.max("word_id"), F.lit(-1)) + 1).scalar()
    new = dense_number(words.join(lexicon, "word", "left_anti"), "first_pos", "rank", RANGE_BITS)
    known = lexicon.join(words, "word", "left").select("word", "word_id", (F.col("frequency") + F.coalesce("more", F.lit(0))).alias("frequency"))
    return known.unionByName(new.select("word", (following + F.col("rank")).alias("word_id"), F.col("more").alias("frequency")))


def details(lexicon: DataFrame, queries: DataFrame) -> DataFrame:
    """Each queried word with found, word_id and frequency; the last two null where the word is missing."""
    hit = lexicon.select(F.col("word").alias("_word"), "word_id", "frequency")
    return queries.join(hit, F.col("word") == F.col("_word"), "left").select("word", F.col("word_id").isNotNull().alias("found"), "word_id", "frequency")


def contains(lexicon: DataFrame, word: str) -> bool:
    return not lexicon.where(F.col("word") == word).isEmpty()


def size(lexicon: DataFrame) -> int:
    return lexicon.count()


def reverse(lexicon: DataFrame) -> DataFrame:
    """word_id to word."""
    return lexicon.select("word_id", "word")


def top(lexicon: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent words; ties by id."""
    return lexicon.orderBy(F.desc("frequency"), "word_id").limit(n)
