"""From texts to (document, word) counts: the one heavy stage, which everything else is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.config import TextConfig
from termforge.functions import stemmer, text

POSITION_BITS = 32
ORDER_LIMIT = 1 << 31  # first_pos is doc_ord * 2**32 + pos in one long


def tokens(papers: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    """doc_ord, paper_id, pos, word: the kept words of ``body_text`` with their positions among all runs of the text."""
    runs = F.regexp_extract_all(F.coalesce("body_text", F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    rows = papers.select("doc_ord", "paper_id", F.posexplode(runs).alias("pos", "raw")).select("doc_ord", "paper_id", F.col("pos").cast("long").alias("pos"), F.lower("raw").alias("word"))
    if not config.use_stemming:
        return rows.where(text.keeps(F.col("word"), config))
    if config.remove_stop_words:
        rows = rows.where(~F.col("word").isin(*text.PLAIN_STOP_WORDS))
    # a plain filter on the stem would be pushed below the steps and repeat each step's text in the next; a generator stops it
    valid = F.filter(F.array("stem"), lambda w: text.is_valid_word(w, config))
    stems = stemmer.stemmed(rows.select("word").distinct()).select("word", F.explode_outer(valid).alias("stem")).where("stem is not null")
    return rows.join(stems, "word").select("doc_ord", "paper_id", "pos", F.col("stem").alias("word"))


def doc_terms(papers: DataFrame, config: TextConfig = TextConfig()) -> DataFrame:
    """doc_ord, paper_id, word, frequency, first_pos. A doc_ord outside 0 .. 2**31 - 1 is an error: number such papers densely first."""
    outside = (F.col("doc_ord") < 0) | (F.col("doc_ord") >= ORDER_LIMIT)
    refused = F.raise_error(F.concat(F.lit("doc_ord must be from 0 to 2147483647: "), F.col("doc_ord").cast("string"))).cast("long")
    at = F.when(outside, refused).otherwise(F.shiftleft("doc_ord", POSITION_BITS) + F.col("pos"))
    return tokens(papers, config).groupBy("doc_ord", "paper_id", "word").agg(F.count("*").alias("frequency"), F.min(at).alias("first_pos"))
