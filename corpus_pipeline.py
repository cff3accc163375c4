"""The corpus pipeline: language ID, near-dedup, decontamination, secret masking, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again as the next stage's docs. All stages but the last return the columns of documents.
Nulls, empty texts, repeated rows and clashing extra columns are handled as the operators' modules define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm import decontam, langid, minhash, secret_scan, viterbi
from termforge.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter go, and all if nothing is learned.

    The score falls with the length of a text, clean or not, so there is no least score.
    """
    own = docs.select(*COLUMNS)
    said = langid.predict(own, langid.learn(own), ("_lang", "_score"))
    return said.where(F.col("_lang") != langid.UND).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, then of the smallest hash of the row; ids may repeat or be null."""
    return minhash.distinct_documents(docs.select(*COLUMNS), PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; rows of one id are judged each by its own text."""
    return decontam.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every found secret masked; n_chars is that of the masked text."""
    rows = docs.select(*COLUMNS)
    ledger = secret_scan.Ledger(spark)
    ledger.scan(rows)
    masked = secret_scan.redact(ledger.matched(rows))
    n = F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", n).select(*COLUMNS)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of the text, and whether they decode to it."""
    return viterbi.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), check=True).select("doc_id", "piece_ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("piece_encoding", piece_encoding),
]

#: The language model and the piece search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
