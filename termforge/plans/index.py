"""The whole index of a set of papers."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termforge.config import IndexConfig
from termforge.operators import barrels, forward, inverted, lexicon, terms

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Index:
    """Lazy tables of an index."""

    lexicon: DataFrame
    forward: DataFrame
    postings: DataFrame


def kept(papers: DataFrame, config: IndexConfig) -> DataFrame:
    """The first ``max_docs`` papers, cut before anything is filtered."""
    return papers if config.max_docs is None else papers.where(F.col("doc_ord") < config.max_docs)


def index(papers: DataFrame, config: IndexConfig = IndexConfig()) -> Index:
    """The index as DataFrames. The lexicon counts all kept papers; only the first of each id is indexed."""
    counted = terms.doc_terms(kept(papers, config), config.text)
    return of_terms(counted, lexicon.build(counted))


def of_terms(counted: DataFrame, lex: DataFrame) -> Index:
    """The index of given (document, word) counts and their lexicon."""
    fwd = forward.build(counted, lex)
    return Index(lex, fwd, inverted.build(fwd))


def build(papers: DataFrame, path: str, config: IndexConfig = IndexConfig()) -> None:
    """Write the index: doc_terms, lexicon, forward, documents, barrels and barrel_meta under ``path``.

    Texts are read once: everything else is made of the written doc_terms table. Progress is logged: papers and texts
    read (observed while they are read), then the size of each table.
    """
    spark = papers.sparkSession
    own = kept(papers, config)
    read = Observation("papers")
    seen = own.observe(read, F.count("*").alias("papers"), F.count_if(F.col("body_text") != "").alias("with_text"))
    terms.doc_terms(seen, config.text).write.mode("overwrite").parquet(f"{path}/doc_terms")
    log.info("read %(papers)d papers, %(with_text)d with text", read.get)
    counted = spark.read.parquet(f"{path}/doc_terms")
    lexicon.build(counted).write.mode("overwrite").parquet(f"{path}/lexicon")
    log.info("lexicon: %d words", spark.read.parquet(f"{path}/lexicon").count())
    lex = spark.read.parquet(f"{path}/lexicon")
    forward.build(counted, lex).write.mode("overwrite").parquet(f"{path}/forward")
    forward.documents_dim(counted, own).write.mode("overwrite").parquet(f"{path}/documents")
    barrels.write(inverted.build(spark.read.parquet(f"{path}/forward")), path, config.num_barrels)
    log.info("barrels: %d postings", spark.read.parquet(f"{path}/barrels").count())


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("lexicon", "forward", "barrels")))


def report(path: str, spark: SparkSession) -> dict:
    """Counts of a stored build: papers with words, indexed papers, and the statistics of both indexes."""
    counted, i = spark.read.parquet(f"{path}/doc_terms"), load(spark, path)
    return {
        "papers_with_words": counted.select("doc_ord").distinct().count(),
        "vocabulary": lexicon.size(i.lexicon),
        **forward.statistics(i.forward).first().asDict(),
        **inverted.statistics(i.postings).first().asDict(),
    }
