"""Barrels: the inverted index sharded by ranges of word ids, so that a lookup reads one shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = 4_000_000


def ranges(postings: DataFrame, num_barrels: int = 4) -> DataFrame:
    """One row: first, last and the ids per barrel (the last barrel may be shorter)."""
    if num_barrels < 1:
        raise ValueError("num_barrels must be 1 or more")
    ends = postings.agg(F.min("word_id").alias("first_id"), F.max("word_id").alias("last_id"))
    return ends.withColumn("per_barrel", F.expr(f"(last_id - first_id + {num_barrels}) div {num_barrels}"))


def _placed(rows: DataFrame, postings: DataFrame, num_barrels: int) -> DataFrame:
    """``rows`` with first_id, last_id, per_barrel (scalar subqueries over one row) and barrel_id."""
    r = ranges(postings, num_barrels)
    for c in ("first_id", "last_id", "per_barrel"):
        rows = rows.withColumn(c, r.select(c).scalar())
    return rows.withColumn("barrel_id", F.expr("(word_id - first_id) div per_barrel"))


def assigned(postings: DataFrame, num_barrels: int = 4) -> DataFrame:
    """``postings`` with barrel_id."""
    return _placed(postings, postings, num_barrels).drop("first_id", "last_id", "per_barrel")


def metadata(postings: DataFrame, num_barrels: int = 4) -> DataFrame:
    """barrel_id, start_word_id, end_word_id, words, postings of the barrels that have any."""
    rows = _placed(postings.groupBy("word_id").agg(F.count("*").alias("n")), postings, num_barrels)
    own = rows.groupBy("barrel_id", "first_id", "last_id", "per_barrel").agg(F.count("*").alias("words"), F.sum("n").alias("postings"))
    start = F.col("first_id") + F.col("barrel_id") * F.col("per_barrel")
    return own.select("barrel_id", start.alias("start_word_id"), F.least(start + F.col("per_barrel") - 1, F.col("last_id")).alias("end_word_id"), "words", "postings")


def write(postings: DataFrame, path: str, num_barrels: int = 4, rows_per_task: int = ROWS_PER_TASK) -> None:
    """Shards as Parquet partitions by barrel_id, sorted by word and document, and their metadata beside them.

    Low barrels hold most postings and a frequent word very many: tasks are ranges over (word, document), as many as the
    number of postings asks for, so neither a barrel nor a word is one task's work.
    """
    tasks = max(num_barrels, -(-postings.count() // rows_per_task))
    dealt = assigned(postings, num_barrels).repartitionByRange(tasks, "word_id", "doc_id").sortWithinPartitions("barrel_id", "word_id", "doc_id")
    dealt.write.mode("overwrite").partitionBy("barrel_id").parquet(f"{path}/barrels")
    metadata(postings, num_barrels).coalesce(1).write.mode("overwrite").parquet(f"{path}/barrel_meta")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/barrel_meta")


def load(spark: SparkSession, path: str, barrel_id: int) -> DataFrame:
    """The postings of one barrel: a partition filter, so other barrels are not read."""
    return spark.read.parquet(f"{path}/barrels").where(F.col("barrel_id") == barrel_id)


def barrel_of(meta: DataFrame, word_id: int) -> int | None:
    """The barrel whose range holds the id, if any."""
    row = meta.where((F.col("start_word_id") <= word_id) & (F.col("end_word_id") >= word_id)).select("barrel_id").first()
    return row and row["barrel_id"]


def lookup(spark: SparkSession, path: str, word_id: int) -> DataFrame:
    """The postings of one word, read from its barrel alone."""
    barrel = barrel_of(load_metadata(spark, path), word_id)
    return load(spark, path, -1 if barrel is None else barrel).where(F.col("word_id") == word_id)


def locate(meta: DataFrame, words: DataFrame) -> DataFrame:
    """``words`` (word_id ...) with barrel_id by range; null outside of all ranges. The range table has one row per barrel."""
    m = F.broadcast(meta.select("barrel_id", "start_word_id", "end_word_id"))
    return words.join(m, F.col("word_id").between(F.col("start_word_id"), F.col("end_word_id")), "left").drop("start_word_id", "end_word_id")
