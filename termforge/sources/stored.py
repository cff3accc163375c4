"""Saving and loading lexicon, forward and inverted index: Parquet, CSV and text; and the packed binary formats, for reading."""

from __future__ import annotations

import struct
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.operators import forward, inverted

LEXICON = "word string, word_id long, frequency long"


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_lexicon_csv(lexicon: DataFrame, path: str) -> None:
    """word,word_id,frequency with a header and quoted words, most frequent first; reading it gives the same words back."""
    lexicon.select("word", "word_id", "frequency").orderBy(F.desc("frequency"), "word_id").coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True)


def load_lexicon_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a word and numbers; of a word that comes again the last row counts."""
    rows = spark.read.schema("word string, word_id string, frequency string").csv(path, header=True)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    typed = rows.select(place.alias("place"), "word", F.expr("try_cast(word_id as bigint)").alias("word_id"), F.expr("try_cast(frequency as bigint)").alias("frequency"))
    typed = typed.where("word is not null and word_id is not null and frequency is not null")
    return typed.groupBy("word").agg(F.max(F.struct("place", "word_id", "frequency")).alias("x")).select("word", "x.word_id", "x.frequency")


def save_forward_csv(index: DataFrame, path: str) -> None:
    index.select("doc_id", "word_id", "frequency").write.mode("overwrite").csv(path, header=True)


def save_postings_csv(postings: DataFrame, path: str) -> None:
    postings.select("word_id", "word", "doc_id", "frequency").write.mode("overwrite").csv(path, header=True)


def save_first_documents_csv(index: DataFrame, n: int, path: str) -> None:
    """The forward CSV of the first ``n`` documents by number."""
    save_forward_csv(forward.first_documents(index, n), path)


def save_first_words_csv(postings: DataFrame, n: int, path: str) -> None:
    """The postings CSV of the first ``n`` words by id, each with all its postings."""
    save_postings_csv(inverted.first_words(postings, n), path)


def export_barrels_csv(assigned: DataFrame, path: str) -> None:
    """One folder of CSV per barrel."""
    assigned.select("word_id", "word", "doc_id", "frequency", "barrel_id").repartition("barrel_id").sortWithinPartitions("word_id", "doc_id").write.mode("overwrite").partitionBy("barrel_id").csv(path, header=True)


def save_bodies_text(papers: DataFrame, path: str) -> None:
    """All non-empty bodies as text, each followed by an end mark."""
    text = F.concat("body_text", F.lit("\n\n---END OF DOCUMENT---\n"))  # the line separator adds the last line feed
    papers.where("body_text <> ''").select(text.alias("value")).write.mode("overwrite").text(path, lineSep="\n")


# ---------------------------------------------------------------- packed binary formats


class _Buffer:
    def __init__(self, data):
        self.data, self.at = memoryview(data), 0

    def numbers(self, kinds: str) -> tuple:
        s = struct.Struct(f"<{kinds}")
        if self.at + s.size > len(self.data):
            raise ValueError("the file ends too early")
        out, self.at = s.unpack_from(self.data, self.at), self.at + s.size
        return out

    def text(self) -> str:
        (n,) = self.numbers("I")
        if self.at + n > len(self.data):
            raise ValueError("the file ends too early")
        out, self.at = bytes(self.data[self.at : self.at + n]).decode("utf-8", "replace"), self.at + n
        return out


def _forward_rows(data):
    b = _Buffer(data)
    _, _, _, n = b.numbers("IQII")
    for num in range(n):
        doc_id, title, abstract = b.text(), b.text(), b.text()
        length, k = b.numbers("II")
        for _ in range(k):
            yield (num, doc_id, title, abstract, length, *b.numbers("II"))


def _inverted_rows(data, barrel: bool):
    b = _Buffer(data)
    if barrel:
        b.numbers("III")
    (n,) = b.numbers("I")
    for _ in range(n):
        (word_id,) = b.numbers("I")
        word = b.text()
        (k,) = b.numbers("I")
        for _ in range(k):
            yield (word_id, word, *b.numbers("II"))


CHUNK = 100_000  # records handed on at a time


def _packed(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    """One task per file, as a file is one sequential record stream; its records are handed on in chunks."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                stream = iter(rows(data.as_buffer()))
                while part := list(islice(stream, CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds.types)], schema=kinds)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def load_forward_binary(spark: SparkSession, path: str) -> DataFrame:
    """doc_num (place in the file), doc_id, title, abstract, doc_length, word_id, frequency."""
    return _packed(spark, path, _forward_rows, "doc_num long, doc_id string, title string, abstract string, doc_length long, word_id long, frequency long")


def load_inverted_binary(spark: SparkSession, path: str) -> DataFrame:
    """word_id, word, doc_id, frequency."""
    return _packed(spark, path, lambda d: _inverted_rows(d, False), "word_id long, word string, doc_id long, frequency long")


def load_barrel_binary(spark: SparkSession, path: str) -> DataFrame:
    """The same of one packed barrel file."""
    return _packed(spark, path, lambda d: _inverted_rows(d, True), "word_id long, word string, doc_id long, frequency long")
