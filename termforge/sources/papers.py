"""Papers from a metadata file and the JSON bodies beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_FIELDS = 10
BODY_SCHEMA = "abstract array<struct<text:string>>, body_text array<struct<text:string>>"
PDF_BODIES, XML_BODIES = "comm_use_subset/pdf_json", "comm_use_subset/pmc_json"
SEPARATOR = "\u0001"
SPLIT, OWN = SEPARATOR + "\u0002", SEPARATOR + "\u0003"  # a splitting comma, and a separator of the data


def csv_fields(line: Column) -> Column:
    """The fields of a line: a quote turns quoting on or off and is dropped, a comma splits outside quotes only.

    Pieces between quotes alternate between outside and inside, so commas are replaced in every other piece.
    A separator that the line has itself is replaced before and put back in the fields.
    """
    own = F.replace(line, F.lit(SEPARATOR), F.lit(OWN))
    piece = F.transform(F.split(own, '"', -1), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(","), F.lit(SPLIT))).otherwise(x))
    return F.transform(F.split(F.array_join(piece, ""), SPLIT, -1), lambda x: F.replace(x, F.lit(OWN), F.lit(SEPARATOR)))


def clean_field(field: Column) -> Column:
    """Without white space at the ends, then without one pair of enclosing quotes."""
    bare = F.regexp_replace(field, r"^[ \t\n\r]+|[ \t\n\r]+\z", "")
    quoted = (F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"')
    return F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value and at: the lines with an order of (block, place in it) packed in two columns, header included."""
    return spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """The non-empty lines after the header, still in order."""
    rows = _lines(spark, path)
    first = Window.partitionBy("block").orderBy("row")
    head = rows.where("block = 0").withColumn("k", F.row_number().over(first)).where("k = 1").select(F.col("row").alias("head"))
    return rows.join(F.broadcast(head), F.col("row") == F.col("head"), "left_anti").where("value <> ''")


def metadata(spark: SparkSession, data_path: str) -> DataFrame:
    """doc_ord, paper_id, sha, pmcid, title, abstract_text, publish_date, authors of the lines with 10 fields or more.

    doc_ord is dense in line order. It is given per block of the file, with the blocks' line counts summed up.
    """
    rows = _records(spark, f"{data_path}/metadata.csv").withColumn("f", csv_fields(F.col("value"))).where(F.size("f") >= LEAST_FIELDS)
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("row"))
    numbered = rows.withColumn("k", rank).join(offsets, "block").withColumn("doc_ord", (F.col("before") + F.col("k") - 1).cast("long"))
    field = lambda i: clean_field(F.col("f")[i])
    authors = F.when(F.size("f") > 10, field_or_empty("f", 10)).otherwise("")
    return numbered.select(
        "doc_ord", field(0).alias("paper_id"), field(1).alias("sha"), field(5).alias("pmcid"), field(3).alias("title"),
        field(8).alias("abstract_text"), field(9).alias("publish_date"), authors.alias("authors"),
    )


def field_or_empty(fields: str, i: int) -> Column:
    return clean_field(F.coalesce(F.get(F.col(fields), F.lit(i)), F.lit("")))


def count_records(spark: SparkSession, data_path: str) -> int:
    """The non-empty lines after the header; lines with too few fields count, so this can exceed the papers."""
    return _records(spark, f"{data_path}/metadata.csv").count()


def body_text(abstract: Column, body: Column) -> Column:
    """All abstract texts, then all body texts, each with an empty line after it."""
    part = lambda a: F.transform(F.filter(F.coalesce(a, F.array().cast("array<struct<text:string>>")), lambda x: x["text"].isNotNull()), lambda x: F.concat(x["text"], F.lit("\n\n")))
    return F.concat(F.array_join(part(abstract), ""), F.array_join(part(body), ""))


def parsed_bodies(files: DataFrame) -> DataFrame:
    """stem, body of ``files`` (stem, raw). A malformed file, or one with a text that is no string, has an empty body."""
    parsed = files.withColumn("j", F.from_json("raw", BODY_SCHEMA)).withColumn("v", F.try_parse_json("raw"))
    # kinds of all text values as written: from_json would turn a number into a string
    texts = lambda name: F.coalesce(F.try_variant_get("v", f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    strings = F.forall(F.concat(texts("abstract"), texts("body_text")), lambda x: F.schema_of_variant(F.try_variant_get(x, "$.text", "variant")) == "STRING")
    return parsed.select("stem", F.when(F.col("v").isNotNull() & F.coalesce(strings, F.lit(False)), body_text(F.col("j.abstract"), F.col("j.body_text"))).otherwise("").alias("body"))


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """stem, body of the JSON files in a folder."""
    key = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.xml)?\.json$", 1)
    return parsed_bodies(spark.read.text(path, wholetext=True).select(key.alias("stem"), F.col("value").alias("raw")))


def _folder(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bodies(spark, path) if fs.exists(p) and len(fs.listStatus(p)) else spark.createDataFrame([], "stem string, body string")


def with_bodies(own: DataFrame, pdf: DataFrame, xml: DataFrame) -> DataFrame:
    """``own`` (see ``metadata``) with body_text: the text of the PDF form, or else of the XML form, or else empty."""
    pdf, xml = (f.select(F.col("stem").alias(s), F.col("body").alias(b)) for f, s, b in ((pdf, "_pdf", "pdf_body"), (xml, "_xml", "xml_body")))
    both = own.join(pdf, (F.col("sha") == F.col("_pdf")) & (F.col("sha") != ""), "left").join(xml, (F.col("pmcid") == F.col("_xml")) & (F.col("pmcid") != ""), "left")
    body = F.coalesce(F.nullif("pdf_body", F.lit("")), F.col("xml_body"), F.lit(""))
    return both.select("doc_ord", "paper_id", "title", "authors", "publish_date", "abstract_text", body.alias("body_text"))


def papers(spark: SparkSession, data_path: str, max_docs: int | None = None) -> DataFrame:
    """The papers of a data folder with their bodies.

    ``max_docs`` cuts before the bodies are joined, so only the kept papers' bodies are looked up.
    """
    own = metadata(spark, data_path)
    if max_docs is not None:
        own = own.where(F.col("doc_ord") < max_docs)
    return with_bodies(own, _folder(spark, f"{data_path}/{PDF_BODIES}"), _folder(spark, f"{data_path}/{XML_BODIES}"))


def from_documents(documents: DataFrame) -> DataFrame:
    """A table of (doc_id, text) as papers: the id is also the order."""
    empty = F.lit("")
    return documents.select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").alias("paper_id"), empty.alias("title"), empty.alias("authors"), empty.alias("publish_date"), empty.alias("abstract_text"), F.col("text").alias("body_text"))
