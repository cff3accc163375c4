"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Each response record gives two records. ``metadata`` (application/warc-fields) states what was taken from the response:
its status, content type, charset, title, numbers of links and of bytes. ``conversion`` (text/plain) holds the plain text.
Both keep WARC-Target-URI and WARC-Date of the source, name the source by WARC-Refers-To, carry its payload digest as
WARC-Source-Payload-Digest, and have block digests of their own; the conversion also keeps the source's HTTP headers under
X-Source-. Record ids are derived from the source's id and digest, so a repeated task makes the same records.

All of it is DataFrame functions: the derivation is one narrow projection over the responses, without a shuffle.

Defined cases: a null payload counts as empty; null headers are left out; repeated rows give repeated records, which
share ids; an empty table gives no rows; other columns pass by; text and lengths cover whole payloads. Lengths are in bytes. Line breaks in a URL are percent-encoded in files.
"""

from __future__ import annotations

import gzip
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.llm.common import bounded_batches

CRLF = "\r\n"
# Patterns in a syntax that Java and RE2 read alike, applied in this order.
DROPPED = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<head\b[^>]*>.*?</head\s*>"
BREAKS = r"(?i)</?(p|div|br|li|ul|ol|tr|table|h1|h2|h3|h4|h5|h6|article|section|footer|header|nav|main|pre|blockquote)\b[^>]*>"
TAGS = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
CHARSET = r"(?i)<meta\b[^>]*charset=[\x22\x27]?([A-Za-z0-9_-]+)"
LINK = r"(?i)<a\b[^>]*href="


def decoded(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and head dropped, one line per block, inner white space squeezed."""
    text = F.regexp_replace(html, DROPPED, " ")
    text = F.regexp_replace(text, r"[ \t\r\n]+", " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = decoded(F.regexp_replace(text, TAGS, ""))
    text = F.regexp_replace(text, r" *\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def sha(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def derived_id(kind: str, source: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(kind), source, digest), 256)
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of raw pages (page_id, url, html): the input that ``derive`` takes.

    Such a table has no status, headers or date, so these are constants here; ``derive`` takes what its input says.
    """
    payload = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), derived_id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), sha(payload)).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), sha(payload).alias("payload_digest"),
        F.lit("HTTP/1.1 200 OK").alias("status_line"), F.lit("text/html; charset=utf-8").alias("content_type"), payload.alias("payload"),
    )


def derive(response: DataFrame) -> DataFrame:
    """Two rows for each response: record_type, record_id, refers_to, target_uri, date, content_type, source headers and digest, block, content_length, block_digest."""
    text = plain_text(F.col("payload"))
    title = F.regexp_replace(decoded(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[ \t\r\n]+", " ")), "^ | $", "")
    base = response.withColumn("_text", text).withColumn("_title", title).withColumn("_charset", F.lower(F.regexp_extract("payload", CHARSET, 1)))
    # one string per response, in which its fields stand in a fixed order
    fields = F.concat(
        F.lit("status: "), F.coalesce("status_line", F.lit("")), F.lit(CRLF + "content-type: "), F.coalesce("content_type", F.lit("")), F.lit(CRLF + "charset: "), F.col("_charset"),
        F.lit(CRLF + "title: "), F.col("_title"), F.lit(CRLF + "links: "), F.regexp_count("payload", F.lit(LINK)).cast("string"),
        F.lit(CRLF + "payload-length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + "text-length: "), F.octet_length("_text").cast("string"), F.lit(CRLF),
    )
    record = lambda kind, mime, block: F.struct(F.lit(kind).alias("record_type"), F.lit(mime).alias("mime"), block.alias("block"))
    both = base.withColumn("r", F.explode(F.array(record("metadata", "application/warc-fields", fields), record("conversion", "text/plain; charset=utf-8", F.col("_text")))))
    source_headers = F.when(F.col("r.record_type") == "conversion", F.concat_ws(CRLF, F.concat(F.lit("X-Source-Status: "), F.col("status_line")), F.concat(F.lit("X-Source-Content-Type: "), F.col("content_type"))))
    own = F.when(F.col("r.record_type") == "metadata", derived_id("metadata", F.col("record_id"), F.col("payload_digest"))).otherwise(derived_id("conversion", F.col("record_id"), F.col("payload_digest")))
    return both.select(
        "page_id", F.col("r.record_type").alias("record_type"), own.alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("r.mime").alias("mime"),
        F.coalesce(source_headers, F.lit("")).alias("source_headers"), F.col("payload_digest").alias("source_payload_digest"), F.col("r.block").alias("block"),
        F.octet_length("r.block").cast("long").alias("content_length"), sha(F.col("r.block")).alias("block_digest"),
    )


def digest(pages: DataFrame) -> DataFrame:
    """The records of ``pages`` with their blocks as digests and lengths only."""
    return derive(responses(pages)).drop("block")


# ---------------------------------------------------------------- files

HEADERS = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("Content-Type", "mime"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Length", "content_length"))


def _one_line(value) -> str:
    """A header value; a line break, which would end the header, is written as in a URL."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    block = (row["block"] or "").encode()
    head = ["WARC/1.1", *(f"{k}: {_one_line(row[c])}" for k, c in HEADERS if row[c] is not None)] + ([row["source_headers"]] if row["source_headers"] else [])
    return CRLF.join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_files(records: DataFrame, out_dir: str) -> DataFrame:
    """Write records as gzip WARC files, one member per record and one file per partition; returns path, records, bytes."""
    bounded_batches(records.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        fs, root = pafs.FileSystem.from_uri(out_dir)
        fs.create_dir(root, recursive=True)
        own, final = f"{root}/.{uuid.uuid4().hex}", f"{root}/{part:06d}.warc.gz"
        with fs.open_output_stream(own) as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(gzip.compress(record_bytes(row), 6, mtime=0))
                    n += 1
        fs.move(own, final)
        yield pa.RecordBatch.from_pydict({"path": [f"{out_dir}/{part:06d}.warc.gz"], "records": [n], "bytes": [fs.get_file_info(final).size]})

    return records.mapInArrow(run, "path string, records long, bytes long")


def read_file(path: str):
    """The records of one file: (headers in order, block bytes)."""
    fs, p = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(p, compression=None) as f, gzip.open(f) as z:
        while line := z.readline():
            if line.strip() == b"":
                continue
            headers = []
            while (line := z.readline().rstrip(b"\r\n")) != b"":
                k, _, v = line.decode().partition(": ")
                headers.append((k, v))
            yield headers, z.read(int(dict(headers)["Content-Length"]))
