"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm import ann, compaction, decontam, langid, minhash, repeats, secret_scan, sstable, viterbi, warc
from termforge.llm.common import shared_dir, table

BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
ARRIVALS = 3


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BPE))


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every input file arrives by itself; the rows come back from the compacted store."""
    files = sorted(table(spark, sf_dir, "documents").inputFiles())
    store = compaction.ingest(spark, files, shared_dir(spark, "store"))
    return store.read().select("doc_id", F.md5("text").alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"), "lang", "source", "n_chars")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input files arrive in up to ARRIVALS lots, one after the other, against one ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger, files = secret_scan.Ledger(spark), sorted(docs.inputFiles())
    for k in range(min(ARRIVALS, len(files))):
        ledger.scan(spark.read.parquet(*files[k::ARRIVALS]).select("doc_id", "text"))
    return secret_scan.digest(ledger.matched(docs))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=80)


QUERIES = {
    f.__name__: f
    for f in (op1_nearest, op2_warc, op3_sstable, op4_compaction, op5_language_id, op6_repeats, op7_minhash, op8_sentencepiece, op9_secret_scan, op10_decontamination)
}


# ---------------------------------------------------------------- DuckDB SQL


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _entities(expr: str) -> str:
    for entity, char in warc.ENTITIES:
        expr = f"replace({expr}, {_quoted(entity)}, {_quoted(char)})"
    return expr


def _sub(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {_quoted(pattern)}, {by}, 'g')"


def _uuid(kind: str, source: str, digest: str) -> str:
    h = f"sha256('{kind}|' || {source} || '|' || {digest})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_TEXT = _sub(_sub(_sub("payload", warc.DROPPED, "' '"), r"[ \t\r\n]+", "' '"), warc.BREAKS, "chr(10)")
_TEXT = _sub(_sub(_entities(_sub(_TEXT, warc.TAGS, "''")), r" *\n[ \n]*", "chr(10)"), r"^[ \n]+|[ \n]+$", "''")
_TITLE = _sub(_entities(_sub(f"regexp_extract(payload, {_quoted(warc.TITLE)}, 1)", r"[ \t\r\n]+", "' '")), "^ | $", "''")
_CRLF = "chr(13) || chr(10)"

WARC_SQL = f"""
with r as (select page_id, url as target_uri, coalesce(html, '') as payload from pages),
d as (select *, 'sha256:' || sha256(payload) as source_payload_digest from r),
i as (select *, {_uuid("response", "coalesce(page_id::varchar, '')", "source_payload_digest")} as refers_to, {_TEXT} as body, {_TITLE} as title,
      lower(regexp_extract(payload, {_quoted(warc.CHARSET)}, 1)) as charset, len(regexp_extract_all(payload, {_quoted(warc.LINK)})) as links from d),
b as (
  select *, 'conversion' as record_type, {_uuid("conversion", "refers_to", "source_payload_digest")} as record_id, 'text/plain; charset=utf-8' as mime,
    'X-Source-Status: HTTP/1.1 200 OK' || {_CRLF} || 'X-Source-Content-Type: text/html; charset=utf-8' as source_headers, body as block from i
  union all
  select *, 'metadata', {_uuid("metadata", "refers_to", "source_payload_digest")}, 'application/warc-fields', '',
    'status: HTTP/1.1 200 OK' || {_CRLF} || 'content-type: text/html; charset=utf-8' || {_CRLF} || 'charset: ' || charset || {_CRLF} || 'title: ' || title || {_CRLF} || 'links: ' || links::varchar
    || {_CRLF} || 'payload-length: ' || strlen(payload)::varchar || {_CRLF} || 'text-length: ' || strlen(body)::varchar || {_CRLF} from i)
select page_id, record_type, record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' as date, mime, source_headers, source_payload_digest,
  strlen(block)::bigint as content_length, 'sha256:' || sha256(block) as block_digest from b
"""

COMPACTION_SQL = "select doc_id, md5(text) as text_md5, strlen(text)::bigint as n_bytes, lang, source, n_chars from documents"

_RULES = {r.kind: r for r in secret_scan.RULES}


def _spans(order: int, kind: str) -> str:
    """All matches of one kind: what lies between matches and the matches alternate."""
    r = _RULES[kind]
    p = _quoted(r.pattern.replace("\\x20", " "))
    return f"""
  select rowid as k, {order} as ord, '{kind}' as kind, {str(r.base).lower()} as base, i,
    list_sum(list_transform(gaps[:i], lambda x: length(x))) + list_sum(list_transform(hits[:i], lambda x: length(x))) as stop, length(hits[i]) as n, length(parts[i]) as part, {r.least} as least
  from (select rowid, unnest(range(1, len(hits) + 1)) as i, gaps, hits, parts from (
    select rowid, regexp_extract_all(text, {p}) as hits, regexp_extract_all(text, {p}, {r.group}) as parts, regexp_split_to_array(text, {p}) as gaps from d))"""


SECRETS_SQL = f"""
with d as (select row_number() over () as rowid, doc_id, coalesce(text, '') as text from documents),
s as (select k, ord, kind, base, (stop - n)::bigint as a, stop::bigint as b from ({" union all ".join(_spans(i, r.kind) for i, r in enumerate(secret_scan.RULES))}) where part >= least),
g as (select k, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      string_agg(kind || ':' || a || ':' || b, ',' order by a, ord) filter (base) as own, string_agg(kind || ':' || a || ':' || b, ',' order by a, ord) as spans from s group by k)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(own, '')) as base_sha256, coalesce(spans, '') as spans from d left join g on d.rowid = g.k
"""

_SHINGLES = "case when len(w) = 0 then [] else list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) end"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

DECONTAMINATION_SQL = f"""
with i as (select item_id, h, len(h) as m from (select item_id, {_SHINGLES} as h from (select item_id, {_WORDS} as w from benchmark)) where len(h) > 0),
d as (select k, doc_id, {_SHINGLES} as h from (select row_number() over () as k, doc_id, {_WORDS} as w from documents)),
ig as (select item_id, m, g, count(*) as n from (select item_id, m, unnest(h) as g from i) group by all),
dg as (select k, unnest(range(len(h))) as p, unnest(h) as g from d),
hit as (select distinct dg.k, ig.item_id, ig.m, dg.p from dg join ig on dg.g = ig.g),
win as (select distinct hit.k, item_id, m, unnest(range(least(greatest(p - m + 1, 0), greatest(len(d.h) - m, 0)), least(p, greatest(len(d.h) - m, 0)) + 1)) as f from hit join d on hit.k = d.k),
wg as (select win.k, item_id, m, f, g, count(*) as n from win join dg on win.k = dg.k and dg.p >= f and dg.p < f + m group by all),
tot as (select k, item_id, m, f, sum(n) as size from wg group by all),
lo as (select wg.k, wg.item_id, wg.f, sum(least(wg.n, ig.n)) as low from wg join ig on wg.item_id = ig.item_id and wg.g = ig.g group by all),
sim as (select tot.k, tot.item_id, tot.f, low::bigint as low, (m + size - low)::bigint as un from tot join lo on tot.k = lo.k and tot.item_id = lo.item_id and tot.f = lo.f),
best as (select d.doc_id, item_id, f, low::double / un::double as similarity from sim join d on sim.k = d.k where 100 * low >= 80 * un)
select doc_id, item_id, f::bigint as first_word, similarity from best qualify row_number() over (partition by doc_id, item_id order by similarity desc, f) = 1
"""

ORACLE: dict[str, str] = {"op2_warc": WARC_SQL, "op4_compaction": COMPACTION_SQL, "op9_secret_scan": SECRETS_SQL, "op10_decontamination": DECONTAMINATION_SQL}
