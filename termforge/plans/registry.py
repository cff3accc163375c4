"""Queries by name and their DuckDB twins, over whole tables.

``documents`` stands for papers: doc_id is both id and order, text is the body.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.config import IndexConfig, TextConfig
from termforge.functions import stemmer, text
from termforge.operators import barrels, forward, inverted, lexicon, search, terms
from termforge.plans import index as plans
from termforge.plans.index import of_terms
from termforge.shared import shared_dir
from termforge.sources import papers as source
from termforge.sources import stored

WORDS = ("ci", "de", "en", "la", "der", "virus", "notaword")
DOC_IDS = (0, 1, 7, 42, 10**12)
BARRELS = 4
TERM_QUERIES = tuple((d, w) for d in DOC_IDS for w in (0, 1, 10**9))
TOP, FIRST = 100, 10
SPLIT = 500  # documents of a smaller id come first in incremental_lexicon


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.from_documents(_documents(spark, sf_dir))


def _terms(spark, sf_dir, config: TextConfig = TextConfig()):
    """The one heavy stage, kept: all queries over the same tables read it from there (spilling to disk)."""
    return terms.doc_terms(_papers(spark, sf_dir), config).persist(StorageLevel.MEMORY_AND_DISK)


def _index(spark, sf_dir):
    counted = _terms(spark, sf_dir)
    return of_terms(counted, lexicon.build(counted).persist(StorageLevel.MEMORY_AND_DISK))


def clean_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", text.remove_special_chars(text.to_lower_case(F.col("text"))).alias("clean"))


def tokens(spark, sf_dir):
    return terms.tokens(_papers(spark, sf_dir)).select(F.col("paper_id").alias("doc_id"), "pos", "word")


def token_counts(spark, sf_dir):
    raw = text.raw_words(F.coalesce("text", F.lit("")))
    return _documents(spark, sf_dir).select("doc_id", F.size(raw).cast("long").alias("n_raw"), F.size(text.preprocess(F.coalesce("text", F.lit("")))).cast("long").alias("n_kept"))


def stopword_hits(spark, sf_dir):
    rows = _documents(spark, sf_dir).select(F.explode(text.raw_words(F.col("text"))).alias("word"))
    return rows.where(text.is_stop_word(F.col("word"))).groupBy("word").agg(F.count("*").alias("hits"))


def build_lexicon(spark, sf_dir):
    return lexicon.build(_terms(spark, sf_dir))


def lexicon_top(spark, sf_dir):
    return lexicon.top(build_lexicon(spark, sf_dir), TOP)


def word_lookup(spark, sf_dir):
    return lexicon.details(build_lexicon(spark, sf_dir), search.words_frame(spark, list(WORDS)))


def reverse_lexicon(spark, sf_dir):
    return lexicon.reverse(build_lexicon(spark, sf_dir))


def doc_terms(spark, sf_dir):
    return _terms(spark, sf_dir).select(F.col("paper_id").alias("doc_id"), "word", "frequency")


def forward_index(spark, sf_dir):
    return _index(spark, sf_dir).forward.select("doc_id", "word_id", "frequency")


def forward_nested(spark, sf_dir):
    rows = forward.nested(_index(spark, sf_dir).forward)
    return rows.select("doc_id", "doc_length", F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["word_id"].cast("string"), t["frequency"].cast("string"))), " ").alias("terms"))


def doc_lengths(spark, sf_dir):
    wanted = spark.createDataFrame([(d,) for d in DOC_IDS], "doc_id long")
    return forward.lengths(_index(spark, sf_dir).forward, wanted)


def term_frequency(spark, sf_dir):
    return forward.term_frequencies(_index(spark, sf_dir).forward, spark.createDataFrame(TERM_QUERIES, "doc_id long, word_id long"))


def forward_stats(spark, sf_dir):
    return forward.statistics(_index(spark, sf_dir).forward)


def inverted_stats(spark, sf_dir):
    return inverted.statistics(_index(spark, sf_dir).postings)


def forward_first_n(spark, sf_dir):
    return forward.first_documents(_index(spark, sf_dir).forward, FIRST)


def inverted_first_n(spark, sf_dir):
    return inverted.first_words(_index(spark, sf_dir).postings, FIRST)


def doc_id_map(spark, sf_dir):
    return forward.indexed(_terms(spark, sf_dir)).select("doc_id", "doc_num")


def dedup_documents(spark, sf_dir):
    """Every document comes twice, the second time later and with another text: the first with words counts."""
    own = _papers(spark, sf_dir)
    again = own.withColumn("doc_ord", F.col("doc_ord") + 1_000_000).withColumn("body_text", F.concat("body_text", F.lit(" again")))
    return forward.indexed(terms.doc_terms(own.unionByName(again))).select("doc_id", "doc_num", "doc_length")


def inverted_index(spark, sf_dir):
    return _index(spark, sf_dir).postings


def postings_nested(spark, sf_dir):
    rows = inverted.nested(_index(spark, sf_dir).postings)
    return rows.select("word_id", "word", F.array_join(F.transform("postings", lambda t: F.concat_ws(":", t["doc_id"].cast("string"), t["frequency"].cast("string"))), " ").alias("postings"))


def barrel_assignment(spark, sf_dir):
    return barrels.assigned(_index(spark, sf_dir).postings).select("word_id", "doc_id", "barrel_id")


def barrel_metadata(spark, sf_dir):
    return barrels.metadata(_index(spark, sf_dir).postings)


def barrel_lookup(spark, sf_dir):
    i = _index(spark, sf_dir)
    wanted = lexicon.details(i.lexicon, search.words_frame(spark, list(WORDS))).select("word", "word_id")
    return barrels.locate(barrels.metadata(i.postings), wanted)


def term_search(spark, sf_dir):
    i = _index(spark, sf_dir)
    return search.search(i.lexicon, i.postings, search.words_frame(spark, list(WORDS)))


def incremental_lexicon(spark, sf_dir):
    t = _terms(spark, sf_dir)
    return lexicon.extend(lexicon.build(t.where(F.col("doc_ord") < SPLIT)), t.where(F.col("doc_ord") >= SPLIT))


def stemmed_words(spark, sf_dir):
    return stemmer.stemmed(terms.tokens(_papers(spark, sf_dir)).select("word").distinct())


def stemmed_lexicon(spark, sf_dir):
    return lexicon.build(_terms(spark, sf_dir, TextConfig(use_stemming=True)))


def csv_fields(spark, sf_dir):
    """Documents' words quoted and joined to lines, parsed back: the number of fields and the longest field."""
    line = F.concat_ws(",", F.col("doc_id").cast("string"), F.lit('"a,b ""c"""'), F.col("source"), F.concat(F.lit('"'), F.replace("text", F.lit("\n"), F.lit(" "))))
    rows = _documents(spark, sf_dir).select("doc_id", source.csv_fields(line).alias("f"))
    return rows.select("doc_id", F.size("f").cast("long").alias("n_fields"), F.col("f")[1].alias("second"), F.length(F.col("f")[3]).cast("long").alias("last_length"))


def stemmed_tokens(spark, sf_dir):
    return terms.tokens(_papers(spark, sf_dir), TextConfig(use_stemming=True)).select(F.col("paper_id").alias("doc_id"), "pos", "word")


def raw_tokens(spark, sf_dir):
    """What tokenizing alone gives, and what of it is no stop word, and what is a number."""
    words = text.tokenize(F.coalesce("text", F.lit("")))
    rows = _documents(spark, sf_dir).select("doc_id", words.alias("w"))
    size = lambda c: F.size(c).cast("long")
    return rows.select("doc_id", size(F.col("w")).alias("n_tokens"), size(text.remove_stop_words(F.col("w"))).alias("n_plain"), size(F.filter("w", text.is_number)).alias("n_numbers"))


def clean_field(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", source.clean_field(F.concat(F.lit(' \t"'), F.col("source"), F.lit('"\r'))).alias("field"))


def forward_document(spark, sf_dir):
    rows = forward.document(_index(spark, sf_dir).forward, DOC_IDS[2])
    return rows.select("doc_id", "doc_length", F.explode("terms").alias("t")).select("doc_id", "doc_length", "t.word_id", "t.frequency")


def word_postings(spark, sf_dir):
    return inverted.terms(_index(spark, sf_dir).postings, 0)


def appended_postings(spark, sf_dir):
    """Documents added again as later ones: their postings come twice."""
    own = _index(spark, sf_dir).postings
    return inverted.append(own, own.withColumn("doc_id", F.col("doc_id") + 1_000_000)).select("word_id", "doc_id", "frequency")


def lexicon_size(spark, sf_dir):
    own = build_lexicon(spark, sf_dir)
    return own.agg(F.count("*").alias("words"), F.bool_or(F.col("word") == WORDS[1]).alias("has_word"))


# sources and sinks: files are made of the documents in the shared folder, and read back


def _metadata_folder(spark, sf_dir) -> str:
    """A data folder whose metadata file has a header, and a good, a short and an empty line for each document."""
    path = shared_dir(spark, "papers")
    blank = F.lit("")
    sha, pmcid = (F.when(F.col("lang") == "en", F.concat(F.lit("s"), "doc_id")).otherwise(""), F.when(F.col("source").isNotNull(), F.concat(F.lit("P"), "doc_id")).otherwise(""))
    title = F.concat(F.lit('" T, '), F.coalesce("source", blank), F.lit(' "'))
    good = F.concat_ws(",", F.col("doc_id").cast("string"), sha, blank, title, blank, pmcid, blank, blank, F.coalesce("lang", blank), F.lit("2020"), F.when(F.col("lang") == "de", F.lit("Me")))
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.array(good, F.lit("short,line"), blank)).alias("k", "value"))
    head = spark.createDataFrame([(None, -1, "cord_uid,sha,source_x,title,doi,pmcid,pubmed_id,license,abstract,publish_time,authors")], lines.schema)
    lines.unionAll(head).orderBy(F.asc_nulls_first("doc_id"), "k").select("value").coalesce(1).write.text(f"{path}/metadata.csv")  # the format is one file
    return path


def _raw_bodies(spark, sf_dir):
    """stem, raw of the two kinds of JSON bodies: some malformed, some with a text that is no string."""
    part = lambda c: F.array(F.struct(F.col(c).alias("text")))
    docs = _documents(spark, sf_dir)
    whole = F.to_json(F.struct(part("source").alias("abstract"), part("text").alias("body_text")))
    raw = F.when(F.length("text") < 100, F.lit("{")).when(F.length("text") < 200, F.lit('{"body_text": [{"text": 5}]}')).otherwise(whole)
    pdf = docs.select(F.concat(F.lit("s"), "doc_id").alias("stem"), raw.alias("raw"))
    xml = docs.select(F.concat(F.lit("P"), "doc_id").alias("stem"), F.to_json(F.struct(part("lang").alias("body_text"))).alias("raw"))
    return pdf, xml


def metadata(spark, sf_dir):
    return source.metadata(spark, _metadata_folder(spark, sf_dir))


def metadata_stats(spark, sf_dir):
    return spark.createDataFrame([(source.count_records(spark, _metadata_folder(spark, sf_dir)),)], "records long")


def json_body(spark, sf_dir):
    return source.parsed_bodies(_raw_bodies(spark, sf_dir)[0])


def papers(spark, sf_dir):
    pdf, xml = (source.parsed_bodies(b) for b in _raw_bodies(spark, sf_dir))
    return source.with_bodies(source.metadata(spark, _metadata_folder(spark, sf_dir)), pdf, xml).select("doc_ord", "paper_id", "title", "authors", "body_text")


def bodies_text(spark, sf_dir):
    """The bodies written as text with end marks: marks and characters read back."""
    path = shared_dir(spark, "bodies")
    stored.save_bodies_text(_papers(spark, sf_dir), path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.agg(F.count_if(F.col("value") == "---END OF DOCUMENT---").alias("marks"), F.sum(F.length("value").cast("long")).alias("chars"))


def stored_lexicon(spark, sf_dir):
    path = shared_dir(spark, "lexicon")
    stored.save_lexicon_csv(build_lexicon(spark, sf_dir), path)
    return stored.load_lexicon_csv(spark, path)


def stored_lexicon_repeats(spark, sf_dir):
    """A lexicon file in which every word comes twice: the later row counts."""
    path = shared_dir(spark, "lexicon")
    own = build_lexicon(spark, sf_dir)
    twice = own.withColumn("k", F.lit(0)).unionAll(own.select("word", F.lit(0).alias("word_id"), F.col("frequency") + 1, F.lit(1)))
    twice.orderBy("k", "word").drop("k").coalesce(1).write.csv(path, header=True, quoteAll=True)
    return stored.load_lexicon_csv(spark, path)


def _csv(spark, path, schema):
    return spark.read.schema(schema).csv(path, header=True)


def forward_csv(spark, sf_dir):
    path = shared_dir(spark, "forward")
    stored.save_forward_csv(_index(spark, sf_dir).forward, path)
    return _csv(spark, path, "doc_id long, word_id long, frequency long")


def forward_csv_first_n(spark, sf_dir):
    path = shared_dir(spark, "forward")
    stored.save_first_documents_csv(_index(spark, sf_dir).forward, FIRST, path)
    return _csv(spark, path, "doc_id long, word_id long, frequency long")


def postings_csv(spark, sf_dir):
    path = shared_dir(spark, "postings")
    stored.save_postings_csv(_index(spark, sf_dir).postings, path)
    return _csv(spark, path, "word_id long, word string, doc_id long, frequency long")


def postings_csv_first_n(spark, sf_dir):
    path = shared_dir(spark, "postings")
    stored.save_first_words_csv(_index(spark, sf_dir).postings, FIRST, path)
    return _csv(spark, path, "word_id long, word string, doc_id long, frequency long")


def barrels_csv(spark, sf_dir):
    path = shared_dir(spark, "barrels")
    stored.export_barrels_csv(barrels.assigned(_index(spark, sf_dir).postings, BARRELS), path)
    return _csv(spark, path, "word_id long, word string, doc_id long, frequency long, barrel_id long").select("barrel_id", "word_id", "word", "doc_id", "frequency")


def _stored(spark, sf_dir) -> str:
    path = shared_dir(spark, "index")
    plans.build(_papers(spark, sf_dir), path, IndexConfig(num_barrels=BARRELS))
    return path


def stored_barrels(spark, sf_dir):
    path = shared_dir(spark, "barrels")
    barrels.write(_index(spark, sf_dir).postings, path, BARRELS)
    return spark.read.parquet(f"{path}/barrels").select("word_id", "doc_id", "frequency", F.col("barrel_id").cast("long").alias("barrel_id"))


def stored_barrel_metadata(spark, sf_dir):
    path = shared_dir(spark, "barrels")
    barrels.write(_index(spark, sf_dir).postings, path, BARRELS)
    return barrels.load_metadata(spark, path)


def stored_lookup(spark, sf_dir):
    """The postings of one word, read from its barrel alone."""
    return barrels.lookup(spark, _stored(spark, sf_dir), 0).select("word_id", "doc_id", "frequency")


def stored_forward(spark, sf_dir):
    return spark.read.parquet(f"{_stored(spark, sf_dir)}/forward").select("doc_id", "word_id", "frequency")


def search_stored(spark, sf_dir):
    return search.search_stored(spark, _stored(spark, sf_dir), list(WORDS))


QUERIES = {
    f.__name__: f
    for f in (
        term_search, clean_text, tokens, token_counts, stopword_hits, lexicon_top, word_lookup, reverse_lexicon, doc_terms, forward_index, forward_nested, doc_lengths, term_frequency,
        forward_stats, inverted_stats, forward_first_n, inverted_first_n, doc_id_map, dedup_documents, inverted_index, postings_nested, barrel_assignment, barrel_metadata, barrel_lookup,
        incremental_lexicon, stemmed_words, stemmed_lexicon, csv_fields, stemmed_tokens, raw_tokens, clean_field, forward_document, word_postings, appended_postings, lexicon_size,
        metadata, metadata_stats, json_body, papers, bodies_text, stored_lexicon, stored_lexicon_repeats, forward_csv, forward_csv_first_n, postings_csv, postings_csv_first_n, barrels_csv,
        stored_barrels, stored_barrel_metadata, stored_lookup, stored_forward, search_stored,
    )
} | {"lexicon": build_lexicon}


# ---------------------------------------------------------------- DuckDB SQL


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_PLAIN = _list(text.PLAIN_STOP_WORDS)
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_VALID = "length({0}) >= 2 and regexp_matches({0}, '[a-z]')"


def _base(documents: str = "select doc_id as ord, doc_id, text from documents") -> str:
    """Tables from raw words to postings."""
    return f"""
src as ({documents}),
a as (select ord, doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') as l from src),
t as (select ord, doc_id, unnest(range(len(l))) as pos, lower(unnest(l)) as word from a),
tok as (select * from t where {_VALID.format("word")} and word not in ({_PLAIN})),
lex as (select word, row_number() over (order by min(ord * 100000000 + pos)) - 1 as word_id, count(*) as frequency from tok group by word),
dim as (select ord, doc_id, row_number() over (order by ord) - 1 as doc_num from (select ord, doc_id from tok group by ord, doc_id qualify row_number() over (partition by doc_id order by ord) = 1)),
fwd as (select doc_num, tok.doc_id, word_id, tok.word, count(*) as frequency from tok join dim on tok.ord = dim.ord join lex on tok.word = lex.word group by all),
post as (select word_id, word, doc_num as doc_id, frequency from fwd),
r as (select min(word_id) as lo, max(word_id) as hi, (max(word_id) - min(word_id) + 4) // 4 as per from post),
meta as (select (word_id - lo) // per as barrel_id, lo + ((word_id - lo) // per) * per as start_word_id, least(lo + ((word_id - lo) // per) * per + per - 1, hi) as end_word_id,
         count(distinct word_id) as words, count(*) as postings from post, r group by all)
"""


def _with(select: str, **base) -> str:
    return f"with {_base(**base)} {select}"


_WANTED = "(values " + ", ".join(f"('{w}')" for w in WORDS) + ") q(word)"
_DOCS = "(values " + ", ".join(f"({d}::bigint)" for d in DOC_IDS) + ") q(doc_id)"
_PAIRS = "(values " + ", ".join(f"({d}::bigint, {w}::bigint)" for d, w in TERM_QUERIES) + ") q(doc_id, word_id)"
_SEARCH = f"""select q.word, lex.word_id is not null as found, lex.word_id, count(post.doc_id) over (partition by q.word) as doc_count, row_number() over (partition by q.word order by post.doc_id) as rank, post.doc_id, post.frequency
        from {_WANTED} left join lex on q.word = lex.word left join post on lex.word_id = post.word_id qualify rank <= 5"""
_ORD = "row_number() over (order by doc_id) - 1"
_SHA, _PMC = "case when lang = 'en' then 's' || doc_id else '' end", "case when source is not null then 'P' || doc_id else '' end"
_TITLE = "trim('T, ' || coalesce(source, ''))"
_PDF = "case when length(text) >= 200 then coalesce(source || chr(10) || chr(10), '') || text || chr(10) || chr(10) else '' end"
_SPACE = r" \t\n\x0B\f\r"
_OTHER = rf"[^A-Za-z0-9{_SPACE}]+"


def _stem_sql() -> str:
    """CTEs s0..s9 that stem the words of ``voc``; each step sees the word and its letter kinds."""
    kinds = "list_reduce(list_prepend('', string_split({0}, '')), lambda a, c: a || case when c in ('a', 'e', 'i', 'o', 'u') or (c = 'y' and right(a, 1) = 'c') then 'v' when c = '' then '' else 'c' end)"
    cut = lambda c, n: f"left({c}, length({c}) - {n})" if n else c
    m = lambda c: f"len(regexp_extract_all({c}, 'v+c+'))"
    ends = lambda c, s: f"suffix({c}, '{s}')"
    rules = lambda rs: "case " + " ".join(f"when {ends('w', s)} and {m(cut('k', len(s)))} > 0 then {cut('w', len(s))} || '{r}'" for s, r in rs) + " else w end"
    double = lambda w, k: f"(length({w}) >= 2 and right({w}, 1) = substr({w}, length({w}) - 1, 1) and {ends(k, 'c')})"
    short = lambda w, k: f"({ends(k, 'cvc')} and right({w}, 1) not in ('w', 'x', 'y'))"
    s, sk = cut("w", 1), cut("k", 1)
    step4 = "case " + " ".join(f"when {ends('w', x)} and {m(cut('k', len(x)))} > 1" + (f" and (length(w) = 3 or substr(w, length(w) - 3, 1) in ('s', 't'))" if x == "ion" else "") + f" then {cut('w', len(x))}" for x in stemmer.STEP_4) + " else w end"
    steps = (
        f"case when {ends('w', 'sses')} or {ends('w', 'ies')} then {cut('w', 2)} when {ends('w', 'ss')} then w when {ends('w', 's')} then {s} else w end",
        f"case when {ends('w', 'eed')} then (case when {m(cut('k', 3))} > 0 then {s} else w end) when {ends('w', 'ed')} and contains({cut('k', 2)}, 'v') then {cut('w', 2)} || ' ' when {ends('w', 'ing')} and contains({cut('k', 3)}, 'v') then {cut('w', 3)} || ' ' else w end",
        f"case when not {ends('w', ' ')} then w when {ends(s, 'at')} or {ends(s, 'bl')} or {ends(s, 'iz')} then {s} || 'e' when {double(s, sk)} and right({s}, 1) not in ('l', 's', 'z') then {cut('w', 2)} when {m(sk)} = 1 and {short(s, sk)} then {s} || 'e' else {s} end",
        f"case when {ends('w', 'y')} and contains({sk}, 'v') then {s} || 'i' else w end",
        rules(stemmer.STEP_2), rules(stemmer.STEP_3), step4,
        f"case when {ends('w', 'e')} and ({m(sk)} > 1 or ({m(sk)} = 1 and not {short(s, sk)})) then {s} else w end",
        f"case when {m('k')} > 1 and {double('w', 'k')} and {ends('w', 'l')} then {s} else w end",
    )
    out = ["s0 as (select word, word as w from voc)"]
    for i, step in enumerate(steps):
        out.append(f"s{i + 1} as (select word, {step} as w from (select word, w, {kinds.format('w')} as k from s{i}))")
    out.append(f"stems as (select word, case when length(word) <= 2 then word else w end as stem from s{len(steps)})")
    return ",\n".join(out)


ORACLE = {
    "clean_text": "select doc_id, regexp_replace(regexp_replace({0}, '(^| ){1}', '\\1', 'g'), '{1}', ' ', 'g') as clean from documents".format(_ASCII.format("text"), _OTHER),
    "tokens": _with("select doc_id, pos, word from tok"),
    "token_counts": _with(f"select doc_id, len(l)::bigint as n_raw, len(list_filter(l, lambda x: {_VALID.format('lower(x)')} and lower(x) not in ({_PLAIN})))::bigint as n_kept from a"),
    "stopword_hits": _with(f"select word, count(*) as hits from t where word in ({_list(text.STOP_WORDS)}) group by word"),
    "lexicon": _with("select * from lex"),
    "lexicon_top": _with(f"select * from lex order by frequency desc, word_id limit {TOP}"),
    "word_lookup": _with(f"select q.word, word_id is not null as found, word_id, frequency from {_WANTED} left join lex on q.word = lex.word"),
    "reverse_lexicon": _with("select word_id, word from lex"),
    "doc_terms": _with("select doc_id, word, count(*) as frequency from tok group by doc_id, word"),
    "forward_index": _with("select doc_id, word_id, frequency from fwd"),
    "forward_nested": _with("select doc_id, sum(frequency)::bigint as doc_length, string_agg(word_id || ':' || frequency, ' ' order by word_id) as terms from fwd group by doc_id"),
    "doc_lengths": _with(f"select q.doc_id, coalesce(sum(frequency), 0)::bigint as doc_length from {_DOCS} left join fwd on q.doc_id = fwd.doc_id group by q.doc_id"),
    "term_frequency": _with(f"select q.doc_id, q.word_id, coalesce(frequency, 0) as frequency from {_PAIRS} left join fwd on q.doc_id = fwd.doc_id and q.word_id = fwd.word_id"),
    "forward_stats": _with("select count(*) as total_documents, coalesce(sum(n), 0)::bigint as total_terms, round(coalesce(avg(n), 0), 2) as avg_doc_length, round(coalesce(avg(u), 0), 2) as avg_unique_terms from (select sum(frequency) as n, count(*) as u from fwd group by doc_num)"),
    "inverted_stats": _with("select count(*) as unique_words, coalesce(sum(n), 0)::bigint as total_postings, round(coalesce(avg(n), 0), 2) as avg_docs_per_word, coalesce(min(n), 0) as min_docs_per_word, coalesce(max(n), 0) as max_docs_per_word from (select count(*) as n from post group by word_id)"),
    "forward_first_n": _with(f"select doc_id, word_id, frequency from fwd where doc_num < {FIRST}"),
    "inverted_first_n": _with(f"select * from post qualify dense_rank() over (order by word_id) <= {FIRST}"),
    "doc_id_map": _with("select doc_id, doc_num from dim"),
    "dedup_documents": _with(
        "select dim.doc_id, doc_num, count(*) as doc_length from dim join tok on dim.ord = tok.ord group by all",
        documents="select doc_id as ord, doc_id, text from documents union all select doc_id + 1000000, doc_id, text || ' again' from documents",
    ),
    "inverted_index": _with("select * from post"),
    "postings_nested": _with("select word_id, word, string_agg(doc_id || ':' || frequency, ' ' order by doc_id) as postings from post group by word_id, word"),
    "barrel_assignment": _with("select word_id, doc_id, (word_id - lo) // per as barrel_id from post, r"),
    "barrel_metadata": _with("select * from meta"),
    "barrel_lookup": _with(f"select q.word, word_id, barrel_id from {_WANTED} left join lex on q.word = lex.word left join meta on word_id between start_word_id and end_word_id"),
    "term_search": _with(_SEARCH),
    "incremental_lexicon": _with("select * from lex"),
    "stemmed_words": _with(f", voc as (select distinct word from tok), {_stem_sql()} select word, stem from stems"),
    "stemmed_lexicon": _with(
        f""", voc as (select distinct word from t where word not in ({_PLAIN})), {_stem_sql()}
        select stem as word, row_number() over (order by min(ord * 100000000 + pos)) - 1 as word_id, count(*) as frequency from t join stems on t.word = stems.word where {_VALID.format("stem")} group by stem"""
    ),
    "stemmed_tokens": _with(f""", voc as (select distinct word from t where word not in ({_PLAIN})), {_stem_sql()}
        select doc_id, pos, stem as word from t join stems on t.word = stems.word where {_VALID.format("stem")}"""),
    "raw_tokens": f"""with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[{_SPACE}]+'), lambda x: x <> '') as w from documents)
        select doc_id, len(w)::bigint as n_tokens, len(list_filter(w, lambda x: x not in ({_list(text.STOP_WORDS)})))::bigint as n_plain, len(list_filter(w, lambda x: regexp_full_match(x, '[0-9.,]+')))::bigint as n_numbers from w""",
    "clean_field": "select doc_id, source as field from documents",
    "forward_document": _with(f"select doc_id, sum(frequency) over ()::bigint as doc_length, word_id, frequency from fwd where doc_id = {DOC_IDS[2]}"),
    "word_postings": _with("select doc_id, frequency from post where word_id = 0"),
    "appended_postings": _with("select word_id, doc_id, frequency from post union all select word_id, doc_id + 1000000, frequency from post"),
    "lexicon_size": _with(f"select count(*) as words, bool_or(word = '{WORDS[1]}') as has_word from lex"),
    "metadata": f"""select {_ORD} as doc_ord, doc_id::varchar as paper_id, {_SHA} as sha, {_PMC} as pmcid, {_TITLE} as title, coalesce(lang, '') as abstract_text, '2020' as publish_date,
        case when lang = 'de' then 'Me' else '' end as authors from documents""",
    "metadata_stats": "select 2 * count(*) as records from documents",
    "json_body": f"select 's' || doc_id as stem, {_PDF} as body from documents",
    "papers": f"""select {_ORD} as doc_ord, doc_id::varchar as paper_id, {_TITLE} as title, case when lang = 'de' then 'Me' else '' end as authors,
        coalesce(nullif(case when lang = 'en' then {_PDF} end, ''), case when source is not null then coalesce(lang || chr(10) || chr(10), '') end, '') as body_text from documents""",
    "bodies_text": "select count(*) as marks, sum(length(replace(text, chr(10), '')) + 23)::bigint as chars from documents where text <> ''".replace("23", str(len("---END OF DOCUMENT---"))),
    "stored_lexicon": _with("select * from lex"),
    "stored_lexicon_repeats": _with("select word, 0::bigint as word_id, (frequency + 1)::bigint as frequency from lex"),
    "forward_csv": _with("select doc_id, word_id, frequency from fwd"),
    "forward_csv_first_n": _with(f"select doc_id, word_id, frequency from fwd where doc_num < {FIRST}"),
    "postings_csv": _with("select * from post"),
    "postings_csv_first_n": _with(f"select * from post qualify dense_rank() over (order by word_id) <= {FIRST}"),
    "barrels_csv": _with("select (word_id - lo) // per as barrel_id, word_id, word, doc_id, frequency from post, r"),
    "stored_barrels": _with("select word_id, doc_id, frequency, (word_id - lo) // per as barrel_id from post, r"),
    "stored_barrel_metadata": _with("select * from meta"),
    "stored_lookup": _with("select word_id, doc_id, frequency from post where word_id = 0"),
    "stored_forward": _with("select doc_id, word_id, frequency from fwd"),
    "search_stored": _with(_SEARCH),
    "csv_fields": "select doc_id, 4::bigint as n_fields, 'a,b c' as second, length(replace(replace(text, chr(10), ' '), '\"', ''))::bigint as last_length from documents",
}
