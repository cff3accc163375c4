import pytest
from pyspark.sql import functions as F

from termforge.config import IndexConfig
from termforge.operators import barrels, forward, inverted, lexicon, search, terms
from termforge.plans import index as plans
from termforge.sources import papers as source
from termforge.streaming import arrivals

BODIES = [
    (0, "p0", ""),
    (1, "p1", "virus cells virus the protein"),
    (2, "p0", "cells patients"),
    (3, "p1", "ignored duplicate virus"),
    (4, "p2", "the 12 3.5"),
    (5, "p3", "zebra virus patients cells cells"),
]


@pytest.fixture(scope="module")
def papers(spark):
    df = spark.createDataFrame(BODIES, "doc_ord long, paper_id string, body_text string")
    return df.select("*", *[F.lit("").alias(c) for c in ("title", "authors", "publish_date", "abstract_text")])


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ids_follow_first_occurrence_and_duplicates_count_in_the_lexicon(papers):
    i = plans.index(papers, IndexConfig(max_docs=None))
    assert rows(i.lexicon, "word_id", "word", "frequency") == [(0, "virus", 4), (1, "cells", 4), (2, "protein", 1), (3, "patients", 2), (4, "ignored", 1), (5, "duplicate", 1), (6, "zebra", 1)]
    assert rows(forward.indexed(terms.doc_terms(papers)), "doc_num", "doc_id", "doc_length") == [(0, "p1", 4), (1, "p0", 2), (2, "p3", 5)]
    assert i.lexicon.agg(F.sum("frequency")).first()[0] - i.forward.agg(F.sum("frequency")).first()[0] == 3  # the skipped duplicate's words
    assert rows(inverted.terms(i.postings, 0), "doc_id", "frequency") == [(0, 2), (2, 1)]
    assert forward.document(i.forward, "p1").first()["terms"] == [(0, 2), (1, 1), (2, 1)]
    assert rows(forward.term_frequencies(i.forward, papers.sparkSession.createDataFrame([("p3", 1), ("p9", 1)], "doc_id string, word_id long")), "doc_id", "frequency") == [("p3", 2), ("p9", 0)]


def test_the_first_papers_are_kept_before_filtering(papers):
    i = plans.index(papers, IndexConfig(max_docs=2))
    assert rows(i.lexicon, "word") == [("cells",), ("protein",), ("virus",)]


def test_statistics_of_an_empty_index(papers):
    i = plans.index(papers.limit(0))
    assert tuple(forward.statistics(i.forward).first()) == (0, 0, 0.0, 0.0)
    assert tuple(inverted.statistics(i.postings).first()) == (0, 0, 0.0, 0, 0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9])
def test_barrels_cover_all_postings(papers, n):
    i = plans.index(papers, IndexConfig(max_docs=None))
    own = rows(barrels.assigned(i.postings, n), "word_id", "doc_id", "barrel_id")
    ids = sorted({w for w, _, _ in own})
    per = -(-(ids[-1] - ids[0] + 1) // n)
    assert all(b == (w - ids[0]) // per for w, _, b in own) and len(own) == i.postings.count()
    meta = rows(barrels.metadata(i.postings, n), "barrel_id", "start_word_id", "end_word_id", "words", "postings")
    assert meta[-1][2] == ids[-1] and sum(m[4] for m in meta) == len(own)


def test_zero_barrels_are_refused(papers):
    with pytest.raises(ValueError):
        barrels.ranges(plans.index(papers).postings, 0)


def test_stored_index_answers_like_the_lazy_one(spark, papers, tmp_path):
    path = str(tmp_path / "index")
    plans.build(papers, path, IndexConfig(max_docs=None, num_barrels=3))
    i = plans.index(papers, IndexConfig(max_docs=None))
    words = ["virus", "cells", "missing"]
    cols = ("word", "found", "word_id", "doc_count", "rank", "doc_id", "frequency")
    key = lambda r: tuple(str(x) for x in r)
    lazy = sorted(map(tuple, search.search(i.lexicon, i.postings, search.words_frame(spark, words)).select(*cols).collect()), key=key)
    assert sorted(map(tuple, search.search_stored(spark, path, words).select(*cols).collect()), key=key) == lazy
    plan = barrels.lookup(spark, path, 0)
    assert rows(plan, "doc_id", "frequency") == [(0, 2), (2, 1)]
    assert "PartitionFilters: [isnotnull(barrel_id" in plan._jdf.queryExecution().toString()
    assert barrels.lookup(spark, path, 10**6).count() == 0
    assert plans.report(path, spark)["total_documents"] == 3


def test_extension_equals_a_whole_build(papers):
    t = terms.doc_terms(papers)
    whole = rows(lexicon.build(t), "word", "word_id", "frequency")
    parts = lexicon.extend(lexicon.build(t.where("doc_ord < 3")), t.where("doc_ord >= 3"))
    assert rows(parts, "word", "word_id", "frequency") == whole
    assert rows(lexicon.extend(lexicon.build(t.limit(0)), t), "word", "word_id", "frequency") == whole


def test_stream_extends_the_lexicon(spark, papers, tmp_path):
    for k, part in enumerate(("doc_ord < 3", "doc_ord >= 3")):
        papers.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            lexicon.build(terms.doc_terms(papers.limit(0))).write.parquet(str(tmp_path / "lex/0"))
        stream = spark.readStream.schema(papers.schema).parquet(str(tmp_path / "in"))
        arrivals.extend_lexicon(stream, str(tmp_path / "lex"), str(tmp_path / "cp")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "lex/2")), "word", "word_id", "frequency") == rows(lexicon.build(terms.doc_terms(papers)), "word", "word_id", "frequency")


def test_documents_stand_for_papers(spark):
    df = spark.createDataFrame([(3, "virus", "x"), (1, None, "y")], "doc_id long, text string, word string")
    assert rows(terms.doc_terms(source.from_documents(df)), "paper_id", "word") == [(3, "virus")]
