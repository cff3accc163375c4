import json
import random
import struct

from pyspark.sql import functions as F

from termforge.sources import papers as source
from termforge.sources import stored


def model_fields(line):
    out, cur, inside = [], "", False
    for c in line:
        if c == '"':
            inside = not inside
        elif c == "," and not inside:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def test_csv_lines(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice('ab,," ') for _ in range(rng.randrange(16))) for _ in range(1000)] + ['a,"b,c",d', '"a""b",c', 'x,"open, to the end', "", 'a\x01b,"c\x01\x02,d",\x01\x03']
    for r in spark.createDataFrame([(x,) for x in lines], "l string").select("l", source.csv_fields(F.col("l")).alias("f")).collect():
        assert r["f"] == model_fields(r["l"]), r


def test_clean_field(spark):
    df = spark.createDataFrame([(' \t"a b"\r',), ("  ",), ('"',)], "f string")
    assert [r[0] for r in df.select(source.clean_field(F.col("f"))).collect()] == ["a b", "", '"']


def folder(tmp_path):
    pdf, xml = tmp_path / source.PDF_BODIES, tmp_path / source.XML_BODIES
    pdf.mkdir(parents=True)
    xml.mkdir(parents=True)
    text = lambda *t: [{"text": x} for x in t]
    (pdf / "s1.json").write_text(json.dumps({"abstract": text("A"), "body_text": text("B", "C")}))
    (pdf / "s2.json").write_text(json.dumps({"abstract": [], "body_text": []}))
    (pdf / "bad.json").write_text("{")
    (pdf / "num.json").write_text(json.dumps({"body_text": [{"text": 5}]}))
    (xml / "PMC2.xml.json").write_text(json.dumps({"body_text": text("X")}))
    rows = ["cord_uid,sha,source_x,title,doi,pmcid,pubmed_id,license,abstract,publish_time,authors", 'p1,s1,,"T, one",,,,,abs,2020,Me', "", "short,line", "p2,s2,,T2,,PMC2,,,,2021", "p3,bad,,T3,,PMC2,,,,2021,A", 'p4,"s1; s2",,T4,,,,,,2021,A', "p5,num,,T5,,,,,,,"]
    (tmp_path / "metadata.csv").write_text("\n".join(rows) + "\n")
    return str(tmp_path)


def test_papers(spark, tmp_path):
    path = folder(tmp_path)
    got = [tuple(r) for r in source.papers(spark, path).orderBy("doc_ord").select("doc_ord", "paper_id", "title", "authors", "body_text").collect()]
    assert got == [(0, "p1", "T, one", "Me", "A\n\nB\n\nC\n\n"), (1, "p2", "T2", "", "X\n\n"), (2, "p3", "T3", "A", "X\n\n"), (3, "p4", "T4", "A", ""), (4, "p5", "T5", "", "")]
    assert source.count_records(spark, path) == 6
    assert source.papers(spark, path, 2).count() == 2
    stored.save_bodies_text(source.papers(spark, path).where("doc_ord = 1"), str(tmp_path / "text"))
    assert "".join(p.read_text() for p in (tmp_path / "text").glob("part-*")) == "X\n\n\n\n---END OF DOCUMENT---\n\n"


def test_lexicon_csv_gives_the_same_words_back(spark, tmp_path):
    lex = spark.createDataFrame([("virus", 0, 3), ("cells", 1, 9)], stored.LEXICON)
    stored.save_lexicon_csv(lex, str(tmp_path / "lex"))
    assert sorted(map(tuple, stored.load_lexicon_csv(spark, str(tmp_path / "lex")).collect())) == [("cells", 1, 9), ("virus", 0, 3)]
    lines = next((tmp_path / "lex").glob("part-*.csv")).read_text().splitlines()
    assert lines == ['"word","word_id","frequency"', '"cells","1","9"', '"virus","0","3"']


def test_of_repeated_words_the_last_row_counts(spark, tmp_path):
    (tmp_path / "lex.csv").write_text('word,word_id,frequency\n"virus",7,3\n"cells",1,9\n"virus",2,5\nbad,x,1\n')
    assert sorted(map(tuple, stored.load_lexicon_csv(spark, str(tmp_path / "lex.csv")).collect())) == [("cells", 1, 9), ("virus", 2, 5)]


def test_first_documents_and_words_as_csv(spark, tmp_path):
    fwd = spark.createDataFrame([(0, "a", 5, "x", 2), (1, "b", 5, "x", 1), (2, "c", 6, "y", 1)], "doc_num long, doc_id string, word_id long, word string, frequency long")
    stored.save_first_documents_csv(fwd, 2, str(tmp_path / "f"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "f"), header=True).collect())) == [("a", "5", "2"), ("b", "5", "1")]
    post = fwd.selectExpr("word_id", "word", "doc_num as doc_id", "frequency")
    stored.save_first_words_csv(post, 1, str(tmp_path / "w"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "w"), header=True).collect())) == [("5", "x", "0", "2"), ("5", "x", "1", "1")]


def test_postings_csv_and_barrel_export(spark, tmp_path):
    post = spark.createDataFrame([(0, "virus", 1, 2, 0), (5, "cells", 1, 1, 1)], "word_id long, word string, doc_id long, frequency long, barrel_id long")
    stored.export_barrels_csv(post, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").glob("barrel_id=*")) == ["barrel_id=0", "barrel_id=1"]
    stored.save_postings_csv(post, str(tmp_path / "p"))
    stored.save_forward_csv(post, str(tmp_path / "f"))
    assert spark.read.csv(str(tmp_path / "p"), header=True).columns == ["word_id", "word", "doc_id", "frequency"]


def test_packed_files(spark, tmp_path):
    s = lambda t: struct.pack("<I", len(t)) + t.encode()
    (tmp_path / "f.bin").write_bytes(struct.pack("<IQII", 1, 3, 1, 1) + s("d1") + s("T") + s("") + struct.pack("<II", 3, 2) + struct.pack("<4I", 0, 2, 4, 1))
    assert [tuple(r) for r in stored.load_forward_binary(spark, str(tmp_path / "f.bin")).collect()] == [(0, "d1", "T", "", 3, 0, 2), (0, "d1", "T", "", 3, 4, 1)]
    record = struct.pack("<I", 7) + s("virus") + struct.pack("<I", 2) + struct.pack("<4I", 0, 2, 3, 1)
    (tmp_path / "i.bin").write_bytes(struct.pack("<I", 1) + record)
    (tmp_path / "b.bin").write_bytes(struct.pack("<4I", 0, 0, 9, 1) + record)
    for load, name in ((stored.load_inverted_binary, "i.bin"), (stored.load_barrel_binary, "b.bin")):
        assert [tuple(r) for r in load(spark, str(tmp_path / name)).collect()] == [(7, "virus", 0, 2), (7, "virus", 3, 1)]
