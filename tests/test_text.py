import random
import re

from pyspark.sql import functions as F

from termforge.config import IndexConfig, TextConfig
from termforge.functions import stemmer, text

ALPHABET = ["a", "B", "z", "İ", "K", "é", " ", "\t", "\n", "\x0b", "\x0c", "\r", "-", "'", "3", ".", ",", "the", "Aren't"]


def model_clean(t):
    out = ""
    for c in t:
        if c.isascii() and (c.isalnum() or c in " \t\n\x0b\x0c\r"):
            out += c
        elif out and out[-1] != " ":
            out += " "
    return out


def model_words(t):
    lowered = "".join(c.lower() if c.isascii() else c for c in t)
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", model_clean(lowered)) if w]
    return [w for w in words if w not in text.STOP_WORDS and len(w) >= 2 and re.search("[a-z]", w)]


def test_stop_words():
    assert len(text.STOP_WORDS) == len(set(text.STOP_WORDS)) == 174
    assert len(text.PLAIN_STOP_WORDS) == 124


def test_clean_and_words_follow_the_model(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(14))),) for _ in range(1500)]
    rows += [("-a--b",), ("a- b",), (" -a",), ("é",), ("aé",), ("COVID-19 p12823 3.14",), ("İx9",), ("the a I",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", text.remove_special_chars(F.col("t")).alias("c"), text.preprocess(F.col("t")).alias("w")).collect()
    for r in got:
        assert r["c"] == model_clean(r["t"])
        assert r["w"] == model_words(r["t"])


def test_single_functions(spark):
    df = spark.createDataFrame([("aren't", "3.14", "Kelvin K"), ("virus", "3a", "ÀB")], "w string, n string, t string")
    r = df.select(text.is_stop_word(F.col("w")), text.is_number(F.col("n")), text.to_lower_case(F.col("t")), text.tokenize(F.lit(" a  b\n")), text.remove_stop_words(F.array(F.lit("the"), F.col("w")))).collect()
    assert [tuple(x) for x in r] == [(True, True, "kelvin K", ["a", "b"], []), (False, False, "Àb", ["a", "b"], ["virus"])]


STEMS = """caresses caress ponies poni ties ti cats cat agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop falling fall filing file happy happi sky sky relational relat conditional condit valenci valenc digitizer digit
radicalli radic vietnamization vietnamizat predication predicat operator operator feudalism feudal decisiveness decis hopefulness hopeful
callousness callous formaliti formal sensitiviti sensitiv sensibiliti sensibil triplicate triplic formative form electriciti electr goodness good
revival reviv adoption adopt element elem probate probat controll control roll roll viruses virus infections infect cells cell proteins protein
patients patient studies studi yes ye ies i is is""".split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    df = spark.createDataFrame(pairs, "word string, expected string")
    for r in stemmer.stemmed(df).collect():
        assert r["stem"] == r["expected"], r
    for r in df.select("word", "expected", stemmer.stem(F.col("word")).alias("stem")).collect():
        assert r["stem"] == r["expected"], r


def test_stemming_comes_between_stop_words_and_validity(spark):
    df = spark.createDataFrame([("the ies viruses cats",)], "t string")
    assert df.select(text.preprocess(F.col("t"), TextConfig(use_stemming=True))).first()[0] == ["virus", "cat"]


def test_settings_are_checked():
    for make in (lambda: TextConfig(min_word_length=-1), lambda: IndexConfig(num_barrels=0), lambda: IndexConfig(max_docs=-1)):
        try:
            make()
        except ValueError:
            continue
        raise AssertionError


def test_the_plan_of_a_stemmed_index_stays_small(spark):
    from termforge.operators import lexicon, terms

    papers = spark.createDataFrame([(0, "p", "viruses and cats")], "doc_ord long, paper_id string, body_text string")
    plan = lexicon.build(terms.doc_terms(papers, TextConfig(use_stemming=True)))
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    assert sorted(r["word"] for r in plan.collect()) == ["cat", "virus"]


def test_orders_that_do_not_fit_are_refused(spark):
    import pytest

    from termforge.operators import terms

    papers = spark.createDataFrame([(1 << 31, "p", "viruses")], "doc_ord long, paper_id string, body_text string")
    with pytest.raises(Exception, match="doc_ord must be from 0"):
        terms.doc_terms(papers).collect()
