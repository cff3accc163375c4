"""A suffix stemmer in column expressions.

It follows Porter's steps with a short list in step 2 and, in step 4, suffixes tried in list order, where one whose
measure fails lets the next be tried. Words of up to 2 characters stay. Digits count as consonants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffix and replacement, in the order in which they are tried.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def letter_kinds(word: Column) -> Column:
    """A string of c and v: consonant or vowel; y is a vowel after a consonant."""

    def add(kinds: Column, c: Column) -> Column:
        vowel = c.isin("a", "e", "i", "o", "u") | ((c == "y") & kinds.endswith("c"))
        return F.concat(kinds, F.when(vowel, "v").otherwise("c"))

    return F.aggregate(F.split(word, ""), F.lit(""), add)


def _cut(word: Column, n: int) -> Column:
    """The word without its last ``n`` characters."""
    return F.substring(word, F.lit(1), F.length(word) - n)


def _measure(kinds: Column) -> Column:
    return F.regexp_count(kinds, F.lit("v+c+"))


def _double(word: Column, kinds: Column) -> Column:
    return (F.length(word) >= 2) & (F.substring(word, -1, 1) == F.substring(word, -2, 1)) & kinds.endswith("c")


def _short(word: Column, kinds: Column) -> Column:
    return kinds.endswith("cvc") & ~word.rlike(r"[wxy]\z")


def _first(word: Column, choices: list[tuple[Column, Column]]) -> Column:
    """The value of the first choice whose condition holds, else the word."""
    out = None
    for condition, value in choices:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(word)


def _rules(word: Column, kinds: Column, rules, least: int) -> Column:
    """Replace the first suffix that is there and whose stem has a measure over ``least``."""
    return _first(word, [(word.endswith(s) & (_measure(_cut(kinds, len(s))) > least), F.concat(_cut(word, len(s)), F.lit(r))) for s, r in rules])


def _step_1a(w: Column, k: Column) -> Column:
    return _first(w, [(w.endswith("sses"), _cut(w, 2)), (w.endswith("ies"), _cut(w, 2)), (w.endswith("ss"), w), (w.endswith("s"), _cut(w, 1))])


def _step_1b(w: Column, k: Column) -> Column:
    """Marks a stem that lost ed or ing with a trailing space, for the step that mends it."""
    vowel = lambda n: _cut(k, n).contains("v")
    eed = F.when(_measure(_cut(k, 3)) > 0, _cut(w, 1)).otherwise(w)
    return _first(w, [(w.endswith("eed"), eed), (w.endswith("ed") & vowel(2), F.concat(_cut(w, 2), F.lit(" "))), (w.endswith("ing") & vowel(3), F.concat(_cut(w, 3), F.lit(" ")))])


def _mend(w: Column, k: Column) -> Column:
    """After _step_1b: restore an e or undouble; ``k`` has a last letter for the mark."""
    stem, kinds = _cut(w, 1), _cut(k, 1)
    e = F.concat(stem, F.lit("e"))
    undouble = _double(stem, kinds) & ~stem.rlike(r"[lsz]\z")
    mended = _first(stem, [(stem.endswith("at") | stem.endswith("bl") | stem.endswith("iz"), e), (undouble, _cut(stem, 1)), ((_measure(kinds) == 1) & _short(stem, kinds), e)])
    return F.when(w.endswith(" "), mended).otherwise(w)


def _step_1c(w: Column, k: Column) -> Column:
    return F.when(w.endswith("y") & _cut(k, 1).contains("v"), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _step_4(w: Column, k: Column) -> Column:
    fits = lambda s: w.endswith(s) & (_measure(_cut(k, len(s))) > 1) & ((F.lit(s) != "ion") | w.rlike(r"(^|[st])ion\z"))
    return _first(w, [(fits(s), _cut(w, len(s))) for s in STEP_4])


def _step_5a(w: Column, k: Column) -> Column:
    stem, kinds = _cut(w, 1), _cut(k, 1)
    return F.when(w.endswith("e") & ((_measure(kinds) > 1) | ((_measure(kinds) == 1) & ~_short(stem, kinds))), stem).otherwise(w)


def _step_5b(w: Column, k: Column) -> Column:
    return F.when((_measure(k) > 1) & _double(w, k) & w.endswith("l"), _cut(w, 1)).otherwise(w)


STEPS = (
    _step_1a, _step_1b, _mend, _step_1c, lambda w, k: _rules(w, k, STEP_2, 0), lambda w, k: _rules(w, k, STEP_3, 0), _step_4, _step_5a, _step_5b,
)


def stemmed(words: DataFrame, word: str = "word", out: str = "stem") -> DataFrame:
    """``words`` with the stem of column ``word``: one projection per step, best over distinct words."""
    df = words.withColumn(out, F.col(word))
    for step in STEPS:
        df = df.withColumn("_kinds", letter_kinds(F.col(out))).withColumn(out, step(F.col(out), F.col("_kinds")))
    return df.withColumn(out, F.when(F.length(word) <= 2, F.col(word)).otherwise(F.col(out))).drop("_kinds")


def stem(word: Column) -> Column:
    """The stem of a single column, for use inside array functions; a one-element array carries each step's result."""
    state = F.array(word)
    for step in STEPS:
        pair = F.transform(state, lambda w: F.struct(w.alias("w"), letter_kinds(w).alias("k")))
        state = F.transform(pair, _applied(step))
    return F.when(F.length(word) <= 2, word).otherwise(state[0])


def _applied(step):
    return lambda p: step(p["w"], p["k"])
