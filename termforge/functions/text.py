"""Text to words, as column functions. Everything works on ASCII letters and digits; other characters separate words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termforge.config import TextConfig

# The stop words. Those with an apostrophe never meet a word of the pipeline, in which it is a separator.
STOP_WORDS = tuple(
    """
a about above after again against all am an and any are aren't as at be because been before being below between both but by can't
cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having
he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself
let's me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she
she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd they'll
they're they've this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where
where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves
""".split()
)
PLAIN_STOP_WORDS = tuple(w for w in STOP_WORDS if "'" not in w)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r" \t\n\x0B\f\r"
_OTHER = rf"[^A-Za-z0-9{_SPACE}]+"


def to_lower_case(text: Column) -> Column:
    """A-Z lowered; other letters stay (``lower`` would turn some of them into ASCII letters)."""
    return F.translate(text, _UPPER, _LOWER)


def remove_special_chars(text: Column) -> Column:
    """Only ASCII letters, digits and white space stay; other runs become one space, none at the start or after a space."""
    return F.regexp_replace(F.regexp_replace(text, f"(^| ){_OTHER}", "$1"), _OTHER, " ")


def tokenize(text: Column) -> Column:
    """The words between runs of white space."""
    return F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")


def is_stop_word(word: Column) -> Column:
    """Exact, case-sensitive membership in the whole list."""
    return word.isin(*STOP_WORDS)


def remove_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~is_stop_word(w))


def is_number(word: Column) -> Column:
    """Only digits, points and commas, at least one."""
    return word.rlike(r"^[0-9.,]+\z")


def is_valid_word(word: Column, config: TextConfig = TextConfig()) -> Column:
    """Long enough, with a letter, and no number if those are removed."""
    valid = (F.length(word) >= config.min_word_length) & word.rlike("[A-Za-z]")
    return valid & ~is_number(word) if config.remove_numbers else valid


def raw_words(text: Column) -> Column:
    """The lowered words of a text before any is removed: its maximal runs of ASCII letters and digits."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def keeps(word: Column, config: TextConfig = TextConfig()) -> Column:
    """Whether a lowered raw word passes the stop list and, unstemmed, the validity rules."""
    kept = is_valid_word(word, config)
    return ~word.isin(*PLAIN_STOP_WORDS) & kept if config.remove_stop_words else kept


def preprocess(text: Column, config: TextConfig = TextConfig()) -> Column:
    """The words of a text in order, repeats kept: lower, clean, split, stop words, stems, validity."""
    words = raw_words(text)
    if config.use_stemming:
        from termforge.functions.stemmer import stem

        if config.remove_stop_words:
            words = F.filter(words, lambda w: ~w.isin(*PLAIN_STOP_WORDS))
        return F.filter(F.transform(words, stem), lambda w: is_valid_word(w, config))
    return F.filter(words, lambda w: keeps(w, config))
