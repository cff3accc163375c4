"""Settings of the text rules and of the index."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TextConfig:
    """How text becomes words. ``remove_numbers`` has no effect of its own: a valid word has a letter in any case."""

    remove_stop_words: bool = True
    use_stemming: bool = False
    min_word_length: int = 2
    remove_numbers: bool = True

    def __post_init__(self):
        if self.min_word_length < 0:
            raise ValueError("min_word_length must not be negative")


@dataclass(frozen=True)
class IndexConfig:
    """``max_docs`` keeps the first papers in order (None: all); ``num_barrels`` shards the vocabulary by id range."""

    text: TextConfig = TextConfig()
    max_docs: int | None = None
    num_barrels: int = 4

    def __post_init__(self):
        if self.num_barrels < 1:
            raise ValueError("num_barrels must be 1 or more")
        if self.max_docs is not None and self.max_docs < 0:
            raise ValueError("max_docs must not be negative")
