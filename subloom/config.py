"""Immutable settings of a tokenizer."""

from __future__ import annotations

from dataclasses import dataclass

MAX_ID = 0x7FFFFFFF
UNK, PAD, CLS, SEP, MASK = "[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]"
SPECIALS = (PAD, UNK, CLS, SEP, MASK)
#: Ids of special tokens that a vocabulary lacks.
DEFAULT_IDS = {PAD: 0, UNK: 100, CLS: 101, SEP: 102, MASK: 103}
RIGHT, LEFT = "right", "left"
LONGEST_FIRST, ONLY_FIRST, ONLY_SECOND, DO_NOT_TRUNCATE = "longest_first", "only_first", "only_second", "do_not_truncate"
STRATEGIES = (LONGEST_FIRST, ONLY_FIRST, ONLY_SECOND, DO_NOT_TRUNCATE)


class TokenizerFormatError(ValueError):
    """A tokenizer.json that can't be used."""


@dataclass(frozen=True)
class AddedToken:
    """A token matched in the text as a whole; normalized defaults to not special."""

    content: str
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool | None = None
    special: bool = False

    def __post_init__(self):
        if self.normalized is None:
            object.__setattr__(self, "normalized", not self.special)


@dataclass(frozen=True)
class WordPieceConfig:
    lowercase: bool = True
    strip_accents: bool = True
    handle_chinese_chars: bool = True
    subword_prefix: str = "##"
    max_word_length: int = 200
    add_cls: bool = True
    add_sep: bool = True


@dataclass(frozen=True)
class Normalizer:
    """What happens to a text before and while it is split; split=False leaves a segment as one word."""

    lowercase: bool = True
    strip_accents: bool = True
    handle_chinese_chars: bool = True
    clean_text: bool = True
    split: bool = True


@dataclass(frozen=True)
class Padding:
    length: int | None = None
    multiple: int | None = None
    direction: str = RIGHT
    pad_id: int | None = None
    pad_token: str = PAD
    pad_type_id: int = 0

    def __post_init__(self):
        if self.length is not None and self.length < 0:
            raise ValueError("padding length is negative")
        if self.multiple is not None and self.multiple <= 0:
            raise ValueError("padding multiple must be positive")
        if self.direction not in (RIGHT, LEFT):
            raise ValueError("padding direction is left or right")


@dataclass(frozen=True)
class Truncation:
    max_length: int
    direction: str = RIGHT
    strategy: str = LONGEST_FIRST

    def __post_init__(self):
        if self.max_length < 0:
            raise ValueError("max_length is negative")
        if self.direction not in (RIGHT, LEFT) or self.strategy not in STRATEGIES:
            raise ValueError("unknown truncation direction or strategy")


@dataclass(frozen=True)
class Part:
    """One entry of a template: a sequence ("A" or "B") or a special token, with its type id."""

    type_id: int
    sequence: str | None = None
    token: str | None = None
