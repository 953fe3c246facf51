"""Character classes and mappings, all derived from rules of the Unicode database."""

from __future__ import annotations

import functools
import unicodedata

import regex

#: The White_Space property.
WHITE_SPACE = frozenset([
    *range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
])
#: The blocks spaced out as Chinese characters.
CJK = (
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF),
    (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
)
_WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍]")


def is_cjk(c: str) -> bool:
    return c >= "\u3400" and any(a <= ord(c) <= b for a, b in CJK)


def is_punctuation(c: str) -> bool:
    o = ord(c)
    return 33 <= o <= 47 or 58 <= o <= 64 or 91 <= o <= 96 or 123 <= o <= 126 or unicodedata.category(c)[0] == "P"


def is_white(c: str) -> bool:
    return ord(c) in WHITE_SPACE


def is_word(c: str) -> bool:
    """A character that a single-word token must not touch: alphabetic, mark, digit, connector or joiner.

    As far as Python's Unicode assigns it: the pattern's tables may be of a later version.
    """
    return _WORD.match(c) is not None and unicodedata.category(c) != "Cn"


@functools.lru_cache(maxsize=1 << 16)
def without_accents(c: str) -> str:
    """The canonical decomposition without nonspacing marks; Hangul falls into jamo, a bare mark into nothing."""
    if c < "\x80":
        return c
    return "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")


def cleaned(c: str) -> str | None:
    """clean_text for one character: a space for white space, None for what is dropped, else itself."""
    if c in " \t\n\r" or unicodedata.category(c) == "Zs":
        return " "
    return None if c in "\0�" or unicodedata.category(c) in ("Cc", "Cf") else c
