"""Normalization and splitting as built-in expressions, for queries that need the text and not its alignment.

Same results as the kernel outside the few code points on which Java's and Python's Unicode versions differ.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from subloom.unicode import CJK, WHITE_SPACE, without_accents

_WHITE = "".join(f"\\x{{{c:x}}}" for c in sorted(WHITE_SPACE))
_PUNCT = r"\p{P}$+<=>^`|~"
PIECES = f"[{_PUNCT}]|[^{_PUNCT}{_WHITE}]+"
_CJK = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in CJK)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) where f names its argument more than once: x is worked out a single time."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def clean_text(text: Column | str) -> Column:
    """Control and format characters dropped, each white space character a space."""
    dropped = F.regexp_replace(_c(text), r"[\x00\x{fffd}\p{Cc}\p{Cf}&&[^ \t\n\r]]", "")
    return F.regexp_replace(dropped, r"[\t\n\r\p{Zs}&&[^ ]]", " ")  # spaces, the most of them, stay as they are


def space_cjk(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), f"([{_CJK}])", " $1 ")


def _accents(limit: int = 0x250) -> tuple[str, str]:
    """Letters below limit that lose an accent, and what they become: a table from the decomposition rule."""
    pairs = [(c, d) for c in map(chr, range(0x80, limit)) if (d := without_accents(c)) != c and len(d) == 1]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def strip_accents(text: Column | str) -> Column:
    """Latin letters (below U+0250) without accents and combining marks U+0300-U+036F dropped; use the kernel beyond them."""
    marks = "".join(f"\\x{{{c:x}}}" for c in range(0x300, 0x370) if unicodedata.category(chr(c)) == "Mn")
    a, b = _accents()
    plain = r"^\p{ASCII}*+$"  # such texts need no look at each character
    return _once(
        _c(text),
        lambda t: F.when(F.regexp_like(t, F.lit(plain)), t).otherwise(F.translate(F.regexp_replace(t, f"[{marks}]", ""), a, b)),
    )


def lowercase(text: Column | str) -> Column:
    """Each character in lower case on its own. Only sigma depends on its neighbours, so only texts with one are taken apart."""
    apart = lambda t: F.array_join(F.transform(F.split(t, ""), F.lower), "")
    return _once(_c(text), lambda t: F.when(F.contains(t, F.lit("Σ")), apart(t)).otherwise(F.lower(t)))


def normalize(
    text: Column | str, lower: bool = True, accents: bool = True, cjk: bool = True, clean: bool = True,
) -> Column:
    out = _c(text)
    for on, f in ((clean, clean_text), (cjk, space_cjk), (accents, strip_accents), (lower, lowercase)):
        out = f(out) if on else out
    return out


def pieces(text: Column | str) -> Column:
    """Words and single punctuation characters of a normalized text."""
    return F.regexp_extract_all(_c(text), F.lit(PIECES), F.lit(0))
