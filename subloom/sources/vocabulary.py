"""Vocabularies: loaders, lookups, prefix search and a DataFrame view."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from subloom.config import CLS, DEFAULT_IDS, MASK, MAX_ID, PAD, SEP, UNK


class PrefixSet:
    """Tokens by spelling: exact lookup and all or the longest of those that begin at a place. Empty tokens never match."""

    def __init__(self, items: Mapping[str, int] | None = None):
        self._ids: dict[str, int] = {}
        self.clear()
        for token, id_ in (items or {}).items():
            self.insert(token, id_)

    def insert(self, token: str, id_: int) -> None:
        self._ids[token] = id_
        self._longest = max(self._longest, len(token))
        known = self._lengths.get(token[:1], ())
        if token and len(token) not in known:
            self._lengths[token[0]] = tuple(sorted((*known, len(token)), reverse=True))

    def lookup(self, token: str) -> int | None:
        return self._ids.get(token)

    def __contains__(self, token: str) -> bool:
        return token in self._ids

    def __len__(self) -> int:
        return len(self._ids)

    def __iter__(self):
        return iter(self._ids)

    def clear(self) -> None:
        self._ids.clear()
        self._longest = 0
        self._lengths: dict[str, tuple[int, ...]] = {}  # first character -> lengths of its tokens, longest first

    def all_prefixes(self, text: str, start: int = 0) -> list[tuple[str, int, int]]:
        """(token, id, end) of every token beginning at start, shortest first."""
        found = []
        for end in range(start + 1, min(len(text), start + self._longest) + 1):
            if (id_ := self._ids.get(text[start:end])) is not None:
                found.append((text[start:end], id_, end))
        return found

    def longest_prefix(self, text: str, start: int = 0) -> tuple[str, int, int] | None:
        for n in self._lengths.get(text[start : start + 1], ()):
            piece = text[start : start + n]  # at the end of text: all that is left
            if (id_ := self._ids.get(piece)) is not None:
                return piece, id_, start + len(piece)
        return None


class Vocabulary:
    """token <-> id. size is the largest id + 1. Words and continuations (prefix removed) are kept apart for matching.

    Tokens like [this] from a list of lines can't be pieces of words; from a mapping they can.
    """

    def __init__(self, pairs: Iterable[tuple[str, int]], prefix: str = "##", bracketed: bool = True):
        self.prefix, self.ids, self.names = prefix, {}, {}
        self.words, self.continuations = PrefixSet(), PrefixSet()
        for token, id_ in pairs:
            if not isinstance(id_, int) or not 0 <= id_ <= MAX_ID:
                raise ValueError(f"id of {token!r} is not in 0..{MAX_ID}: {id_}")
            self.ids[token], self.names[id_] = id_, token
            if token.startswith(prefix):
                self.continuations.insert(token[len(prefix) :], id_)
            elif bracketed or not bracket_shaped(token):
                self.words.insert(token, id_)
        self.size = max(self.names, default=-1) + 1

    @classmethod
    def from_lines(cls, lines: Iterable[str], prefix: str = "##") -> Vocabulary:
        """The 0-based line number is the id. Lines are trimmed; blank ones use up their number; the last of equal tokens wins."""
        return cls(((t, i) for i, line in enumerate(lines) if (t := line.strip())), prefix, bracketed=False)

    from_tokens = from_lines

    @classmethod
    def from_string(cls, content: str, prefix: str = "##") -> Vocabulary:
        return cls.from_lines(content.split("\n"), prefix)

    @classmethod
    def from_file(cls, path: str, spark: SparkSession | None = None, prefix: str = "##") -> Vocabulary:
        """One token a line. With a session the file may lie wherever Spark reads; a vocabulary fits the driver."""
        if spark is None:
            with open(path, encoding="utf-8") as f:
                return cls.from_string(f.read(), prefix)
        return cls.from_string(whole_file(spark, path), prefix)

    @classmethod
    def from_map(cls, ids: Mapping[str, int], prefix: str = "##") -> Vocabulary:
        return cls(ids.items(), prefix)

    def with_added(self, added: Mapping[str, int]) -> Vocabulary:
        """The same words and continuations, with more names: added tokens are never pieces of words."""
        new = object.__new__(Vocabulary)
        new.prefix, new.words, new.continuations = self.prefix, self.words, self.continuations
        new.ids, new.names = {**self.ids, **added}, {**self.names, **{i: t for t, i in added.items()}}
        new.size = max(new.names, default=-1) + 1
        return new

    def token_to_id(self, token: str) -> int:
        return self.ids.get(token, self.special_id(UNK))

    def id_to_token(self, id_: int) -> str:
        return self.names.get(id_, UNK)

    def special_id(self, token: str) -> int:
        return self.ids.get(token, DEFAULT_IDS[token])

    unk_id = property(lambda self: self.special_id(UNK))
    cls_id = property(lambda self: self.special_id(CLS))
    sep_id = property(lambda self: self.special_id(SEP))
    pad_id = property(lambda self: self.special_id(PAD))
    mask_id = property(lambda self: self.special_id(MASK))

    def __contains__(self, token: str) -> bool:
        return token in self.ids

    def __len__(self) -> int:
        return self.size

    def longest_match(self, text: str, start: int = 0, continuation: bool = False) -> tuple[str, int, int] | None:
        return (self.continuations if continuation else self.words).longest_prefix(text, start)

    @property
    def tokens(self) -> list[str]:
        """All names by id, holes as empty strings."""
        return [self.names.get(i, "") for i in range(self.size)]

    def dataframe(self, spark: SparkSession) -> DataFrame:
        """(token, id, piece, is_continuation): one row a token that can be matched or named."""
        rows = [(t, i, t[len(self.prefix) :] if t.startswith(self.prefix) else t, t.startswith(self.prefix)) for t, i in self.ids.items()]
        return spark.createDataFrame(rows, "token string, id int, piece string, is_continuation boolean")

    def __repr__(self) -> str:
        return f"Vocabulary(size: {self.size}, prefix: {self.prefix!r})"


def whole_file(spark: SparkSession, path: str) -> str:
    """The text of the one file at a path that Spark reads; a folder must hold a single file."""
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} must be one file")
    return found[0][0]


def bracket_shaped(token: str) -> bool:
    return token.startswith("[") and token.endswith("]")
