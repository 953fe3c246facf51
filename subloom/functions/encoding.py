"""Expressions over Encoding structs: building, templates, truncation, padding, decoding and alignment.

All of them are built-in expressions, so unused fields are pruned and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from subloom.config import DO_NOT_TRUNCATE, LEFT, LONGEST_FIRST, ONLY_FIRST, RIGHT, Padding, Part

FIELDS = {
    "tokens": "array<string>", "ids": "array<int>", "type_ids": "array<smallint>", "attention_mask": "array<tinyint>", "special_tokens_mask": "array<tinyint>",
    "offsets": "array<struct<start:int,end:int>>", "word_ids": "array<int>", "sequence_ids": "array<int>",
}
SCHEMA = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
CONTENT = "struct<tokens:array<string>,ids:array<int>,offsets:array<struct<start:int,end:int>>,word_ids:array<int>>"
C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _struct(of: Callable[[str], Column]) -> Column:
    return F.struct(*[of(k).cast(v).alias(k) for k, v in FIELDS.items()])


def _fill(value: object, n: Column, kind: str) -> Column:
    return F.array_repeat(F.lit(value).cast(kind), n)


def length(enc: C) -> Column:
    return F.size(_c(enc)["ids"])


def empty() -> Column:
    """The encoding without tokens."""
    return _struct(lambda k: F.array())


def single(token: str, id_: int, type_id: int = 0) -> Column:
    """The encoding of one inserted special token."""
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    value = {
        "tokens": F.lit(token), "ids": F.lit(id_), "type_ids": F.lit(type_id), "attention_mask": F.lit(1),
        "special_tokens_mask": F.lit(1), "offsets": span, "word_ids": F.lit(None).cast("int"),
        "sequence_ids": F.lit(None).cast("int"),
    }
    return _struct(lambda k: F.array(value[k]))


def of_content(content: C, type_id: int = 0, sequence: int = 0) -> Column:
    """The encoding of a kernel's content struct, without special tokens."""
    x = _c(content)
    n = F.size(x["ids"])
    value = {
        "type_ids": _fill(type_id, n, "smallint"), "attention_mask": _fill(1, n, "tinyint"),
        "special_tokens_mask": _fill(0, n, "tinyint"), "sequence_ids": _fill(sequence, n, "int"),
    }
    return _struct(lambda k: value[k] if k in value else x[k])


def concat(*parts: C) -> Column:
    """Encodings one after the other, spans and ids as they are."""
    return _struct(lambda k: F.concat(*[_c(p)[k] for p in parts]))


def from_template(template: tuple[Part, ...], ids: Callable[[str], int], first: C, second: C | None = None) -> Column:
    """The parts of a template, in order; first and second are content structs."""
    parts = [single(p.token, ids(p.token), p.type_id) if p.token is not None else of_content(first if p.sequence == "A" else second, p.type_id, 0 if p.sequence == "A" else 1) for p in template]
    if len(parts) == 1:  # its arrays go on as they are, without a copy
        return parts[0]
    return concat(*parts) if parts else empty()


def _cut_array(a: Column, n: Column, direction: str) -> Column:
    """n elements of a from its left (direction right: the right end is cut) or its right; all if it has fewer."""
    size = F.size(a)
    n = F.least(F.greatest(n, F.lit(0)), size)
    return F.slice(a, F.lit(1) if direction == RIGHT else size - n + 1, n)


def truncate(enc: C, max_length: int | Column, direction: str = RIGHT) -> Column:
    """A finished encoding (or a content) cut to max_length tokens; special tokens may go too."""
    x, n = _c(enc), max_length if isinstance(max_length, Column) else F.lit(max_length)
    return F.when(x.isNull() | (F.size(x["ids"]) <= n), x).otherwise(_struct(lambda k: _cut_array(x[k], n, direction)))


def truncate_content(content: C, n: Column, direction: str = RIGHT) -> Column:
    x = _c(content)
    return F.struct(*[_cut_array(x[k], n, direction).alias(k) for k in ("tokens", "ids", "offsets", "word_ids")])


def pair_lengths(a: Column, b: Column, max_length: int | Column, reserved: int, strategy: str) -> tuple[Column, Column]:
    """How many tokens of each sequence stay when max_length holds both and the reserved special tokens.

    longest_first in closed form: taking one token at a time from the longer (at a tie from the one that began
    no longer than the other, the first at equality) leaves the shorter side least(shorter, avail div 2).
    """
    limit = max_length if isinstance(max_length, Column) else F.lit(max_length)
    avail = limit - reserved
    fits = a + b <= avail
    if strategy == DO_NOT_TRUNCATE:
        na, nb = a, b
    elif strategy == LONGEST_FIRST:
        short = F.least(a, b, F.floor(avail / 2).cast("int"))
        na, nb = F.when(a <= b, short).otherwise(avail - short), F.when(a <= b, avail - short).otherwise(short)
    else:
        rest = avail - (b if strategy == ONLY_FIRST else a)
        bad = F.raise_error(F.lit("the sequence to truncate is too short for max_length")).cast("int")
        rest = F.when(rest <= 0, bad).otherwise(rest)
        na, nb = (rest, b) if strategy == ONLY_FIRST else (a, rest)
    keep = lambda x, n: F.when(avail <= 0, F.lit(0)).when(fits, x).otherwise(n).cast("int")
    return keep(a, na), keep(b, nb)


def truncate_pair(
    a: C, b: C, max_length: int | Column, reserved: int = 0, strategy: str = LONGEST_FIRST, direction: str = RIGHT,
) -> tuple[Column, Column]:
    """Both contents cut by pair_lengths."""
    a, b = _c(a), _c(b)
    na, nb = pair_lengths(F.size(a["ids"]), F.size(b["ids"]), max_length, reserved, strategy)
    return truncate_content(a, na, direction), truncate_content(b, nb, direction)


def pad(
    enc: C, target: int | Column, pad_id: int = 0, pad_token: str = "[PAD]", pad_type_id: int = 0,
    direction: str = RIGHT,
) -> Column:
    """Padded to target tokens; never shortened."""
    x = _c(enc)
    n = F.greatest((target if isinstance(target, Column) else F.lit(target)) - F.size(x["ids"]), F.lit(0)).cast("int")
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    fill = {
        "tokens": F.array_repeat(F.lit(pad_token), n), "ids": _fill(pad_id, n, "int"),
        "type_ids": _fill(pad_type_id, n, "smallint"), "attention_mask": _fill(0, n, "tinyint"),
        "special_tokens_mask": _fill(1, n, "tinyint"), "offsets": F.array_repeat(span, n),
        "word_ids": _fill(None, n, "int"), "sequence_ids": _fill(None, n, "int"),
    }
    return F.when(n == 0, x).otherwise(_struct(lambda k: F.concat(fill[k], x[k]) if direction == LEFT else F.concat(x[k], fill[k])))


def rounded(n: Column, multiple: int | None) -> Column:
    return n if not multiple else (F.ceil(n / multiple) * multiple).cast("int")


def pad_to_multiple(enc: C, multiple: int, **how) -> Column:
    """Padded to the next multiple; a multiple of 0 or less changes nothing."""
    return _c(enc) if multiple <= 0 else pad(enc, rounded(length(enc), multiple), **how)


def apply_padding(enc: C, p: Padding | None, pad_id: int, longest: Column | None = None) -> Column:
    """A configured padding: to its length, or to longest where that is given, then up to its multiple."""
    if p is None:
        return _c(enc)
    how = {
        "pad_id": pad_id if p.pad_id is None else p.pad_id, "pad_token": p.pad_token, "pad_type_id": p.pad_type_id,
        "direction": p.direction,
    }
    n = length(enc)
    base = F.greatest(n, F.lit(p.length)) if p.length is not None else F.greatest(n, longest) if longest is not None else n
    return pad(enc, rounded(base, p.multiple), **how)


# Alignment. Positions are code points; a missing answer is null.


def _indices(enc: Column, keep: Callable[[Column], Column]) -> Column:
    """The token numbers that keep accepts, in order."""
    n = F.size(enc["ids"])
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, keep)


def char_to_token(enc: C, pos: int | Column, sequence: int = 0, word: int | Column | None = None) -> Column:
    x, pos = _c(enc), pos if isinstance(pos, Column) else F.lit(pos)

    def keep(i: Column) -> Column:
        o = F.get(x["offsets"], i)
        ok = (F.get(x["sequence_ids"], i) == sequence) & (o["start"] <= pos) & (pos < o["end"])
        return ok if word is None else ok & (F.get(x["word_ids"], i) == word)

    return F.get(_indices(x, keep), F.lit(0))


def char_to_word(enc: C, pos: int | Column, sequence: int = 0, word: int | Column | None = None) -> Column:
    return F.get(_c(enc)["word_ids"], char_to_token(enc, pos, sequence, word))


def token_to_chars(enc: C, i: int | Column) -> Column:
    x, i = _c(enc), i if isinstance(i, Column) else F.lit(i)
    o = F.get(x["offsets"], i)
    return F.when((o["start"] == 0) & (o["end"] == 0) & (F.get(x["special_tokens_mask"], i) == 1), None).otherwise(o)


def token_to_word(enc: C, i: int | Column) -> Column:
    return F.get(_c(enc)["word_ids"], i if isinstance(i, Column) else F.lit(i))


def token_to_sequence(enc: C, i: int | Column) -> Column:
    return F.get(_c(enc)["sequence_ids"], i if isinstance(i, Column) else F.lit(i))


def _of_word(x: Column, word: int | Column, sequence: int) -> Column:
    return _indices(x, lambda i: (F.get(x["sequence_ids"], i) == sequence) & (F.get(x["word_ids"], i) == word))


def word_to_chars(enc: C, word: int | Column, sequence: int = 0) -> Column:
    x = _c(enc)
    spans = F.transform(_of_word(x, word, sequence), lambda i: F.get(x["offsets"], i))
    start, end = F.array_min(F.transform(spans, lambda o: o["start"])), F.array_max(F.transform(spans, lambda o: o["end"]))
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def word_to_tokens(enc: C, word: int | Column, sequence: int = 0) -> Column:
    at = _of_word(_c(enc), word, sequence)
    return F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("start"), (F.array_max(at) + 1).alias("end")))


def n_sequences(enc: C) -> Column:
    s = _c(enc)["sequence_ids"]
    has = lambda v: F.exists(s, lambda y: F.coalesce(y == v, F.lit(False)))
    return F.when(has(1), 2).when(has(0), 1).otherwise(0)


def with_sequence_ids(enc: C) -> Column:
    """sequence_ids derived from type ids where tokens aren't special, for encodings that lack them."""
    x = _c(enc)
    derived = F.zip_with(x["type_ids"], x["special_tokens_mask"], lambda t, s: F.when(s == 0, t.cast("int")))
    return _struct(lambda k: F.coalesce(x[k], derived) if k == "sequence_ids" else x[k])


def label_tokens(enc: C, labels: C, ignore: int = -100) -> Column:
    """A label per token: a word's label for its first token; ignore for its others and for special tokens."""
    x, labels = _c(enc), _c(labels)
    w = x["word_ids"]
    first = lambda v, i: v.isNotNull() & (F.coalesce(F.get(w, i - 1), F.lit(-1)) != v)
    return F.transform(w, lambda v, i: F.when(first(v, i), F.get(labels, v)).otherwise(F.lit(ignore)))


def to_json(enc: C) -> Column:
    return F.to_json(_c(enc), {"ignoreNullFields": "false"})


# Decoding


#: What clean-up shortens, in this order, within each token and the space before it.
CLEANUP = (
    (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"),
    (" 've", "'ve"), (" 're", "'re"),
)


def join_tokens(tokens: C, prefix: str | None, legacy: bool, cleanup: bool = False) -> Column:
    """Token spellings to text; prefix None joins with plain spaces.

    A continuation loses its prefix and joins the token before it (the very first only in legacy mode).
    """
    t = _c(tokens)
    if prefix is None:
        return F.array_join(t, " ")

    def one(x: Column, i: Column) -> Column:
        spaced = F.when(i > 0, F.concat(F.lit(" "), x)).otherwise(x)
        inner = F.startswith(x, F.lit(prefix)) & (F.lit(legacy) | (i > 0))
        out = F.when(inner, F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(spaced)
        for a, b in CLEANUP if cleanup else ():
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return F.array_join(F.transform(t, one), "")
