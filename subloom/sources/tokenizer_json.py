"""tokenizer.json: validation and settings. Everything fails here, on the driver, never in a task."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from subloom.config import LEFT, LONGEST_FIRST, MAX_ID, ONLY_FIRST, ONLY_SECOND, RIGHT, AddedToken, Normalizer, Padding, Part, TokenizerFormatError, Truncation, WordPieceConfig

#: The component types that can be run; null is allowed for each.
SUPPORTED = {
    "normalizer": ("BertNormalizer",), "pre_tokenizer": ("BertPreTokenizer",),
    "post_processor": ("TemplateProcessing", "BertProcessing"), "decoder": ("WordPiece",),
}
_DIRECTION = {None: RIGHT, "Right": RIGHT, "Left": LEFT}
_STRATEGY = {"LongestFirst": LONGEST_FIRST, "OnlyFirst": ONLY_FIRST, "OnlySecond": ONLY_SECOND}
_FLAGS = ("single_word", "lstrip", "rstrip", "normalized", "special")


@dataclass(frozen=True)
class TokenizerJson:
    vocab: dict[str, int]
    config: WordPieceConfig
    normalizer: Normalizer
    unk_token: str
    added: tuple[AddedToken, ...]
    single: tuple[Part, ...] | None
    pair: tuple[Part, ...] | None
    decoder_prefix: str | None
    cleanup: bool
    has_decoder: bool
    padding: Padding | None = None
    truncation: Truncation | None = None
    raw: dict = field(default_factory=dict, compare=False, repr=False)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise TokenizerFormatError(what)


def _int(x: Any, low: int = 0, high: int = MAX_ID) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and low <= x <= high


def _object(parent: dict, key: str) -> dict | None:
    x = parent.get(key)
    _need(x is None or isinstance(x, dict), f"{key} must be an object or null")
    return x


def _flag(parent: dict, key: str, default: bool) -> bool:
    x = parent.get(key)
    _need(x is None or isinstance(x, bool), f"{key} must be a boolean")
    return default if x is None else x


def parse(text: str) -> TokenizerJson:
    """Settings of a tokenizer.json; TokenizerFormatError if any part of it can't be run exactly."""
    try:
        j = json.loads(text)
    except json.JSONDecodeError as e:
        raise TokenizerFormatError(f"not JSON: {e}") from e
    _need(isinstance(j, dict), "tokenizer.json must hold an object")
    for key, kinds in SUPPORTED.items():
        x = _object(j, key)
        _need(x is None or x.get("type") in kinds, f"unsupported {key}: {x}")
    vocab, config_bits, unk = _model(j)
    added = _added(j, vocab)
    _need(unk in vocab, f"unknown token {unk!r} is not in the vocabulary")
    single, pair = _templates(j.get("post_processor"), vocab)
    n = j.get("normalizer")
    lower = _flag(n, "lowercase", True) if n else False
    accents = n.get("strip_accents") if n else False
    _need(accents is None or isinstance(accents, bool), "strip_accents must be a boolean or null")
    normalizer = Normalizer(
        lower, lower if accents is None else accents, _flag(n, "handle_chinese_chars", True) if n else False,
        _flag(n, "clean_text", True) if n else False, j.get("pre_tokenizer") is not None,
    )
    names = {p.token for p in single or ()}
    config = WordPieceConfig(
        normalizer.lowercase, normalizer.strip_accents, normalizer.handle_chinese_chars, *config_bits, "[CLS]" in names,
        "[SEP]" in names,
    )
    d = j.get("decoder")
    prefix = d.get("prefix") if d else None
    _need(prefix is None or isinstance(prefix, str), "decoder prefix must be a string")
    return TokenizerJson(
        vocab, config, normalizer, unk, added, single, pair, prefix, bool(d and _flag(d, "cleanup", False)),
        d is not None, _padding(j), _truncation(j), j,
    )


def _model(j: dict) -> tuple[dict[str, int], tuple[str, int], str]:
    m = j.get("model")
    _need(isinstance(m, dict), "model must be an object")
    _need(m.get("type") in (None, "WordPiece"), f"unsupported model: {m.get('type')}")
    vocab = m.get("vocab")
    _need(isinstance(vocab, dict), "model.vocab must be an object")
    for token, id_ in vocab.items():
        _need(_int(id_), f"bad id of {token!r}: {id_}")
    _need(len(set(vocab.values())) == len(vocab), "two tokens share an id")
    prefix, unk, longest = m.get("continuing_subword_prefix"), m.get("unk_token"), m.get("max_input_chars_per_word")
    _need(all(x is None or isinstance(x, str) for x in (prefix, unk)), "prefix and unk_token are strings")
    _need(longest is None or _int(longest, 1), "max_input_chars_per_word must be a positive integer")
    return dict(vocab), ("##" if prefix is None else prefix, 100 if longest is None else longest), "[UNK]" if unk is None else unk


def _added(j: dict, vocab: dict[str, int]) -> tuple[AddedToken, ...]:
    """The added tokens; those the vocabulary lacks get the next id above all others, whatever id they name."""
    entries = j.get("added_tokens")
    _need(entries is None or isinstance(entries, list), "added_tokens must be a list")
    out = []
    for t in entries or ():
        _need(
            isinstance(t, dict) and isinstance(t.get("content"), str) and t["content"] != "" and _int(t.get("id"), 0, 1 << 62),
            f"bad added token: {t}",
        )
        _need(all(isinstance(t[f], bool) for f in _FLAGS if f in t), f"flags of {t['content']!r} must be booleans")
        out.append(AddedToken(t["content"], **{f: t[f] for f in _FLAGS if f in t}))
        if t["content"] not in vocab:
            vocab[t["content"]] = max(vocab.values(), default=-1) + 1
            _need(vocab[t["content"]] <= MAX_ID, "no id left for an added token")
    return tuple(out)


def _templates(p: dict | None, vocab: dict[str, int]) -> tuple[tuple[Part, ...] | None, tuple[Part, ...] | None]:
    """Templates for one and two sequences; without a processor there are no special tokens, and B has type 1."""
    a = Part(0, sequence="A")
    if p is None:
        return (a,), (a, Part(1, sequence="B"))
    if p["type"] == "BertProcessing":
        for key in ("cls", "sep"):
            x = p.get(key)
            _need(
                isinstance(x, list) and len(x) == 2 and isinstance(x[0], str) and x[0] in vocab and x[1] == vocab[x[0]],
                f"bad BertProcessing.{key}",
            )
        cls, sep = p["cls"][0], p["sep"][0]
        one = (Part(0, token=cls), a, Part(0, token=sep))
        return one, (*one, Part(1, sequence="B"), Part(1, token=sep))
    single = _template(p, "single", vocab)
    return single, None if p.get("pair") is None else _template(p, "pair", vocab)


def _template(p: dict, key: str, vocab: dict[str, int]) -> tuple[Part, ...]:
    entries, parts = p.get(key), []
    _need(isinstance(entries, list), f"{key} must be a list")
    known = p.get("special_tokens")
    _need(known is None or isinstance(known, dict), "special_tokens must be an object")
    for e in entries:
        _need(isinstance(e, dict) and len(e) == 1, "a template entry has one key")
        ((kind, x),) = e.items()
        _need(
            kind in ("Sequence", "SpecialToken") and isinstance(x, dict) and _int(x.get("type_id"), 0, 255),
            f"bad template entry: {e}",
        )
        name = x.get("id")
        if kind == "Sequence":
            _need(
                name in (("A",) if key == "single" else ("A", "B")) and all(q.sequence != name for q in parts),
                "each sequence stands once in its template",
            )
            parts.append(Part(x["type_id"], sequence=name))
            continue
        _need(isinstance(name, str) and name in vocab, f"template token {name!r} is not in the vocabulary")
        meaning = (known or {}).get(name)
        _need(
            meaning is None or isinstance(meaning, dict) and meaning.get("ids") == [vocab[name]] and meaning.get("tokens") == [name],
            f"template token {name!r} must stand for itself",
        )
        parts.append(Part(x["type_id"], token=name))
    _need(
        {q.sequence for q in parts} >= ({"A"} if key == "single" else {"A", "B"}),
        "a sequence is missing in the template",
    )
    return tuple(parts)


def _one_of(x: object, known: dict) -> bool:
    return (x is None or isinstance(x, str)) and x in known


def _truncation(j: dict) -> Truncation | None:
    t = _object(j, "truncation")
    if t is None:
        return None
    _need((t.get("stride") or 0) == 0, "truncation with a stride is not supported")
    _need(
        _int(t.get("max_length"), 0, 1 << 62) and _one_of(t.get("direction"), _DIRECTION) and _one_of(t.get("strategy"), _STRATEGY),
        "bad truncation",
    )
    return Truncation(t["max_length"], _DIRECTION[t.get("direction")], _STRATEGY[t["strategy"]])


def _padding(j: dict) -> Padding | None:
    p = _object(j, "padding")
    if p is None:
        return None
    s = p.get("strategy")
    fixed = isinstance(s, dict) and len(s) == 1 and _int(s.get("Fixed"), 0, 1 << 62)
    _need(s == "BatchLongest" or fixed, "unsupported padding strategy")
    multiple = p.get("pad_to_multiple_of")
    _need(
        _one_of(p.get("direction"), _DIRECTION) and _int(p.get("pad_id")) and isinstance(p.get("pad_token"), str) and _int(p.get("pad_type_id"), 0, 255) and (multiple is None or _int(multiple, 1, 1 << 62)),
        "bad padding",
    )
    return Padding(
        s["Fixed"] if fixed else None, multiple, _DIRECTION[p.get("direction")], p["pad_id"], p["pad_token"],
        p["pad_type_id"],
    )
