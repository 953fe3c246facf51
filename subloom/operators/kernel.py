"""Text to content arrays: added tokens, normalization with alignment, splitting and WordPiece. No Spark in here.

A content is (tokens, ids, starts, ends, word_ids): five parallel lists with code-point spans of the original text.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

from subloom import unicode as u
from subloom.config import MAX_ID, AddedToken, Normalizer
from subloom.sources.vocabulary import Vocabulary

Content = tuple[list[str], list[int], list[int], list[int], list[int]]


class _Mapped(dict):
    """Character -> what it is normalized to, possibly nothing; normalization looks at one character at a time."""

    def __init__(self, n: Normalizer):
        super().__init__()
        self.n = n

    def __missing__(self, c: str) -> str:
        n, new = self.n, c
        if n.clean_text:
            new = u.cleaned(c)
        if new is None:
            new = ""
        else:
            spaced = n.handle_chinese_chars and u.is_cjk(new)
            if n.strip_accents:
                new = u.without_accents(new)
            if n.lowercase:
                new = "".join(x.lower() for x in new)
            if spaced:
                new = f" {new} "
        self[c] = new
        return new


_mapped = functools.cache(_Mapped)


class _Kinds(dict):
    """Character -> 0 white space, 1 punctuation, 2 anything else."""

    def __missing__(self, c: str) -> int:
        self[c] = kind = 0 if u.is_white(c) else 1 if u.is_punctuation(c) else 2
        return kind


_KINDS = _Kinds()


def normalize(text: str, n: Normalizer) -> tuple[str, list[int]]:
    """The normalized text, and for each of its characters which character of text it came from."""
    out = list(map(_mapped(n).__getitem__, text))
    done = "".join(out)
    if len(done) == len(text) and all(map(len, out)):
        return done, list(range(len(text)))
    return done, [i for i, x in enumerate(out) for _ in x]


def split(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the words: white space separates and vanishes, each punctuation character stands alone."""
    start = -1
    for i, kind in enumerate(map(_KINDS.__getitem__, text)):
        if kind == 2:
            if start < 0:
                start = i
            continue
        if start >= 0:
            yield start, i
            start = -1
        if kind:
            yield i, i + 1
    if start >= 0:
        yield start, len(text)


class Added:
    """An immutable set of registered added tokens over a vocabulary."""

    def __init__(self, vocab: Vocabulary, normalizer: Normalizer, tokens: dict[int, AddedToken] | None = None):
        self.vocab, self.normalizer, self.tokens = vocab, normalizer, tokens or {}
        self.special_ids = frozenset(i for i, t in self.tokens.items() if t.special)
        raw = {t.content: i for i, t in sorted(self.tokens.items(), reverse=True) if not t.normalized}
        self.spelled = {i: normalize(t.content, normalizer)[0] if t.normalized else t.content for i, t in self.tokens.items()}
        cooked = {self.spelled[i]: i for i, t in sorted(self.tokens.items(), reverse=True) if t.normalized and self.spelled[i]}  # the lowest id wins
        self.raw, self.cooked = (raw, _alternation(raw)), (cooked, _alternation(cooked))

    def register(self, new: Iterable[AddedToken]) -> tuple[Added, int]:
        """A new set with more tokens, and how many definitions are new or changed. All or nothing.

        A token gets its id in the vocabulary, or the next above all. Empty ones are ignored; special ones stay special.
        """
        tokens, names, size, count = dict(self.tokens), {}, self.vocab.size, 0
        for t in new:
            if not t.content:
                continue
            id_ = self.vocab.ids.get(t.content, names.get(t.content))
            if id_ is None:
                id_, size = size, size + 1
                if id_ > MAX_ID:
                    raise ValueError("no id left for an added token")
                names[t.content] = id_
            old = tokens.get(id_)
            if old == t:
                continue
            count += 1
            if old is not None and old.special and not t.special:
                t = AddedToken(t.content, t.single_word, t.lstrip, t.rstrip, t.normalized, True)
            tokens[id_] = t
        return Added(self.vocab.with_added(names) if names else self.vocab, self.normalizer, tokens), count

    def matches(
        self, text: str, found: tuple[dict[str, int], re.Pattern | None],
    ) -> Iterator[tuple[int, int, int | None]]:
        """(start, end, id) pieces that cover text; id is None between matches. Leftmost, longest first; a rejected match
        is not tried shorter. Stripping tokens take the white space beside them, but not what is already taken."""
        ids, pattern = found
        done = 0
        for m in pattern.finditer(text) if pattern is not None else ():
            start, end = m.span()
            id_ = ids[m[0]]
            t = self.tokens[id_]
            if t.single_word and ((start and u.is_word(text[start - 1])) or (end < len(text) and u.is_word(text[end]))):
                continue
            if t.lstrip:
                while start > done and u.is_white(text[start - 1]):
                    start -= 1
                start = max(start, done)  # what was taken before stays taken
            if t.rstrip:
                while end < len(text) and u.is_white(text[end]):
                    end += 1
            if start >= end:
                continue
            if done < start:
                yield done, start, None
            yield start, end, id_
            done = end
        if done < len(text):
            yield done, len(text), None


def _alternation(ids: dict[str, int]) -> re.Pattern | None:
    return re.compile("|".join(re.escape(t) for t in sorted(ids, key=len, reverse=True))) if ids else None


class Kernel:
    """Encodes texts with one immutable set of definitions; words are remembered, up to limit of them."""

    def __init__(self, added: Added, prefix: str, max_word_length: int, unk_token: str, limit: int = 300_000):
        self.added, self.normalizer, self.vocab = added, added.normalizer, added.vocab
        self.prefix, self.longest, self.unk, self.limit = prefix, max_word_length, unk_token, limit
        self.unk_id = self.vocab.token_to_id(unk_token)
        self._memo: dict[str, list] = {}
        self._ids = _Ids(self)
        self._entries = _Entries(self)
        self._plain = not added.cooked[0] and self.normalizer.split
        self._piece = _raw_pieces(self.normalizer) if self._plain else None

    def __getstate__(self):
        return {**self.__dict__, "_memo": {}, "_ids": None, "_entries": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ids, self._entries = _Ids(self), _Entries(self)

    def word(self, word: str) -> list[tuple[str, int, int, int]]:
        """(token, id, start, end) pieces of one normalized word; one unknown token if it has no full segmentation."""
        if not word:
            return []
        unknown = [(self.unk, self.unk_id, 0, len(word))]
        if len(word) > self.longest:
            return unknown
        out, at, longest = [], 0, self.vocab.words.longest_prefix
        while at < len(word):
            hit = longest(word, at)
            if hit is None and not self.prefix and word[at] in self.vocab.ids:  # with an empty prefix nothing is a whole word
                hit = (word[at], self.vocab.ids[word[at]], at + 1)
            if hit is None:
                return unknown
            token, id_, end = hit
            out.append((self.prefix + token if at else token, id_, at, end))
            at, longest = end, self.vocab.continuations.longest_prefix
        return out

    def _raw_word(self, raw: str) -> list[list[tuple[str, int, int, int]]]:
        """Words with pieces of a stretch of original text that holds no certain boundary; spans are relative to it."""
        if raw.isascii() and raw.isalnum():  # nothing to clean, strip or split
            return [self.word(raw.lower() if self.normalizer.lowercase else raw)]
        text, at = normalize(raw, self.normalizer)
        return [[(t, i, at[s + a], at[s + b - 1] + 1) for t, i, a, b in self.word(text[s:e])] for s, e in split(text)]

    def content(self, text: str, word_id: int | None = None) -> Content:
        """The content arrays of a text; with word_id all its tokens carry that one."""
        out: Content = ([], [], [], [], [])
        next_ = 0
        for start, end, id_ in self.added.matches(text, self.added.raw):
            if id_ is not None:
                _emit(out, text[start:end], id_, start, end, next_ if word_id is None else word_id)
                next_ += 1
            elif self._plain:
                next_ = self._fast(text, start, end, out, next_, word_id)
            else:
                next_ = self._slow(text, start, end, out, next_, word_id)
        return out

    def _fast(self, text: str, start: int, end: int, out: Content, next_: int, word_id: int | None) -> int:
        memo, (tokens, ids, starts, ends, words) = self._memo, out
        for m in self._piece.finditer(text, start, end):
            raw, at = m[0], m.start()
            known = memo.get(raw)
            if known is None:
                if len(memo) >= self.limit:
                    memo.clear()
                known = memo[raw] = self._raw_word(raw)
            for pieces in known:
                for t, i, a, b in pieces:
                    tokens.append(t)
                    ids.append(i)
                    starts.append(at + a)
                    ends.append(at + b)
                    words.append(next_ if word_id is None else word_id)
                next_ += 1
        return next_

    def _slow(self, text: str, start: int, end: int, out: Content, next_: int, word_id: int | None) -> int:
        norm, at = normalize(text[start:end], self.normalizer)
        span = lambda a, b: (start + at[a], start + at[b - 1] + 1)
        for s, e, id_ in self.added.matches(norm, self.added.cooked):
            if id_ is not None:
                _emit(out, norm[s:e], id_, *span(s, e), next_ if word_id is None else word_id)
                next_ += 1
                continue
            for a, b in split(norm[s:e]) if self.normalizer.split else [(0, e - s)]:
                for t, i, x, y in self.word(norm[s + a : s + b]):
                    _emit(out, t, i, *span(s + a + x, s + a + y), next_ if word_id is None else word_id)
                next_ += 1
        return next_

    def contents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What content gives for each text, as arrays: (number of tokens of each text, token names, and for all tokens in
        turn the place of the name, id, start, end, word id). A null text has no tokens.

        Texts are looked at as one: only words and added tokens are Python objects, all else is arithmetic on arrays.
        """
        memo, classes = self._entries, _classes(self.normalizer, self._plain)
        memo.make_room()
        offsets, seen, alone, origin = [], [], [], []
        size = at = 0  # characters of the original and of what is looked at
        for text in texts:
            offsets.append((size, at))
            for start, end, id_ in self.added.matches(text or "", self.added.raw):
                raw, places = text[start:end], range(end - start)
                if id_ is not None:
                    alone.append((at, at + len(raw), (id_, raw)))
                elif not self._plain:
                    raw, places = normalize(raw, self.normalizer)
                    alone += [(at + s, at + e, (i, raw[s:e])) for s, e, i in self.added.matches(raw, self.added.cooked) if i is not None]
                if not self._plain:
                    origin.append(np.fromiter(places, np.int32, len(raw)) + np.int32(size + start))
                seen.append(raw)
                at += len(raw)
            size += len(text or "")

        whole = "".join(seen)
        kind = classes[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        for s, e, _ in alone:
            kind[s:e] = 0
            kind[s] = 1
        run = kind == 2
        begins, ends = run.copy(), run.copy()
        begins[1:] &= ~run[:-1]
        ends[:-1] &= ~run[1:]
        border = np.array([a for _, a in offsets if 0 < a < at], np.int64)  # no word goes on in the next text
        begins[border], ends[border - 1] = run[border], run[border - 1]
        begins, ends = np.flatnonzero(begins | (kind == 1)), np.flatnonzero(ends | (kind == 1)) + 1
        keys: list = [whole[s:e] for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
        for i, (_, _, key) in zip(np.searchsorted(begins, [s for s, _, _ in alone]).tolist(), alone, strict=True):
            keys[i] = key
        ix = np.fromiter(map(memo.__getitem__, keys), np.int64, len(keys))

        sizes, n_words, (tokens, ids, a, b, word) = memo.taken(ix)
        until = np.searchsorted(begins, [*(a for _, a in offsets[1:]), at])  # entries up to each text's end
        since = np.concatenate([[0], until[:-1]])
        total, words = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(n_words)])
        own = lambda x: np.repeat(np.asarray(x), until - since)
        each = lambda x: np.repeat(np.asarray(x).astype(np.int32), sizes)
        a, b = a + each(begins), b + each(begins)
        if not self._plain and len(a):
            back = np.concatenate(origin)
            a, b = back[a], back[b - 1] + 1
        zero = each(own([x for x, _ in offsets]))
        return (
            total[until] - total[since], list(memo.names), tokens, ids, a - zero, b - zero,
            word + each(words[:-1] - own(words[since])),
        )

    def words_content(self, words: Iterable[str | None]) -> Content:
        """Content of a text that comes as words: spans are word-local, word ids are the words' places."""
        out: Content = ([], [], [], [], [])
        for i, w in enumerate(words):
            for mine, new in zip(out, self.content(w or "", word_id=i), strict=True):
                mine += new
        return out

    def ids(self, text: str) -> list[int]:
        """The ids alone: words that are known cost one look-up."""
        pattern = self.added.raw[1]
        if not self._plain or (pattern is not None and pattern.search(text)):
            return self.content(text)[1]
        if len(self._ids) >= self.limit:
            self._ids.clear()
        return list(chain.from_iterable(map(self._ids.__getitem__, self._piece.findall(text))))


class _Ids(dict):
    """Stretch of original text -> ids of its words."""

    def __init__(self, kernel: Kernel):
        super().__init__()
        self.kernel = kernel

    def __missing__(self, raw: str) -> list[int]:
        self[raw] = ids = [p[1] for pieces in self.kernel._raw_word(raw) for p in pieces]
        return ids


class _Entries(dict):
    """Word, or (id, text) of an added token -> its place in growing arrays of its tokens; bounded: it starts anew before a
    call if it holds limit entries or 32 million characters."""

    def __init__(self, kernel: Kernel):
        super().__init__()
        self.kernel = kernel
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.names: dict[str, int] = {}
        self.chars = 0
        self.first, self.words, self.flat = array("i", [0]), array("i"), array("i")  # flat: five numbers a token

    def make_room(self) -> None:
        if len(self) >= self.kernel.limit or self.chars >= 1 << 25:
            self.reset()

    def __missing__(self, key: str | tuple[int, str]) -> int:
        self[key] = place = len(self.words)
        if isinstance(key, tuple):
            found = [[(key[1], key[0], 0, len(key[1]))]]
        else:
            found = self.kernel._raw_word(key) if self.kernel._plain else [self.kernel.word(key)]
        names = self.names
        self.flat.fromlist([x for w, pieces in enumerate(found) for t, i, a, b in pieces for x in (names.setdefault(t, len(names)), i, a, b, w)])
        self.chars += len(key[-1]) if isinstance(key, tuple) else len(key)
        self.words.append(len(found))
        self.first.append(len(self.flat) // 5)
        return place

    def taken(self, ix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of the entries at ix: numbers of tokens and of words, and all their tokens in turn."""
        # views: they are gone when this returns, before anything more is remembered
        first, words, flat = (np.frombuffer(x, np.int32) if x else np.empty(0, np.int32) for x in (self.first, self.words, self.flat))
        flat = flat.reshape(-1, 5)
        sizes = (first[1:] - first[:-1])[ix]
        at = np.repeat(first[ix] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return sizes, words[ix], [x[at] for x in flat.T]


def _emit(out: Content, token: str, id_: int, start: int, end: int, word: int) -> None:
    for column, x in zip(out, (token, id_, start, end, word), strict=True):
        column.append(x)


@functools.cache
def _alone() -> tuple[str, ...]:
    """The characters that are punctuation."""
    return tuple(c for c in map(chr, range(sys.maxunicode + 1)) if c < "\x80" and u.is_punctuation(c) or unicodedata.category(c)[0] == "P")


def _white(n: Normalizer) -> list[str]:
    return [chr(c) for c in sorted(u.WHITE_SPACE) if not n.clean_text or u.cleaned(chr(c)) is not None]


@functools.cache
def _raw_pieces(n: Normalizer) -> re.Pattern:
    """Original characters that are boundaries whatever normalization does: white space is skipped, punctuation and
    spaced-out Chinese characters are pieces of their own, and all else goes together."""
    cjk = "".join(f"{chr(a)}-{chr(b)}" for a, b in u.CJK) if n.handle_chinese_chars else ""
    single = "".join(re.escape(c) for c in _alone()) + cjk
    return re.compile(f"[{single}]|[^{single}{re.escape(''.join(_white(n)))}]+")


@functools.cache
def _classes(n: Normalizer, raw: bool) -> np.ndarray:
    """Code point -> 0 white space, 1 a piece of its own, 2 anything else; raw: as _raw_pieces has it, else as split has it."""
    kind = np.full(sys.maxunicode + 1, 2, np.uint8)
    kind[[ord(c) for c in _alone()]] = 1
    for a, b in u.CJK if raw and n.handle_chinese_chars else ():
        kind[a : b + 1] = 1
    kind[[ord(c) for c in _white(n)] if raw else sorted(u.WHITE_SPACE)] = 0
    return kind
