"""The text kernel, vocabularies and added tokens against slow definitions, without Spark."""

import random
import sys
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from subloom import unicode as u
from subloom.config import MAX_ID, AddedToken, Normalizer
from subloom.operators.kernel import Added, Kernel, normalize, split
from subloom.sources.vocabulary import PrefixSet, Vocabulary
from subloom.tokenizer import WordPieceTokenizer

PIECES = ["[UNK]", *"mnoe;.", *("##" + c for c in "mno"), "mo", "mon", "##no", "##om", "##e", "one", "##;", "川", "ß"]
MIXED = st.text(alphabet="mnoeÉéÑ ;.\t\u0085\u000b川́​ᄀ각ßİ [UNK]", max_size=30)


def slow_normalized(text, n):
    """[(character, place of the original)] by the rules, one original character after the other."""
    out = []
    for at, c in enumerate(text):
        new = c
        if n.clean_text:
            kind = unicodedata.category(c)
            if c in "\t\n\r" or kind == "Zs":
                new = " "
            elif c in "\0�" or kind in ("Cc", "Cf"):
                continue
        spaced = n.handle_chinese_chars and any(a <= ord(new) <= b for a, b in u.CJK)
        if n.strip_accents:
            new = "".join(x for x in unicodedata.normalize("NFD", new) if unicodedata.category(x) != "Mn")
        if n.lowercase:
            new = "".join(x.lower() for x in new)
        out += [(x, at) for x in (f" {new} " if spaced else new)]
    return out


def slow_content(text, vocab, n, unk="[UNK]"):
    """(token, start, end, word) by splitting characters and trying every end, longest first."""
    words, run = [], []
    for x, at in [*slow_normalized(text, n), (" ", 0)]:
        lone = unicodedata.category(x)[0] == "P" or (x.isascii() and x.isprintable() and not x.isalnum() and x != " ")
        if x.isspace() and ord(x) not in range(0x1C, 0x20) or lone:
            words += [run] if run else []
            run = []
            words += [[(x, at)]] if lone else []
        else:
            run.append((x, at))
    out = []
    for w, chars in enumerate(words):
        word, at, mine = "".join(x for x, _ in chars), 0, []
        while at < len(word):
            ends = [e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocab and (at or not (word.startswith("[") and word[:e].endswith("]")))]
            if not ends:
                mine = [(unk, 0, len(word))]
                break
            mine.append((("##" if at else "") + word[at : ends[0]], at, ends[0]))
            at = ends[0]
        out += [(t, chars[a][1], chars[b - 1][1] + 1, w) for t, a, b in mine]
    return out


def rows(c):
    return list(zip(c[0], c[2], c[3], c[4], strict=True))


@settings(max_examples=400, deadline=None)
@given(MIXED, st.booleans(), st.booleans(), st.booleans(), st.booleans())
def test_contents_follow_the_slow_definition(text, lower, accents, cjk, clean):
    n = Normalizer(lower, accents, cjk, clean)
    v = Vocabulary.from_map({t: i for i, t in enumerate(PIECES)})
    assert normalize(text, n)[0] == "".join(x for x, _ in slow_normalized(text, n))
    fast = Kernel(Added(v, n), "##", 200, "[UNK]")
    slow = Kernel(fast.added, "##", 200, "[UNK]")
    slow._plain = False
    want = slow_content(text, v, n)
    assert rows(fast.content(text)) == want == rows(slow.content(text))
    assert fast.ids(text) == [v.token_to_id(t) for t, *_ in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="mnoé; ", max_size=8), max_size=6))
def test_words_given_apart_keep_their_places(words):
    k = WordPieceTokenizer(Vocabulary.from_tokens(PIECES)).kernel()
    got = k.words_content(words)
    want = [(t, a, b, i) for i, w in enumerate(words) for t, a, b, _ in rows(k.content(w))]
    assert rows(got) == want == rows(k.words_content([w or None for w in words]))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab-川 　.", max_size=25))
def test_split_covers_all_but_white_space(text):
    found = list(split(text))
    assert "".join(text[a:b] for a, b in found) == "".join(text.split())
    assert all(b - a == 1 or not set(text[a:b]) & set("-. 　") for a, b in found)
    joined = [text[b:c] for (_, b), (c, _) in zip(found, found[1:], strict=False)]
    assert all(gap or any(u.is_punctuation(x) for x in text[a:b] + text[c:d]) for gap, (a, b), (c, d) in zip(joined, found, found[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="pqr", max_size=4), st.integers(0, 99), max_size=12), st.text(alphabet="pqrs", max_size=10), st.integers(0, 3))
def test_prefix_search_follows_the_slow_definition(items, text, start):
    p = PrefixSet(items)
    want = [(text[start:e], items[text[start:e]], e) for e in range(start + 1, len(text) + 1) if text[start:e] in items]
    assert p.all_prefixes(text, start) == want and p.longest_prefix(text, start) == (want[-1] if want else None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="xy# \t", max_size=3), max_size=9))
def test_vocabulary_lines(lines):
    v = Vocabulary.from_string("\n".join(lines))
    want = {line.strip(): i for i, line in enumerate(lines) if line.strip()}
    assert v.ids == want and v.size == max(want.values(), default=-1) + 1
    assert v.tokens == [lines[i].strip() if i in set(range(len(lines))) and lines[i].strip() else "" for i in range(v.size)]
    assert all(t in v and v.id_to_token(i) == t for t, i in want.items()) and v.id_to_token(10**6) == "[UNK]"


def test_files_are_read_with_and_without_a_session(spark, tmp_path):
    lines = ["[UNK]", "", "mill", "##stone", "mill"]
    (tmp_path / "v.txt").write_text("\r\n".join(lines), encoding="utf-8")
    a, b = Vocabulary.from_file(str(tmp_path / "v.txt")), Vocabulary.from_file(f"file://{tmp_path}/v.txt", spark)
    assert a.ids == b.ids == {"[UNK]": 0, "##stone": 3, "mill": 4} and repr(a) == "Vocabulary(size: 5, prefix: '##')"
    (tmp_path / "w.txt").write_text("x")
    with pytest.raises(ValueError):
        Vocabulary.from_file(str(tmp_path), spark)
    t = WordPieceTokenizer.from_vocab_file(str(tmp_path / "v.txt"))
    assert t.kernel().content("Millstone")[1] == [4, 3]


def test_ids_out_of_range():
    for bad in (-5, MAX_ID + 1, 0.5):
        with pytest.raises(ValueError):
            Vocabulary.from_map({"mill": bad})
    assert Vocabulary.from_map({"mill": MAX_ID}).size == MAX_ID + 1


# added tokens


def slow_matches(text, tokens):
    """[(start, end, token)]: leftmost, longest first; a match that a word character touches is passed over whole."""
    out, at, done = [], 0, 0
    while at < len(text):
        fit = [t for t in tokens if text.startswith(t.content, at)]
        if not fit:
            at += 1
            continue
        t = max(fit, key=lambda t: len(t.content))
        a, b = at, at + len(t.content)
        at = b
        if t.single_word and (text[:a] and u.is_word(text[a - 1]) or text[b:] and u.is_word(text[b])):
            continue
        while t.lstrip and a > done and u.is_white(text[a - 1]):
            a -= 1
        while t.rstrip and b < len(text) and u.is_white(text[b]):
            b += 1
        if t.lstrip:
            a = max(a, done)  # only a token that reaches back is held off from what the last one took
        if a < b:
            out.append((a, b, t))
            done = b
    return out


FLAGS = st.tuples(st.sampled_from(["ov", "ver", "over", "<r>", " ", "o"]), st.booleans(), st.booleans(), st.booleans())


@settings(max_examples=300, deadline=None)
@given(st.lists(FLAGS, min_size=1, max_size=4, unique_by=lambda x: x[0]), st.text(alphabet="over<> _é", max_size=25))
def test_added_tokens_follow_the_slow_definition(flags, text):
    tokens = [AddedToken(c, single_word=s, lstrip=left, rstrip=right, normalized=False) for c, s, left, right in flags]
    added, n = Added(Vocabulary.from_tokens(["[UNK]"]), Normalizer()).register(tokens)
    assert n == len(tokens)
    got = [(a, b, added.tokens[i].content) for a, b, i in added.matches(text, added.raw) if i is not None]
    assert got == [(a, b, t.content) for a, b, t in slow_matches(text, tokens)]
    if not any(t.rstrip for t in tokens):
        assert "".join(text[a:b] for a, b, _ in added.matches(text, added.raw)) == text


def test_normalized_tokens_are_found_in_normalized_text():
    t, _ = WordPieceTokenizer(Vocabulary.from_tokens(PIECES)).add_tokens([AddedToken("NÔM"), AddedToken("nom"), AddedToken("E;", normalized=False)])
    ids = [t.vocab.token_to_id(x) for x in ("NÔM", "E;")]
    assert t.kernel().content("Ñom E; nôm")[1] == [ids[0], ids[1], ids[0]]  # of equal spellings the lower id


def test_registering():
    t = WordPieceTokenizer(Vocabulary.from_tokens(PIECES))
    size = t.vocab.size
    more, n = t.add_tokens(["mill", "", AddedToken("one", special=True), "mill"])
    assert n == 2 and more.vocab.size == size + 1 and t.vocab.size == size and "mill" not in t.vocab
    again, n = more.add_tokens([AddedToken("mill"), AddedToken("one", lstrip=True)])
    assert n == 1 and again.vocab.token_to_id("one") in again._added.special_ids  # special ones stay special
    special, n = t.add_special_tokens(["<r>"])
    assert n == 1 and special.vocab.token_to_id("<r>") in special._added.special_ids
    full = WordPieceTokenizer(Vocabulary.from_map({"[UNK]": 1, "one": MAX_ID - 1}))
    with pytest.raises(ValueError):
        full.add_tokens(["mill", "stone"])
    assert full.add_tokens(["mill"])[0].vocab.token_to_id("mill") == MAX_ID


def test_word_characters_are_assigned_letters_marks_digits_and_connectors():
    rng = random.Random(1)
    for c in map(chr, rng.sample(range(sys.maxunicode + 1), 60_000)):
        kind = unicodedata.category(c)
        if kind[0] in "LM" or kind in ("Nd", "Nl", "Pc"):
            assert u.is_word(c), hex(ord(c))
        elif kind == "Cn" or kind[0] in "ZS" and kind != "So" or kind[0] == "P":
            assert not u.is_word(c), hex(ord(c))


def test_an_empty_prefix_takes_single_characters():
    v = Vocabulary.from_map({"[UNK]": 0, "m": 1, "o": 2, "mo": 3})
    k = Kernel(Added(v, Normalizer()), "", 200, "[UNK]")
    assert k.content("momox mo")[0][0] in ("mo", "m", "[UNK]") and k.content("z")[1] == [0]


def test_long_words_are_unknown():
    k = Kernel(Added(Vocabulary.from_tokens(PIECES), Normalizer()), "##", 6, "[UNK]")
    assert k.content("monono mononom")[0] == ["mon", "##o", "##no", "[UNK]"]


ADDED = {
    "raw": AddedToken("ation", normalized=False), "strip": AddedToken("then", lstrip=True, rstrip=True, normalized=False),
    "normalized": AddedToken("ÉAU", normalized=True), "single_word": AddedToken("then", single_word=True, normalized=False),
}


def _mixed(n, seed=3):
    rnd = random.Random(seed)
    parts = ["then", "ation", "éau", "ÉAU", " ", "\t", "\0", "　", "​", "x", "中", ".", "é", "́", "가", "İ", "ﬃ"]
    return ["", None, "  ", *("".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(n))]


def _same_contents(kind):
    """Contents by arrays, of many texts at once and of each alone, equal those built text by text."""
    from subloom.operators.encode import to_arrow, to_struct
    from subloom.queries import tokenizer

    t, _ = tokenizer().add_tokens([ADDED[kind]])
    texts = _mixed(800)
    want = to_arrow([t.kernel().content(x) if x is not None else None for x in texts])
    assert to_struct(t.kernel(), texts).equals(want)
    k = t.kernel()
    k.limit = 5  # what is remembered starts anew over and over
    assert [to_struct(k, [x]).to_pylist()[0] for x in texts] == want.to_pylist()


def test_array_contents_raw():
    _same_contents("raw")


def test_a_batch_is_encoded_in_slices_of_bounded_size():
    from subloom.operators.encode import slices

    texts = pa.array([None, "ab" * 300, "é" * 900, "", "c" * 5000, "d", None])
    got = list(slices(texts, 1000))
    assert pa.concat_arrays(got).equals(texts) and len(got) > 2
    assert all(sum(len((t or "").encode()) for t in x.to_pylist()[1:]) < 1000 for x in got)
    assert [len(x) for x in slices(texts.slice(0, 0))] == [0]
    words = pa.array([["a"] * 200, None, ["b"] * 3, []])
    assert pa.concat_arrays(list(slices(words, 1000))).equals(words)


@pytest.mark.parametrize("kind", ["strip", "normalized", "single_word"])
def test_array_contents(kind):
    _same_contents(kind)


@pytest.mark.parametrize("seed", range(3))
def test_longest_prefix_against_all_prefixes(seed):
    rnd = random.Random(seed)
    p = PrefixSet({"".join(rnd.choices("abé", k=rnd.randrange(6))): i for i in range(60)})
    for _ in range(500):
        text = "".join(rnd.choices("abéx", k=rnd.randrange(8)))
        for start in range(len(text) + 1):
            assert p.longest_prefix(text, start) == (p.all_prefixes(text, start) or [None])[-1]
    p.clear()
    assert p.longest_prefix("ab") is None


def test_a_new_word_costs_few_lookups():
    """Only lengths that tokens of the first character have are looked up."""
    class Counted(dict):
        looked = 0

        def get(self, *a):
            Counted.looked += 1
            return super().get(*a)

    p = PrefixSet({"a": 0, "b": 1, "b" * 50: 2})
    p._ids = Counted(p._ids)
    assert p.longest_prefix("a" * 60) == ("a", 0, 1) and Counted.looked == 1
    assert p.longest_prefix("b" * 60)[2] == 50 and p.longest_prefix("bab") == ("b", 1, 1)
