"""tokenizer.json: every field with values of a wrong type or range is rejected; what the accepted ones mean."""

import copy
import json

import pytest

from subloom.config import AddedToken, TokenizerFormatError, WordPieceConfig
from subloom.tokenizer import WordPieceTokenizer

NAMES = ["<pad>", "<unk>", "<from>", "<to>", "stone", "bridge", "over", "##way", "?", ";"]
IDS = {t: i + 10 for i, t in enumerate(NAMES)}


def special(name, type_id):
    return {"SpecialToken": {"id": name, "type_id": type_id}}


def sequence(name, type_id):
    return {"Sequence": {"id": name, "type_id": type_id}}


GOOD = {
    "model": {"type": "WordPiece", "vocab": IDS, "unk_token": "<unk>", "continuing_subword_prefix": "##", "max_input_chars_per_word": 30},
    "normalizer": {"type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": False, "strip_accents": False, "lowercase": True},
    "pre_tokenizer": {"type": "BertPreTokenizer"},
    "post_processor": {
        "type": "TemplateProcessing",
        "single": [special("<from>", 1), sequence("A", 2)],
        "pair": [sequence("B", 7), special("<to>", 6), sequence("A", 5)],
        "special_tokens": {"<to>": {"id": "<to>", "ids": [13], "tokens": ["<to>"]}},
    },
    "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": False},
    "added_tokens": [{"id": 10, "content": "<pad>", "special": True, "normalized": False, "single_word": False, "lstrip": False, "rstrip": False}],
    "truncation": {"max_length": 8, "direction": "Right", "strategy": "LongestFirst", "stride": 0},
    "padding": {"strategy": "BatchLongest", "direction": "Right", "pad_to_multiple_of": 4, "pad_id": 10, "pad_token": "<pad>", "pad_type_id": 0},
}

#: What each field holds, and for each kind values that it must not hold.
FIELDS = {
    "component": ["normalizer", "pre_tokenizer", "post_processor", "decoder"],
    "object": ["model", "model.vocab", "truncation", "padding", "post_processor.special_tokens"],
    "list": ["added_tokens", "post_processor.single", "post_processor.pair"],
    "flag": ["normalizer.clean_text", "normalizer.handle_chinese_chars", "normalizer.strip_accents", "normalizer.lowercase", "decoder.cleanup",
             *(f"added_tokens.0.{f}" for f in ("special", "normalized", "single_word", "lstrip", "rstrip"))],
    "name": ["model.unk_token", "added_tokens.0.content", "post_processor.single.0.SpecialToken.id", "post_processor.pair.0.Sequence.id", "model.type"],
    "id": ["model.vocab.over", "added_tokens.0.id", "padding.pad_id"],
    "type": ["post_processor.single.0.SpecialToken.type_id", "post_processor.single.1.Sequence.type_id", "post_processor.pair.1.SpecialToken.type_id", "padding.pad_type_id"],
    "count": ["model.max_input_chars_per_word", "padding.pad_to_multiple_of"],
    "choice": ["truncation.direction", "truncation.strategy", "padding.direction", "padding.strategy"],
}
WRONG = {
    "component": ["BertNormalizer", 7, [], {"type": "Elsewhere"}, {"type": None}, {}],
    "object": ["text", 3, [1]],
    "list": [{}, "A", 5],
    "flag": ["false", 0, [], {}],
    "name": [4, [], {}, "nowhere to be found", ""],
    "id": [-2, 0.5, "10", []],
    "type": [-1, 256, 1.5, "0", None],
    "count": [0, -4, 2.5, "4"],
    "choice": ["right", "Sideways", 1, {}],
}
#: Values that their field takes although others of its kind do not.
FINE = {("added_tokens.0.content", "nowhere to be found")}


def changed(path, value):
    j = copy.deepcopy(GOOD)
    *keys, last = [int(k) if k.isdigit() else k for k in path.split(".")]
    at = j
    for k in keys:
        at = at[k]
    at[last] = value
    return json.dumps(j)


CASES = [(path, value) for kind, paths in FIELDS.items() for path in paths for value in WRONG[kind] if (path, value if not isinstance(value, (list, dict)) else None) not in FINE]


def test_the_document_itself_is_good():
    t = WordPieceTokenizer.from_tokenizer_json_string(json.dumps(GOOD))
    assert t.kernel().content("OVERway stone?")[1] == [16, 17, 14, 18]


@pytest.mark.parametrize(("path", "value"), CASES, ids=[f"{p}={json.dumps(v)}" for p, v in CASES])
def test_fields_reject_other_kinds_of_values(path, value):
    with pytest.raises(TokenizerFormatError):
        WordPieceTokenizer.from_tokenizer_json_string(changed(path, value))


@pytest.mark.parametrize(("path", "value"), [
    ("model.vocab.over", IDS["bridge"]), ("post_processor.single", [special("<from>", 0)]), ("post_processor.pair", [sequence("A", 0)]),
    ("post_processor.pair", [sequence("A", 0), sequence("B", 0), sequence("A", 1)]), ("post_processor.single", [sequence("A", 0) | special("<to>", 0)]),
    ("post_processor.special_tokens", {"<to>": {"id": "<to>", "ids": [13, 12], "tokens": ["<to>", "<from>"]}}), ("truncation.stride", 2),
])
def test_parts_that_contradict_each_other(path, value):
    with pytest.raises(TokenizerFormatError):
        WordPieceTokenizer.from_tokenizer_json_string(changed(path, value))


def test_text_that_holds_no_object():
    for text in ("", "null", "[{}]", '"model"', json.dumps(GOOD)[:-1]):
        with pytest.raises(TokenizerFormatError):
            WordPieceTokenizer.from_tokenizer_json_string(text)


@pytest.mark.parametrize("direction", ["Left", "Right"])
@pytest.mark.parametrize("strategy", ["LongestFirst", "OnlyFirst", "OnlySecond"])
def test_truncation_and_padding_come_from_the_file(direction, strategy):
    j = copy.deepcopy(GOOD)
    j["truncation"] |= {"direction": direction, "strategy": strategy, "max_length": 21}
    j["padding"] |= {"direction": direction, "strategy": {"Fixed": 17}, "pad_id": 19, "pad_type_id": 9}
    t = WordPieceTokenizer.from_tokenizer_json_string(json.dumps(j))
    assert t.truncation.direction == t.padding.direction == direction.lower()
    assert t.truncation.strategy.replace("_", "") == strategy.lower() and t.truncation.max_length == 21
    assert (t.padding.length, t.padding.pad_id, t.padding.pad_type_id, t.padding.multiple) == (17, 19, 9, 4)


def test_a_token_that_the_vocabulary_lacks_gets_the_next_id():
    j = copy.deepcopy(GOOD)
    j["added_tokens"] += [{"id": 3, "content": "@@"}, {"id": 900, "content": "over"}]
    t = WordPieceTokenizer.from_tokenizer_json_string(json.dumps(j))
    assert t.vocab.token_to_id("@@") == max(IDS.values()) + 1 and t.vocab.token_to_id("over") == IDS["over"]
    assert t.kernel().content("stone@@")[1] == [14, 20]


def test_settings_given_beside_the_file_win():
    c = WordPieceConfig(lowercase=False, add_cls=True, add_sep=False)
    t = WordPieceTokenizer.from_tokenizer_json_string(json.dumps(GOOD), c)
    assert [p.token for p in t.template(pair=True)] == ["[CLS]", None, None] and t.kernel().content("Stone stone")[0] == ["<unk>", "stone"]


def test_templates_count_their_special_tokens():
    t = WordPieceTokenizer.from_tokenizer_json_string(json.dumps(GOOD))
    assert (t.num_special_tokens(), t.num_special_tokens(pair=True)) == (1, 1)
    assert [(p.type_id, p.token or p.sequence) for p in t.template(pair=True)] == [(7, "B"), (6, "<to>"), (5, "A")]
    assert all(p.sequence for p in t.template(add_special_tokens=False))
    alone = WordPieceTokenizer.from_tokenizer_json_string(changed("post_processor.pair", None))
    with pytest.raises(ValueError):
        alone.template(pair=True)


def test_components_that_are_null():
    j = GOOD | dict.fromkeys(("normalizer", "pre_tokenizer", "post_processor", "decoder", "added_tokens", "truncation", "padding"))
    t = WordPieceTokenizer.from_tokenizer_json_string(json.dumps(j))
    assert t.num_special_tokens() == 0 and t.padding is None and t.truncation is None
    assert t.kernel().content("overway")[0] == ["over", "##way"] and t.kernel().content("over way")[0] == ["<unk>"] == t.kernel().content("Over")[0]


def test_the_parsed_settings_stay_as_they_were():
    before = json.dumps(GOOD)
    t = WordPieceTokenizer.from_tokenizer_json_string(before)
    t.add_tokens([AddedToken("river")])
    t.with_padding(3).with_truncation(2)
    assert json.dumps(GOOD) == before and "river" not in t.vocab and t.truncation.max_length == 8
