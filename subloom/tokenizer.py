"""The tokenizer: definitions on the driver, encodings as columns."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.config import CLS, MASK, PAD, SEP, SPECIALS, UNK, AddedToken, Normalizer, Padding, Part, Truncation, WordPieceConfig
from subloom.functions import encoding as E
from subloom.operators.encode import content_udf, count_udf, ids_udf, lookup_udf, names_udf, words_udf
from subloom.operators.kernel import Added, Kernel
from subloom.plans.batch import pad_batch
from subloom.sources.tokenizer_json import TokenizerJson, parse
from subloom.sources.vocabulary import Vocabulary, bracket_shaped, whole_file


class WordPieceTokenizer:
    """Encodes text columns. Instances don't change: add_tokens, with_padding and so on return new ones, so work that has
    been planned with one is never touched by later settings."""

    def __init__(self, vocab: Vocabulary, config: WordPieceConfig | None = None):
        self.config = config or WordPieceConfig()
        self._json: TokenizerJson | None = None
        self._legacy_template = True
        self.unk_token, self.padding, self.truncation = UNK, None, None
        n = Normalizer(self.config.lowercase, self.config.strip_accents, self.config.handle_chinese_chars)
        specials = [AddedToken(t, special=True, normalized=False) for t in SPECIALS if t in vocab]
        self._added, _ = Added(vocab, n).register(specials)

    @classmethod
    def from_vocab_file(
        cls, path: str, spark: SparkSession | None = None, config: WordPieceConfig | None = None,
    ) -> WordPieceTokenizer:
        return cls(Vocabulary.from_file(path, spark, (config or WordPieceConfig()).subword_prefix), config)

    @classmethod
    def from_tokenizer_json(
        cls, path: str, spark: SparkSession | None = None, config: WordPieceConfig | None = None,
    ) -> WordPieceTokenizer:
        if spark is None:
            with open(path, encoding="utf-8") as f:
                return cls.from_tokenizer_json_string(f.read(), config)
        return cls.from_tokenizer_json_string(whole_file(spark, path), config)

    @classmethod
    def from_tokenizer_json_string(cls, text: str, config: WordPieceConfig | None = None) -> WordPieceTokenizer:
        """config replaces the file's settings as a whole, and its templates by the plain [CLS] A [SEP] B [SEP]; cleaning,
        decoder and padding stay the file's."""
        j = parse(text)
        t = object.__new__(cls)
        t.config, t._json, t._legacy_template, t.unk_token = config or j.config, j, config is not None, j.unk_token
        n = j.normalizer if config is None else Normalizer(
            config.lowercase, config.strip_accents, config.handle_chinese_chars, j.normalizer.clean_text,
            j.normalizer.split,
        )
        known = {a.content for a in j.added}
        base = {k: v for k, v in j.vocab.items() if k not in known or k in j.raw["model"]["vocab"]}
        t._added, _ = Added(Vocabulary.from_map(base, t.config.subword_prefix), n).register(j.added)
        t.padding, t.truncation = j.padding, j.truncation
        return t

    def _with(self, **changes) -> WordPieceTokenizer:
        t = copy.copy(self)
        t.__dict__.update(changes)
        return t

    # definitions

    @property
    def vocab(self) -> Vocabulary:
        return self._added.vocab

    def add_tokens(self, tokens: list[AddedToken | str]) -> tuple[WordPieceTokenizer, int]:
        """A tokenizer with more tokens, and how many are new or changed."""
        added, n = self._added.register([AddedToken(t) if isinstance(t, str) else t for t in tokens])
        return self._with(_added=added), n

    def add_special_tokens(self, tokens: list[str]) -> tuple[WordPieceTokenizer, int]:
        return self.add_tokens([AddedToken(t, special=True, normalized=False) for t in tokens])

    def with_padding(
        self, length: int | None = None, multiple: int | None = None, direction: str = "right",
    ) -> WordPieceTokenizer:
        j = self._json.padding if self._json else None
        how = {"pad_id": j.pad_id, "pad_token": j.pad_token, "pad_type_id": j.pad_type_id} if j else {}
        return self._with(padding=Padding(length, multiple, direction, **how))

    def without_padding(self) -> WordPieceTokenizer:
        return self._with(padding=None)

    def with_truncation(
        self, max_length: int, direction: str = "right", strategy: str = "longest_first",
    ) -> WordPieceTokenizer:
        return self._with(truncation=Truncation(max_length, direction, strategy))

    def without_truncation(self) -> WordPieceTokenizer:
        return self._with(truncation=None)

    def kernel(self) -> Kernel:
        return Kernel(self._added, self.config.subword_prefix, self.config.max_word_length, self.unk_token)

    def template(self, pair: bool = False, add_special_tokens: bool | None = None) -> tuple[Part, ...]:
        """What an encoding is put together from. False leaves the sequences alone; True can't add what a file has not."""
        if self._json is None or self._legacy_template:
            cls_on, sep_on = (self.config.add_cls, self.config.add_sep) if add_special_tokens is None else (add_special_tokens,) * 2
            parts = [*[Part(0, token=CLS)] * cls_on, Part(0, sequence="A"), *[Part(0, token=SEP)] * sep_on]
            return (*parts, Part(1, sequence="B"), *[Part(1, token=SEP)] * sep_on) if pair else tuple(parts)
        found = self._json.pair if pair else self._json.single
        if found is None:
            raise ValueError("the post-processor has no template for pairs")
        return tuple(p for p in found if p.sequence) if add_special_tokens is False else found

    def num_special_tokens(self, pair: bool = False) -> int:
        return sum(p.token is not None for p in self.template(pair))

    # encodings

    def _id(self, token: str) -> int:
        return self.vocab.special_id(token) if token in (CLS, SEP, PAD, UNK, MASK) else self.vocab.token_to_id(token)

    def _assemble(
        self, a: Column, b: Column | None, add_special_tokens: bool | None, max_length: int | None,
        strategy: str | None, pad: bool,
    ) -> Column:
        template = self.template(b is not None, add_special_tokens)
        reserved = sum(p.token is not None for p in template)
        limit = max_length if max_length is not None else self.truncation.max_length if self.truncation else None
        if limit is not None:
            if limit < reserved:  # known before any row is read
                raise ValueError(f"max_length {limit} is too small for {reserved} special tokens")
            direction = self.truncation.direction if self.truncation else "right"
            if b is None:
                a = E.truncate_content(a, F.lit(limit - reserved), direction)
            else:
                chosen = (self.truncation.strategy if self.truncation else strategy) or "longest_first"
                a, b = E.truncate_pair(a, b, limit, reserved, chosen, direction)
        enc = E.from_template(template, self._id, a, b)
        return E.apply_padding(enc, self.padding, self.vocab.pad_id) if pad else enc

    def _encoded(
        self, df: DataFrame, columns: list[str], out: str, words: bool, batch: str | None, whole: bool, **how,
    ) -> DataFrame:
        """df with the encoding of one or two columns; a null input gives a null encoding."""
        f = (words_udf if words else content_udf)(self.kernel())
        names = [f"_content{i}" for i in range(len(columns))]
        d = df.select("*", *[f(F.col(c)).alias(n) for c, n in zip(columns, names, strict=True)])
        longest = whole and self.padding is not None and self.padding.length is None
        a, b = F.col(names[0]), F.col(names[1]) if len(names) > 1 else None
        some = a.isNotNull() if b is None else a.isNotNull() & b.isNotNull()
        enc = F.when(some, self._assemble(a, b, pad=not longest, **how))
        d = d.withColumn(out, enc).drop(*names)
        return pad_batch(d, out, self.padding, self.vocab.pad_id, batch) if longest else d

    def encode(
        self, df: DataFrame, text: str, out: str = "encoding", add_special_tokens: bool | None = None,
    ) -> DataFrame:
        return self._encoded(
            df, [text], out, False, None, False, add_special_tokens=add_special_tokens, max_length=None, strategy=None,
        )

    def encode_pair(
        self, df: DataFrame, first: str, second: str, out: str = "encoding", add_special_tokens: bool | None = None,
        max_length: int | None = None, strategy: str | None = None,
    ) -> DataFrame:
        """max_length overrides the configured one; a strategy counts only where no truncation is configured."""
        return self._encoded(
            df, [first, second], out, False, None, False, add_special_tokens=add_special_tokens, max_length=max_length,
            strategy=strategy,
        )

    def encode_pretokenized(
        self, df: DataFrame, words: str, out: str = "encoding", add_special_tokens: bool | None = None,
    ) -> DataFrame:
        return self._encoded(
            df, [words], out, True, None, False, add_special_tokens=add_special_tokens, max_length=None, strategy=None,
        )

    def encode_pretokenized_pair(
        self, df: DataFrame, first: str, second: str, out: str = "encoding", add_special_tokens: bool | None = None,
        max_length: int | None = None, strategy: str | None = None,
    ) -> DataFrame:
        return self._encoded(
            df, [first, second], out, True, None, False, add_special_tokens=add_special_tokens, max_length=max_length,
            strategy=strategy,
        )

    def encode_batch(
        self, df: DataFrame, text: str, batch: str | None = None, out: str = "encoding", pretokenized: bool = False,
        num_workers: int | None = None, add_special_tokens: bool | None = None,
    ) -> DataFrame:
        """Like encode; padding without a length goes to the longest of the batch (column batch; none: the whole table).

        Rows are parallel whatever num_workers; if given, it deals them to so many partitions first.
        """
        return self._encoded(
            _dealt(df, num_workers), [text], out, pretokenized, batch, True, add_special_tokens=add_special_tokens,
            max_length=None, strategy=None,
        )

    def encode_pair_batch(
        self, df: DataFrame, first: str, second: str, batch: str | None = None, out: str = "encoding",
        pretokenized: bool = False, num_workers: int | None = None, add_special_tokens: bool | None = None,
        max_length: int | None = None, strategy: str | None = None,
    ) -> DataFrame:
        return self._encoded(
            _dealt(df, num_workers), [first, second], out, pretokenized, batch, True,
            add_special_tokens=add_special_tokens, max_length=max_length, strategy=strategy,
        )

    def ids(self, text: Column | str) -> Column:
        """Content ids alone."""
        return ids_udf(self.kernel())(F.col(text) if isinstance(text, str) else text)

    def count(self, text: Column | str) -> Column:
        """The number of content tokens."""
        return count_udf(self.kernel())(F.col(text) if isinstance(text, str) else text)

    def content(self, text: Column | str) -> Column:
        return content_udf(self.kernel())(F.col(text) if isinstance(text, str) else text)

    # decoding and lookups

    def _skipped(self) -> list[int]:
        """Ids that decoding leaves out: special ones; without a file also whatever looks [like this] and isn't added."""
        more = [i for i, n in self.vocab.names.items() if self._json is None and bracket_shaped(n) and i not in self._added.tokens]
        return sorted({*self._added.special_ids, *more})

    def decode(self, ids: Column | str, skip_special_tokens: bool = True) -> Column:
        """Text of an id array. Unknown ids read [UNK]; without a file they are left out with the special ones."""
        x = F.col(ids) if isinstance(ids, str) else ids
        if skip_special_tokens:
            skipped = F.lit(self._skipped()).cast("array<int>")
            x = F.filter(x, lambda i: ~F.array_contains(skipped, i))
        names = {**self.vocab.names, **self._added.spelled}
        unknown = None if self._json is None and skip_special_tokens else UNK
        spelled = F.filter(names_of(x, names, unknown), lambda t: t.isNotNull())
        j = self._json
        if j is not None and not j.has_decoder:
            return E.join_tokens(spelled, None, False)
        prefix = j.decoder_prefix if j is not None and j.decoder_prefix is not None else self.config.subword_prefix
        return E.join_tokens(spelled, prefix, j is None, j is not None and j.cleanup)

    def tokens_to_ids(self, tokens: Column | str) -> Column:
        """Ids of an array of tokens; those the vocabulary lacks get the id of [UNK]."""
        return lookup_udf(self.vocab.ids, self.vocab.unk_id)(F.col(tokens) if isinstance(tokens, str) else tokens)

    def ids_to_tokens(self, ids: Column | str) -> Column:
        """Names of an array of ids; those without one read [UNK]."""
        return names_of(F.col(ids) if isinstance(ids, str) else ids, self.vocab.names, UNK)


_DENSE = 4  # ids up to this many times the number of names are kept in one constant array


def names_of(ids: Column, names: dict[int, str], unknown: str | None) -> Column:
    """Names of an id array by one constant array that ids index, or for sparse ids by an Arrow lookup."""
    top = max(names, default=-1) + 1
    mark = next(chr(c) for c in range(1, 32) if not any(chr(c) in n for n in names.values()))
    if top > _DENSE * len(names) + 1024:
        found = names_udf(names)(ids)
    else:
        table = F.split(F.lit(mark.join(names.get(i, "\0") for i in range(top))), mark, -1)
        found = F.transform(ids, lambda i: F.when(i >= 0, F.get(table, i)))
    return F.transform(found, lambda t: F.when(t.isNull() | (t == "\0"), F.lit(unknown)).otherwise(t))


def _dealt(df: DataFrame, num_workers: int | None) -> DataFrame:
    if num_workers is None:
        return df
    if num_workers <= 0:
        raise ValueError("num_workers must be positive")
    return df.repartition(num_workers)
