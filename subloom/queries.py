"""The engine's own queries over the driver's tables, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.config import AddedToken, WordPieceConfig
from subloom.functions import encoding as E
from subloom.functions import sql as sql_functions
from subloom.functions import text as T
from subloom.operators.merge import merge_groups
from subloom.plans.lattice import prefixes, token_counts
from subloom.sources.vocabulary import Vocabulary
from subloom.streaming.encode import encode_stream, read_texts
from subloom.tokenizer import WordPieceTokenizer

Query = Callable[[SparkSession, str], DataFrame]
#: Frequent words and endings of the four languages, as pieces.
WORDS = (
    "the of and to in a is that for it on was with be as by are this at from or an not have he she they we you i der die das und zu den von mit ist im nicht ein eine auf sich des dem "
    "le la les de et un une du en que qui dans est pour pas sur au par plus el los las del y se por con una su para como al lo mas esta er th re rewh ha wh tion ing ed"
).split()
ENDINGS = "s ed ing er tion ly able ness es en an on in at or nd st sh ou ea ti nt he ha re th wh ch sch ung keit lich ment eau eux oi ou ai que cion mente ado ar os as ez ía".split()
_PUNCT = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
LINES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *"abcdefghijklmnopqrstuvwxyzß", *"0123456789", *_PUNCT, *("##" + c for c in "abcdefghijklmnopqrstuvwxyz0123456789"), *dict.fromkeys(w for w in WORDS if len(w) > 1), *("##" + e for e in dict.fromkeys(ENDINGS) if len(e) > 1)]


def vocabulary() -> Vocabulary:
    return Vocabulary.from_lines(LINES)


def tokenizer() -> WordPieceTokenizer:
    return WordPieceTokenizer(vocabulary())


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lean_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table read without vectored reads: those take a row group's whole column at once, through a direct buffer of that
    size that each thread keeps beside the heap."""
    return spark.read.option("parquet.hadoop.vectored.io.enabled", "false").parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "conv_id", "turn", "role", "text",
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return t.join(nxt, ["conv_id", "turn"])


def rows(
    df: DataFrame, enc: str = "encoding", keys: tuple[str, ...] = ("k",), fields: tuple[str, ...] = (),
) -> DataFrame:
    """A flat row for every token of an encoding column."""
    names = {
        "tokens": "token", "ids": "id", "type_ids": "type_id", "attention_mask": "attention",
        "special_tokens_mask": "special", "word_ids": "word_id", "sequence_ids": "sequence_id",
    }
    chosen = fields or (*names, "offsets")
    x = df.select(*keys, F.posexplode(F.arrays_zip(*[F.col(enc)[f].alias(f) for f in chosen])).alias("i", "x"))
    out = [F.col(f"x.{f}").alias(n) if f == "tokens" else F.col(f"x.{f}").cast("int").alias(n) for f, n in names.items() if f in chosen]
    if "offsets" in chosen:
        out += [F.col("x.offsets.start").alias("start"), F.col("x.offsets.end").alias("stop")]
    return x.select(*keys, "i", *out)


# SQL that encodes in DuckDB: characters are classed and grouped to words, distinct words walk their longest matches.


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _vocab_values() -> str:
    v = vocabulary()
    items = [(p, "false", i, p) for p in v.words if (i := v.words.lookup(p)) is not None] + [(p, "true", i, "##" + p) for p in v.continuations if (i := v.continuations.lookup(p)) is not None]
    return ", ".join(f"({_quoted(p)}, {c}, {i}, {_quoted(t)})" for p, c, i, t in items)


def _content_ctes(source: str, name: str = "tok", prefix: str = "") -> str:
    """CTEs that end with name(k, i, token, id, a, b, w): content tokens of source(k, text)."""
    longest = max(len(x) for x in LINES)
    p = prefix
    return f"""
{p}src AS ({source}),
{p}chars AS (SELECT k, unnest(string_split(t, '')) AS c, unnest(range(0, length(t))) AS p FROM (SELECT k, lower(strip_accents(text)) AS t FROM {p}src)),
{p}cls AS (SELECT k, p, c, CASE WHEN c IN (' ', chr(9), chr(10), chr(13)) THEN 0 WHEN regexp_matches(c, '[!-/:-@\\[-`{{-~]') THEN 2 ELSE 1 END AS z FROM {p}chars WHERE p IS NOT NULL),
{p}st AS (SELECT *, CASE WHEN z = 2 OR (z = 1 AND coalesce(lag(z) OVER (PARTITION BY k ORDER BY p), 0) <> 1) THEN 1 ELSE 0 END AS beg FROM {p}cls),
{p}wd AS (SELECT k, p, c, z, sum(beg) OVER (PARTITION BY k ORDER BY p ROWS UNBOUNDED PRECEDING) - 1 AS w FROM {p}st),
{p}word AS (SELECT k, w, string_agg(c, '' ORDER BY p) AS word, min(p) AS s FROM {p}wd WHERE z > 0 GROUP BY k, w),
{p}dw AS (SELECT DISTINCT word FROM {p}word),
{p}pos AS (SELECT word, unnest(range(0, length(word))) AS pos FROM {p}dw WHERE length(word) <= 200),
{p}sub AS (SELECT word, pos, unnest(range(1, least({longest}, length(word) - pos) + 1)) AS len FROM {p}pos),
{p}best AS (SELECT word, pos, max(len) AS len, arg_max(v.id, len) AS id, arg_max(v.token, len) AS token FROM {p}sub JOIN vocab v ON v.piece = substr(word, pos + 1, len) AND v.cont = (pos > 0) GROUP BY word, pos),
{p}walk(word, n, pos, len, id, token) AS (SELECT word, 0, pos, len, id, token FROM {p}best WHERE pos = 0
 UNION ALL SELECT b.word, w.n + 1, b.pos, b.len, b.id, b.token FROM {p}walk w JOIN {p}best b ON b.word = w.word AND b.pos = w.pos + w.len),
{p}steps AS (SELECT * FROM {p}walk),
{p}good AS (SELECT word FROM {p}steps GROUP BY word HAVING max(pos + len) = length(word)),
{p}pc AS (SELECT word, n, pos, len, id, token FROM {p}steps SEMI JOIN {p}good USING (word)
 UNION ALL SELECT word, 0, 0, length(word), 1, '[UNK]' FROM {p}dw ANTI JOIN {p}good USING (word)),
{name} AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY s, n) - 1 AS INTEGER) AS i, token, CAST(id AS INTEGER) AS id, CAST(s + pos AS INTEGER) AS a, CAST(s + pos + len AS INTEGER) AS b, CAST(w AS INTEGER) AS w FROM {p}word JOIN {p}pc USING (word)),
{name}n AS (SELECT s.k, CAST(count(t.k) AS INTEGER) AS n FROM {p}src s LEFT JOIN {name} t USING (k) GROUP BY s.k)"""


def _with(*ctes: str) -> str:
    """All tables but the recursive walk are computed once, however often they are named."""
    once = re.sub(r"(?m)^(\w+) AS \(", r"\1 AS MATERIALIZED (", ",".join(ctes))
    return f"WITH RECURSIVE vocab(piece, cont, id, token) AS MATERIALIZED (VALUES {_vocab_values()})," + once + "\n"


_TURNS = "SELECT conv_id * 1000 + turn AS k, text FROM conversations"
_ENC_COLUMNS = "k, CAST(i AS INTEGER) AS i, token, CAST(id AS INTEGER) AS id, CAST(ty AS INTEGER) AS type_id, CAST(att AS INTEGER) AS attention, CAST(sp AS INTEGER) AS special, CAST(w AS INTEGER) AS word_id, CAST(sq AS INTEGER) AS sequence_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS stop"


def _single_ctes(content: str = "tok", counts: str = "tokn", out: str = "enc") -> str:
    """out(k, i, ...): [CLS] A [SEP] from content and its counts."""
    return f"""
{out} AS (SELECT k, 0 AS i, '[CLS]' AS token, 2 AS id, 0 AS ty, 1 AS att, 1 AS sp, NULL AS w, NULL AS sq, 0 AS a, 0 AS b FROM {counts}
 UNION ALL SELECT k, i + 1, token, id, 0, 1, 0, w, 0, a, b FROM {content}
 UNION ALL SELECT k, n + 1, '[SEP]', 3, 0, 1, 1, NULL, NULL, 0, 0 FROM {counts})"""


def _cut_ctes(
    n: str, left: bool, content: str = "tok", counts: str = "tokn", out: str = "cut", limits: str = "",
) -> str:
    """Content and counts cut to n tokens, an expression over counts and what limits joins to it."""
    keep = "t.i >= c.n - m" if left else "t.i < m"
    move = "t.i - greatest(c.n - m, 0)" if left else "t.i"
    return f"""
{out}m AS (SELECT c.k, c.n, CAST({n} AS INTEGER) AS m FROM {counts} c{limits}),
{out} AS (SELECT t.k, CAST({move} AS INTEGER) AS i, token, id, a, b, w FROM {content} t JOIN {out}m c USING (k) WHERE {keep}),
{out}n AS (SELECT k, least(n, m) AS n FROM {out}m)"""


def _padded(target: str, left: bool = False) -> str:
    """enc padded to target (an expression over enclen(k, n, ...)), as the final SELECT."""
    return f"""
SELECT {_ENC_COLUMNS} FROM (
 SELECT k, i + {"greatest(g - n, 0)" if left else "0"} AS i, token, id, ty, att, sp, w, sq, a, b FROM enc JOIN (SELECT k, n, {target} AS g FROM enclen) USING (k)
 UNION ALL SELECT k, {"j" if left else "n + j"}, '[PAD]', 0, 0, 0, 1, NULL, NULL, 0, 0 FROM (SELECT k, n, unnest(range(0, greatest(g - n, 0))) AS j FROM (SELECT k, n, {target} AS g FROM enclen)))"""


_LEN = "\nenclen AS (SELECT k, count(*) AS n FROM enc GROUP BY k)"


def _single_sql(tail: str = f"SELECT {_ENC_COLUMNS} FROM enc", *more: str) -> str:
    return _with(_content_ctes(_TURNS), _single_ctes(), *more) + tail


def _encoded(change: Callable[[WordPieceTokenizer], WordPieceTokenizer] = lambda t: t) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: change(tokenizer()).encode(_turns(spark, d), "text")


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, run: Query, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


# whole documents


def wordpiece_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Token counts per language by a plan without Python. Accents and case, which change no boundary, wait for the distinct words."""
    docs = _table(spark, d, "documents").select(
        "lang", T.pieces(T.normalize("text", lower=False, accents=False)).alias("words"),
    )
    v = vocabulary()
    return token_counts(spark, docs, "words", v, v.unk_id, ["lang"], lambda w: T.lowercase(T.strip_accents(w)))


query("wordpiece_token_counts", wordpiece_token_counts, _with(_content_ctes("SELECT doc_id AS k, text FROM documents"), """
ww AS (SELECT k, count(*) AS n FROM word GROUP BY k)""") + """
SELECT lang, CAST(sum(nw) AS BIGINT) AS n_words, CAST(sum(nt) AS BIGINT) AS n_tokens, CAST(sum(nu) AS BIGINT) AS n_unk, CAST(sum(si) AS BIGINT) AS id_sum
FROM (SELECT doc_id, lang FROM documents) d JOIN (SELECT k, n AS nw FROM ww) a ON a.k = doc_id JOIN (SELECT k, count(*) AS nt, count(*) FILTER (id = 1) AS nu, sum(id) AS si FROM tok GROUP BY k) b ON b.k = doc_id GROUP BY lang""")


def encode_document_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every whole document by the ids-only kernel, as length, sum and position-weighted sum."""
    x = _table(spark, d, "documents").select("doc_id", tokenizer().ids("text").alias("ids"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, i: s + i)
    return x.select(
        "doc_id", F.size("ids").alias("n_tokens"), total("ids").alias("id_sum"),
        total(F.transform("ids", lambda v, i: v.cast("long") * (i % 97 + 1))).alias("weighted"),
    )


query("encode_document_ids", encode_document_ids, _with(_content_ctes("SELECT doc_id AS k, text FROM documents")) + """
SELECT k AS doc_id, n AS n_tokens, CAST(coalesce(sum(id), 0) AS BIGINT) AS id_sum, CAST(coalesce(sum(id * (i % 97 + 1)), 0) AS BIGINT) AS weighted FROM tokn LEFT JOIN tok USING (k) GROUP BY k, n""")
query("count_document_tokens", lambda s, d: _table(s, d, "documents").select("doc_id", tokenizer().count("text").alias("n_tokens")),
      _with(_content_ctes("SELECT doc_id AS k, text FROM documents")) + "SELECT k AS doc_id, n AS n_tokens FROM tokn")


def _text_query(name: str, f: Callable[[Column], Column], sql: str) -> None:
    query(name, lambda s, d: _table(s, d, "documents").select("doc_id", F.length(f(F.col("text"))).alias("n_chars"), F.md5(f(F.col("text"))).alias("digest")),
          f"SELECT doc_id, CAST(length(x) AS INTEGER) AS n_chars, md5(x) AS digest FROM (SELECT doc_id, {sql} AS x FROM documents)")


_text_query("clean_text", T.clean_text, "regexp_replace(text, '[\\t\\n\\r]', ' ', 'g')")
_text_query("lowercase", T.lowercase, "lower(text)")
_text_query("strip_accents", T.strip_accents, "strip_accents(text)")
_text_query("cjk_spacing", T.space_cjk, "regexp_replace(text, '([一-鿿㐀-䶿豈-﫿])', ' \\1 ', 'g')")
_text_query("normalize_text", T.normalize, "lower(strip_accents(regexp_replace(text, '[\\t\\n\\r]', ' ', 'g')))")
query("pretokenize_split", lambda s, d: _table(s, d, "documents").select("doc_id", T.pieces("text").alias("w")).select("doc_id", F.size("w").alias("n_pieces"), F.md5(F.array_join("w", " ")).alias("digest")),
      r"SELECT doc_id, CAST(len(w) AS INTEGER) AS n_pieces, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+') AS w FROM documents)")

# single texts

query("encode_single", lambda s, d: rows(_encoded()(s, d)), _single_sql())
query("encode_without_special", lambda s, d: rows(tokenizer().encode(_turns(s, d), "text", add_special_tokens=False)),
      _with(_content_ctes(_TURNS)) + f"SELECT {_ENC_COLUMNS} FROM (SELECT *, 0 AS ty, 1 AS att, 0 AS sp, 0 AS sq FROM tok)")
query(
    "encode_offsets", lambda s, d: rows(_encoded()(s, d), fields=("tokens", "offsets")),
    _single_sql("SELECT k, CAST(i AS INTEGER) AS i, token, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS stop FROM enc"),
)
query(
    "encode_word_ids", lambda s, d: rows(_encoded()(s, d), fields=("word_ids", "sequence_ids")),
    _single_sql("SELECT k, CAST(i AS INTEGER) AS i, CAST(w AS INTEGER) AS word_id, CAST(sq AS INTEGER) AS sequence_id FROM enc"),
)
query(
    "encode_parallel_batch", lambda s, d: rows(tokenizer().encode_batch(_turns(s, d), "text", num_workers=4)),
    _single_sql(),
)


def _sql_tokens(spark: SparkSession, d: str) -> DataFrame:
    sql_functions.register(spark, tokenizer())
    _turns(spark, d).createOrReplaceTempView("subloom_turns")
    return spark.sql("SELECT t.k, x.i, x.token, x.id, x.start, x.`end` AS stop, x.word_id FROM subloom_turns t, LATERAL wp_tokens(t.text) x")


query(
    "sql_table_function", _sql_tokens,
    _with(_content_ctes(_TURNS)) + "SELECT k, i, token, id, a AS start, b AS stop, w AS word_id FROM tok",
)

# truncation and padding

for _name, _left in (("truncate_right", False), ("truncate_left", True)):
    query(_name, lambda s, d, left=_left: rows(_encoded(lambda t: t.with_truncation(12, "left" if left else "right"))(s, d)),
          _with(_content_ctes(_TURNS), _cut_ctes("10", _left), _single_ctes("cut", "cutn")) + f"SELECT {_ENC_COLUMNS} FROM enc")
query(
    "truncate_finished", lambda s, d: rows(_encoded()(s, d).withColumn("encoding", E.truncate("encoding", 7))),
    _single_sql(f"SELECT {_ENC_COLUMNS} FROM enc WHERE i < 7"),
)
query(
    "pad_fixed_right", lambda s, d: rows(_encoded(lambda t: t.with_padding(64))(s, d)), _single_sql(_padded("64"), _LEN),
)
query(
    "pad_fixed_left", lambda s, d: rows(_encoded(lambda t: t.with_padding(64, direction="left"))(s, d)),
    _single_sql(_padded("64", True), _LEN),
)
query(
    "pad_to_multiple", lambda s, d: rows(_encoded(lambda t: t.with_padding(multiple=16))(s, d)),
    _single_sql(_padded("CAST(ceil(n / 16.0) * 16 AS BIGINT)"), _LEN),
)
query(
    "pad_fixed_and_multiple", lambda s, d: rows(_encoded(lambda t: t.with_padding(50, 8))(s, d)),
    _single_sql(_padded("CAST(ceil(greatest(n, 50) / 8.0) * 8 AS BIGINT)"), _LEN),
)
query(
    "pad_batch_longest", lambda s, d: rows(tokenizer().with_padding().encode_batch(_turns(s, d), "text", "conv_id")),
    _single_sql(_padded("max(n) OVER (PARTITION BY k // 1000)"), _LEN),
)
query("pad_batch_whole_table", lambda s, d: rows(tokenizer().with_padding(multiple=8).with_truncation(30).encode_batch(_turns(s, d), "text"), fields=("ids", "attention_mask")),
      _with(_content_ctes(_TURNS), _cut_ctes("28", False), _single_ctes("cut", "cutn"), _LEN) + f"SELECT k, i, id, attention FROM ({_padded('CAST(ceil(max(n) OVER () / 8.0) * 8 AS BIGINT)')})")

# pairs

_PAIR_A = "SELECT x.conv_id * 1000 + x.turn AS k, x.text FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1"
_PAIR_B = _PAIR_A.replace("x.text", "y.text")


def _pair_ctes(a: str = "ta", b: str = "tb") -> str:
    return f"""
enc AS (SELECT k, 0 AS i, '[CLS]' AS token, 2 AS id, 0 AS ty, 1 AS att, 1 AS sp, NULL AS w, NULL AS sq, 0 AS a, 0 AS b FROM {a}n
 UNION ALL SELECT k, i + 1, token, id, 0, 1, 0, w, 0, a, b FROM {a}
 UNION ALL SELECT k, n + 1, '[SEP]', 3, 0, 1, 1, NULL, NULL, 0, 0 FROM {a}n
 UNION ALL SELECT k, i + 2 + x.n, token, id, 1, 1, 0, w, 1, a, b FROM {b} JOIN {a}n x USING (k)
 UNION ALL SELECT k, x.n + y.n + 2, '[SEP]', 3, 1, 1, 1, NULL, NULL, 0, 0 FROM {a}n x JOIN {b}n y USING (k))"""


_PAIR_CONTENT = (_content_ctes(_PAIR_A, "ta", "pa_"), _content_ctes(_PAIR_B, "tb", "pb_"))


def _pair_cut(strategy: str, limit: int, left: bool) -> tuple[str, ...]:
    """Both contents cut: longest first takes tokens one at a time from the longer, which leaves these lengths. The other
    strategies cut one text alone, and only pairs are asked for whose other text leaves it a token."""
    v = limit - 3
    some = "true"
    if strategy == "longest_first":
        s = f"least(na, nb, {v} // 2)"
        na, nb = f"CASE WHEN na <= nb THEN {s} ELSE {v} - {s} END", f"CASE WHEN na <= nb THEN {v} - {s} ELSE {s} END"
    else:
        na, nb = (f"{v} - nb", "nb") if strategy == "only_first" else ("na", f"{v} - na")
        some = f"{'nb' if strategy == 'only_first' else 'na'} < {v}"
    lim = f"""
lim AS (SELECT k, CASE WHEN na + nb <= {v} THEN na ELSE {na} END AS ca, CASE WHEN na + nb <= {v} THEN nb ELSE {nb} END AS cb
 FROM (SELECT x.k, x.n AS na, y.n AS nb FROM tan x JOIN tbn y USING (k)) WHERE {some})"""
    return lim, _cut_ctes("ca", left, "ta", "tan", "xa", " JOIN lim USING (k)"), _cut_ctes(
        "cb", left, "tb", "tbn", "xb", " JOIN lim USING (k)",
    )


def _cut_pairs(strategy: str, limit: int, left: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        pairs, t = _pairs(spark, d), tokenizer()
        if strategy != "longest_first":  # a text that alone fills the limit leaves nothing of the other, which is an error
            pairs = pairs.where(t.count("reply" if strategy == "only_first" else "text") < limit - 3)
        return rows(t.with_truncation(limit, "left" if left else "right", strategy).encode_pair(pairs, "text", "reply"))

    return run


query(
    "encode_pair", lambda s, d: rows(tokenizer().encode_pair(_pairs(s, d), "text", "reply")),
    _with(*_PAIR_CONTENT, _pair_ctes()) + f"SELECT {_ENC_COLUMNS} FROM enc",
)
for _strategy, _limit, _left in (
    ("longest_first", 32, False), ("longest_first", 33, True), ("only_first", 300, False), ("only_first", 260, True),
    ("only_second", 300, True), ("only_second", 260, False),
):
    _name = f"truncate_pair_{_strategy}" + ("_left" if _left else "")
    _sql = _with(*_PAIR_CONTENT, *_pair_cut(_strategy, _limit, _left), _pair_ctes("xa", "xb")) + f"SELECT {_ENC_COLUMNS} FROM enc"
    query(_name, _cut_pairs(_strategy, _limit, _left), _sql)
query(
    "truncate_pair_do_not_truncate", lambda s,
    d: rows(tokenizer().with_truncation(8, strategy="do_not_truncate").encode_pair(_pairs(s, d), "text", "reply")),
    ORACLES["encode_pair"],
)
query("encode_pair_batch", lambda s, d: rows(tokenizer().with_padding().encode_pair_batch(_pairs(s, d), "text", "reply", "conv_id", num_workers=3)),
      _with(*_PAIR_CONTENT, _pair_ctes(), _LEN) + _padded("max(n) OVER (PARTITION BY k // 1000)"))
query("n_sequences", lambda s, d: tokenizer().encode_pair(_pairs(s, d), "text", "reply").select("k", E.n_sequences("encoding").alias("n_sequences")),
      _with(*_PAIR_CONTENT) + "SELECT x.k, CASE WHEN y.n > 0 THEN 2 WHEN x.n > 0 THEN 1 ELSE 0 END AS n_sequences FROM tan x JOIN tbn y USING (k)")

# words

_ITEMS = "SELECT k * 10000 + j AS k, word AS text FROM (SELECT conv_id * 1000 + turn AS k, unnest(string_split(text, ' ')) AS word, unnest(range(0, len(string_split(text, ' ')))) AS j FROM conversations)"
_WORD_ENC = """
flat AS (SELECT k // 10000 AS k, row_number() OVER (PARTITION BY k // 10000 ORDER BY k, i) - 1 AS i, token, id, a, b, k % 10000 AS w FROM tok),
flatn AS (SELECT x.k, count(f.k) AS n FROM (SELECT DISTINCT k // 10000 AS k FROM src) x LEFT JOIN flat f USING (k) GROUP BY x.k)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).withColumn("words", F.split("text", " ", -1))


query(
    "encode_pretokenized", lambda s, d: rows(tokenizer().encode_pretokenized(_words(s, d), "words")),
    _with(_content_ctes(_ITEMS), _WORD_ENC, _single_ctes("flat", "flatn")) + f"SELECT {_ENC_COLUMNS} FROM enc",
)
query("encode_pretokenized_pair", lambda s, d: rows(tokenizer().encode_pretokenized_pair(_words(s, d), "words", "words"), fields=("ids", "type_ids", "word_ids", "sequence_ids")),
      _with(_content_ctes(_ITEMS), _WORD_ENC, _pair_ctes("flat", "flat")) + "SELECT k, CAST(i AS INTEGER) AS i, CAST(id AS INTEGER) AS id, CAST(ty AS INTEGER) AS type_id, CAST(w AS INTEGER) AS word_id, CAST(sq AS INTEGER) AS sequence_id FROM enc")


_PADDED_IDS = f"SELECT k, i, id, attention FROM ({_padded('CAST(ceil(n / 8.0) * 8 AS BIGINT)')})"
query("encode_pretokenized_batch", lambda s, d: rows(tokenizer().with_padding(10, 8).encode_batch(_words(s, d), "words", pretokenized=True, num_workers=2), fields=("ids", "attention_mask")),
      _with(_content_ctes(_ITEMS), _WORD_ENC, _single_ctes("flat", "flatn"), _LEN) + _PADDED_IDS.replace("ceil(n", "ceil(greatest(n, 10)"))
query("encode_pretokenized_pair_batch", lambda s, d: rows(tokenizer().with_padding(8, 8).encode_pair_batch(_words(s, d), "words", "words", pretokenized=True, num_workers=2), fields=("ids", "attention_mask")),
      _with(_content_ctes(_ITEMS), _WORD_ENC, _pair_ctes("flat", "flat"), _LEN) + _PADDED_IDS)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    x = tokenizer().encode_pretokenized(_words(spark, d), "words").withColumn(
        "labels", F.transform("words", lambda w, i: i % 7),
    )
    return x.select("k", F.posexplode(E.label_tokens("encoding", "labels")).alias("i", "label"))


query(
    "label_tokens", _labels,
    _with(_content_ctes(_ITEMS), _WORD_ENC, _single_ctes("flat", "flatn")) + "SELECT k, CAST(i AS INTEGER) AS i, CAST(CASE WHEN w IS NULL OR w = lag(w) OVER (PARTITION BY k ORDER BY i) THEN -100 ELSE w % 7 END AS INTEGER) AS label FROM enc",
)

# decoding and lookups

query("decode_skip_special", lambda s, d: _encoded()(s, d).select("k", tokenizer().decode("encoding.ids").alias("decoded")),
      _with(_content_ctes(_TURNS)) + "SELECT k, coalesce(string_agg(CASE WHEN token LIKE '##%' AND length(token) > 2 THEN substr(token, 3) WHEN i = first THEN token ELSE ' ' || token END, '' ORDER BY i), '') AS decoded FROM tokn LEFT JOIN (SELECT *, min(i) OVER (PARTITION BY k) AS first FROM tok WHERE id > 4) USING (k) GROUP BY k")
query("decode_with_special", lambda s, d: _encoded()(s, d).select("k", tokenizer().decode("encoding.ids", False).alias("decoded")),
      _single_sql("SELECT k, string_agg(CASE WHEN token LIKE '##%' THEN substr(token, 3) WHEN i = 0 THEN token ELSE ' ' || token END, '' ORDER BY i) AS decoded FROM enc GROUP BY k"))
query("tokens_to_ids", lambda s, d: _turns(s, d).select("k", F.split("text", " ", -1).alias("t")).select("k", F.posexplode(F.arrays_zip("t", tokenizer().tokens_to_ids("t").alias("ids"))).alias("i", "x")).select("k", "i", F.col("x.t").alias("token"), F.col("x.ids").alias("id")),
      f"WITH vocab(piece, cont, id, token) AS (VALUES {_vocab_values()}, ('', false, 0, '[PAD]'), ('', false, 1, '[UNK]'), ('', false, 2, '[CLS]'), ('', false, 3, '[SEP]'), ('', false, 4, '[MASK]')) SELECT k, CAST(i AS INTEGER) AS i, x.token, coalesce(id, 1) AS id FROM (SELECT conv_id * 1000 + turn AS k, unnest(string_split(text, ' ')) AS token, unnest(range(0, len(string_split(text, ' ')))) AS i FROM conversations) x LEFT JOIN vocab USING (token)")
query("ids_to_tokens", lambda s, d: _table(s, d, "part").select("p_partkey", F.get(tokenizer().ids_to_tokens(F.array((F.col("p_partkey") % 300).cast("int"))), F.lit(0)).alias("token")),
      f"WITH vocab(id, token) AS (VALUES {', '.join(f'({i}, {_quoted(t)})' for i, t in enumerate(LINES))}) SELECT p_partkey, coalesce(token, '[UNK]') AS token FROM part LEFT JOIN vocab ON id = p_partkey % 300")
query("vocabulary_rows", lambda s, d: vocabulary().dataframe(s), f"SELECT t AS token, CAST(i AS INTEGER) AS id, CASE WHEN t LIKE '##%' THEN substr(t, 3) ELSE t END AS piece, t LIKE '##%' AS is_continuation FROM (VALUES {', '.join(f'({i}, {_quoted(t)})' for i, t in enumerate(LINES))}) v(i, t)")


def _prefixes(spark: SparkSession, d: str) -> DataFrame:
    words = _table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return prefixes(spark, words, "word", vocabulary()).select("word", "piece", "id", "end")


_PART_WORDS = "SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part"
query(
    "all_prefixes", _prefixes,
    f'WITH vocab(piece, cont, id, token) AS (VALUES {_vocab_values()}), w AS ({_PART_WORDS}) SELECT word, piece, id, CAST(length(piece) AS INTEGER) AS "end" FROM w JOIN vocab ON starts_with(word, piece) AND NOT cont',
)
query("longest_prefix", lambda s, d: _prefixes(s, d).groupBy("word").agg(F.max(F.struct("end", "piece", "id")).alias("m")).select("word", "m.piece", "m.id", "m.end"),
      f'WITH vocab(piece, cont, id, token) AS (VALUES {_vocab_values()}), w AS ({_PART_WORDS}) SELECT word, arg_max(piece, length(piece)) AS piece, arg_max(id, length(piece)) AS id, CAST(max(length(piece)) AS INTEGER) AS "end" FROM w JOIN vocab ON starts_with(word, piece) AND NOT cont GROUP BY word')

# alignment

query("char_to_token", lambda s, d: _encoded()(s, d).select("k", E.char_to_token("encoding", 10).alias("token_no"), E.char_to_word("encoding", 10).alias("word_no")),
      _with(_content_ctes(_TURNS)) + "SELECT k, CAST(min(i) FILTER (a <= 10 AND b > 10) + 1 AS INTEGER) AS token_no, CAST(min(w) FILTER (a <= 10 AND b > 10) AS INTEGER) AS word_no FROM tokn LEFT JOIN tok USING (k) GROUP BY k")
query("token_to_chars", lambda s, d: _encoded()(s, d).select("k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), E.token_to_chars("encoding", i).alias("o"), E.token_to_word("encoding", i).alias("word_id"), E.token_to_sequence("encoding", i).alias("sequence_id")) for i in (-1, 0, 1, 5)])).alias("x")).select("k", "x.i", F.col("x.o.start").alias("start"), F.col("x.o.end").alias("stop"), "x.word_id", "x.sequence_id"),
      _single_sql("SELECT q.k, q.i, CAST(CASE WHEN sp = 0 THEN a END AS INTEGER) AS start, CAST(CASE WHEN sp = 0 THEN b END AS INTEGER) AS stop, CAST(w AS INTEGER) AS word_id, CAST(sq AS INTEGER) AS sequence_id FROM (SELECT k, unnest([-1, 0, 1, 5]) AS i FROM tokn) q LEFT JOIN enc ON enc.k = q.k AND enc.i = q.i"))
query("word_to_chars", lambda s, d: _encoded()(s, d).select("k", E.word_to_chars("encoding", 3).alias("c"), E.word_to_tokens("encoding", 3).alias("t")).select("k", F.col("c.start").alias("start"), F.col("c.end").alias("stop"), F.col("t.start").alias("token_start"), F.col("t.end").alias("token_stop")),
      _with(_content_ctes(_TURNS)) + "SELECT k, CAST(min(a) FILTER (w = 3) AS INTEGER) AS start, CAST(max(b) FILTER (w = 3) AS INTEGER) AS stop, CAST(min(i) FILTER (w = 3) + 1 AS INTEGER) AS token_start, CAST(max(i) FILTER (w = 3) + 2 AS INTEGER) AS token_stop FROM tokn LEFT JOIN tok USING (k) GROUP BY k")
query("merge_encodings", lambda s, d: rows(merge_groups(_encoded()(s, d), ["conv_id"], "turn", "encoding"), keys=("conv_id",), fields=("tokens", "ids", "word_ids", "offsets")),
      _single_sql("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY enc.k, i) - 1 AS INTEGER) AS i, token, CAST(id AS INTEGER) AS id, CAST(w + dw AS INTEGER) AS word_id,
CAST(CASE WHEN a = 0 AND b = 0 THEN 0 ELSE a + dc END AS INTEGER) AS start, CAST(CASE WHEN a = 0 AND b = 0 THEN 0 ELSE b + dc END AS INTEGER) AS stop
FROM enc JOIN sh USING (k)""", """
ext AS (SELECT k, k // 1000 AS conv_id, coalesce(max(b), 0) AS mc, coalesce(max(w), 0) + 1 AS mw FROM enc GROUP BY k),
sh AS (SELECT k, conv_id, coalesce(sum(mc) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dc, coalesce(sum(mw) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dw FROM ext)"""))  # fmt: skip


def _json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the JSON text, read back."""
    x = _encoded()(spark, d)
    text = x.select("k", E.to_json("encoding").alias("j"))
    return rows(text.select("k", F.from_json("j", x.schema["encoding"].dataType).alias("encoding")))


query("encoding_to_json", _json_round_trip, _single_sql())

# added tokens that are no pieces, so that their id stands for nothing else


def _added(token: AddedToken, of_null: int | None = None) -> Query:
    """Number and places of an added token in every document; of_null: the number where the text is null."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t, _ = tokenizer().add_tokens([token])
        x = t.encode(
            _lean_table(spark, d, "documents").select(F.col("doc_id").alias("k"), "text"), "text", add_special_tokens=False,
        )
        new = t.vocab.token_to_id(token.content)
        hit = F.filter(
            F.arrays_zip(F.col("encoding.ids").alias("id"), F.col("encoding.offsets").alias("o")), lambda x: x["id"] == new,
        )
        x = x.select("k", hit.alias("hit"))  # a column of its own, so that it is found once for both
        return x.select(
            "k", F.coalesce(F.size("hit"), F.lit(of_null)).alias("n"),
            F.coalesce(F.aggregate("hit", F.lit(0).cast("long"), lambda a, h: a + h["o"]["start"] * 3 + h["o"]["end"]), F.lit(0)).alias("places"),
        )

    return run


def _added_sql(pattern: str, group: int, text: str = "text") -> str:
    """Places of a literal from the texts between its matches."""
    return f"""
SELECT doc_id AS k, CAST(len(m) AS INTEGER) AS n, CAST(coalesce((SELECT sum(3 * s + e) FROM (
  SELECT sum(length(g)) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) + coalesce(sum(length(h)) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
         sum(length(g)) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) + sum(length(h)) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) AS e
  FROM (SELECT unnest(p[1:len(m)]) AS g, unnest(m) AS h, unnest(range(0, len(m))) AS j))), 0) AS BIGINT) AS places
FROM (SELECT doc_id, regexp_extract_all({text}, '{pattern}', {group}) AS m, regexp_split_to_array({text}, '{pattern}') AS p FROM documents)"""


query("added_token_raw", _added(AddedToken("ation", normalized=False)), _added_sql("ation", 0))
query("added_token_single_word", _added(AddedToken("then", single_word=True, normalized=False), of_null=0), """
WITH p AS MATERIALIZED (SELECT doc_id, string_split(text, 'then') AS p FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(p) AS g, unnest(range(0, len(p))) AS j FROM p),
h AS (SELECT doc_id, j, g, lead(g) OVER w AS g2, lead(j, 2) OVER w IS NOT NULL AS more, sum(length(g)) OVER w + 4 * j AS s FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
m AS (SELECT doc_id, s FROM h WHERE g2 IS NOT NULL AND NOT regexp_matches(
  right(CASE WHEN g <> '' THEN g WHEN j > 0 THEN 'n' ELSE ' ' END, 1) || left(CASE WHEN g2 <> '' THEN g2 WHEN more THEN 't' ELSE ' ' END, 1), '[\\p{L}\\p{M}\\p{Nd}_]'))
SELECT doc_id AS k, CAST(count(s) AS INTEGER) AS n, CAST(coalesce(sum(4 * s + 4), 0) AS BIGINT) AS places FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
query(
    "added_token_strip", _added(AddedToken("then", lstrip=True, rstrip=True, normalized=False)),
    _added_sql("[ \\t\\n\\r]*then[ \\t\\n\\r]*", 0),
)
query(
    "added_token_normalized", _added(AddedToken("ÉAU", normalized=True)),
    _added_sql("eau", 0, "lower(strip_accents(text))"),
)


def _added_special(spark: SparkSession, d: str) -> DataFrame:
    """A special token of our own: found as it is written, and left out by decoding."""
    t, _ = tokenizer().add_special_tokens(["<then>"])
    x = _turns(spark, d).withColumn("text", F.replace("text", F.lit(" then "), F.lit("<then>")))
    x = t.encode(x, "text", add_special_tokens=False)
    new = t.vocab.token_to_id("<then>")
    return x.select(
        "k", F.size(F.filter("encoding.ids", lambda i: i == new)).alias("n"),
        F.contains(t.decode("encoding.ids"), F.lit("then>")).alias("shown"),
    )


query(
    "added_special_token", _added_special,
    "SELECT conv_id * 1000 + turn AS k, CAST(len(string_split(text, ' then ')) - 1 AS INTEGER) AS n, false AS shown FROM conversations",
)

# a tokenizer.json with its own template, cleanup and padding


def json_settings() -> dict:
    ids = {t: i for i, t in enumerate(LINES)}
    return {
        "model": {"type": "WordPiece", "vocab": ids, "unk_token": "[UNK]", "continuing_subword_prefix": "##", "max_input_chars_per_word": 200},
        "normalizer": {
            "type": "BertNormalizer", "clean_text": True, "handle_chinese_chars": True, "strip_accents": None,
            "lowercase": True,
        },
        "pre_tokenizer": {"type": "BertPreTokenizer"},
        "post_processor": {"type": "BertProcessing", "cls": ["[CLS]", 2], "sep": ["[SEP]", 3]},
        "decoder": {"type": "WordPiece", "prefix": "##", "cleanup": True},
        "added_tokens": [{"id": i, "content": t, "special": True, "normalized": False} for i, t in enumerate(LINES[:5])],
        "truncation": None, "padding": None,
    }


def json_tokenizer(config: WordPieceConfig | None = None, **changes) -> WordPieceTokenizer:
    return WordPieceTokenizer.from_tokenizer_json_string(json.dumps(json_settings() | changes), config)


query("json_encode", lambda s, d: rows(json_tokenizer().encode(_turns(s, d), "text")), ORACLES["encode_single"])


def _stored(spark: SparkSession, text: str) -> str:
    """The path of a file with this text in the shared folder."""
    path = f"{_shared(spark)}/file-{uuid.uuid4().hex}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


query(
    "vocab_file_encode", lambda s,
    d: rows(WordPieceTokenizer.from_vocab_file(_stored(s, "\n".join(LINES)), s).encode(_turns(s, d), "text")),
    ORACLES["encode_single"],
)
query(
    "json_file_encode", lambda s,
    d: rows(WordPieceTokenizer.from_tokenizer_json(_stored(s, json.dumps(json_settings())), s).encode(_turns(s, d), "text")),
    ORACLES["encode_single"],
)
query("vocabulary_from_string", lambda s, d: Vocabulary.from_string("b \n\n##a\r\nab\nb\n[X]\n").dataframe(s).select("token", "id"),
      "SELECT token, CAST(id AS INTEGER) AS id FROM (VALUES ('##a', 2), ('ab', 3), ('b', 4), ('[X]', 5)) v(token, id)")

#: B before A, with types of their own, and one separator.
_TEMPLATE = {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "[CLS]", "type_id": 3}}, {"Sequence": {"id": "A", "type_id": 0}}],
             "pair": [
                 {"Sequence": {"id": "B", "type_id": 2}}, {"SpecialToken": {"id": "[SEP]", "type_id": 4}},
                 {"Sequence": {"id": "A", "type_id": 5}},
             ],
             "special_tokens": {t: {"id": t, "ids": [i], "tokens": [t]} for t, i in (("[CLS]", 2), ("[SEP]", 3))}}
query("json_template_pair", lambda s, d: rows(json_tokenizer(post_processor=_TEMPLATE).encode_pair(_pairs(s, d), "text", "reply")), _with(*_PAIR_CONTENT, """
enc AS (SELECT k, i, token, id, 2 AS ty, 1 AS att, 0 AS sp, w, 1 AS sq, a, b FROM tb
 UNION ALL SELECT k, n, '[SEP]', 3, 4, 1, 1, NULL, NULL, 0, 0 FROM tbn
 UNION ALL SELECT k, i + 1 + y.n, token, id, 5, 1, 0, w, 0, a, b FROM ta JOIN tbn y USING (k))""") + f"SELECT {_ENC_COLUMNS} FROM enc")
query("json_without_processor_pair", lambda s, d: rows(json_tokenizer(post_processor=None).encode_pair(_pairs(s, d), "text", "reply")), _with(*_PAIR_CONTENT, """
enc AS (SELECT k, i, token, id, 0 AS ty, 1 AS att, 0 AS sp, w, 0 AS sq, a, b FROM ta
 UNION ALL SELECT k, i + x.n, token, id, 1, 1, 0, w, 1, a, b FROM tb JOIN tan x USING (k))""") + f"SELECT {_ENC_COLUMNS} FROM enc")
query(
    "json_config_override", lambda s,
    d: rows(json_tokenizer(WordPieceConfig(), post_processor=_TEMPLATE).encode(_turns(s, d), "text")),
    ORACLES["encode_single"],
)
query("decode_without_decoder", lambda s, d: json_tokenizer(decoder=None).encode(_turns(s, d), "text").select("k", json_tokenizer(decoder=None).decode("encoding.ids").alias("decoded")),
      _with(_content_ctes(_TURNS)) + "SELECT k, coalesce(string_agg(token, ' ' ORDER BY i) FILTER (id > 4), '') AS decoded FROM tokn LEFT JOIN tok USING (k) GROUP BY k")


def _shared(spark: SparkSession) -> str:
    """A folder that the driver and all executors see; on a local master one of our own will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or f"file://{tempfile.mkdtemp(prefix='subloom-')}").rstrip("/")


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The turns encoded as a stream into a table in the shared folder, all that is there in one go."""
    at = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    turns = read_texts(spark, d, "conv_id long, turn long, role string, text string", glob="conversations.parquet")
    out = encode_stream(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text"), tokenizer(), "text").select("k", "encoding")
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return rows(spark.read.schema(out.schema).parquet(f"{at}/out"))


query("streaming_encode", _streamed, ORACLES["encode_single"])
query("decode_cleanup", lambda s, d: json_tokenizer().encode(_turns(s, d), "text").select("k", json_tokenizer().decode("encoding.ids").alias("decoded")),
      _with(_content_ctes(_TURNS)) + "SELECT k, coalesce(string_agg(CASE WHEN i = first THEN token WHEN token LIKE '##%' THEN substr(token, 3) WHEN token IN ('.', '?', '!', ',') THEN token ELSE ' ' || token END, '' ORDER BY i), '') AS decoded FROM tokn LEFT JOIN (SELECT *, min(i) OVER (PARTITION BY k) AS first FROM tok WHERE id > 4) USING (k) GROUP BY k")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_token_counts(spark, sf_dir)
