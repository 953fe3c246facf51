"""Encodings as columns: templates, truncation, padding, decoding, alignment, merging, streaming and SQL."""

import itertools
import random
import re
import shutil
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from subloom import queries
from subloom.config import AddedToken, Normalizer
from subloom.functions import encoding as E
from subloom.functions import sql as sql_functions
from subloom.functions import text as T
from subloom.operators.encode import content_udf
from subloom.operators.kernel import normalize
from subloom.operators.merge import merge_groups
from subloom.plans.lattice import token_counts, walked, word_pieces
from subloom.sources.vocabulary import Vocabulary
from subloom.streaming.encode import encode_batches, encode_stream, read_texts
from subloom.tokenizer import WordPieceTokenizer

LINES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *"nomei;", *("##" + x for x in "nome"), "mono", "##non", "##;", "omen", "##i"]
FIELDS = ("tokens", "ids", "type_ids", "attention_mask", "special_tokens_mask", "offsets", "word_ids", "sequence_ids")


def texts(seed, n=24):
    rng = random.Random(seed)
    return [None, "", *("".join(rng.choice("nomeii; é?") for _ in range(rng.randrange(1, 18))) for _ in range(n))]


@pytest.fixture(scope="module")
def t():
    return WordPieceTokenizer(Vocabulary.from_tokens(LINES))


@pytest.fixture(scope="module")
def df(spark):
    rows = [(k, a, b, None if a is None else a.split(" ")) for k, (a, b) in enumerate(zip(texts(1), reversed(texts(2)), strict=True))]
    return spark.createDataFrame(rows, "k long, t string, u string, w array<string>")


# the slow side: encodings as lists of (token, id, type, attention, special, (start, end), word, sequence)


def special(t, token, type_id):
    return (token, t.vocab.special_id(token), type_id, 1, 1, (0, 0), None, None)


def content(c, type_id=0, sequence=0):
    return [(tok, i, type_id, 1, 0, (a, b), w, sequence) for tok, i, a, b, w in zip(*c, strict=True)]


def slow_single(t, c):
    return [special(t, "[CLS]", 0), *content(c), special(t, "[SEP]", 0)]


def slow_pair(t, c, d):
    return [*slow_single(t, c), *content(d, 1, 1), special(t, "[SEP]", 1)]


def cut(c, n, direction="right"):
    return tuple(x[:n] if direction == "right" else x[max(0, len(x) - n) :] for x in c)


def padded(x, n, direction="right"):
    fill = [("[PAD]", 0, 0, 0, 1, (0, 0), None, None)] * max(0, n - len(x))
    return fill + x if direction == "left" else x + fill


def seen(df, col="encoding", key="k"):
    out = {}
    for r in df.select(key, col).collect():
        e = r[col]
        out[r[key]] = None if e is None else [tuple(tuple(v) if f == "offsets" else v for f, v in zip(FIELDS, x, strict=True)) for x in zip(*(e[f] for f in FIELDS), strict=True)]
    return out


def inputs(df):
    return {r.k: r for r in df.collect()}


def test_singles_pairs_and_words(t, df):
    k, rows = t.kernel(), inputs(df)
    assert seen(t.encode(df, "t")) == {i: None if r.t is None else slow_single(t, k.content(r.t)) for i, r in rows.items()}
    assert seen(t.encode(df, "t", add_special_tokens=False)) == {i: None if r.t is None else content(k.content(r.t)) for i, r in rows.items()}
    assert seen(t.encode_pair(df, "t", "u")) == {i: None if r.t is None or r.u is None else slow_pair(t, k.content(r.t), k.content(r.u)) for i, r in rows.items()}
    assert seen(t.encode_pretokenized(df, "w")) == {i: None if r.w is None else slow_single(t, k.words_content(r.w)) for i, r in rows.items()}
    assert seen(t.encode_pretokenized_pair(df, "w", "w")) == {i: None if r.w is None else slow_pair(t, k.words_content(r.w), k.words_content(r.w)) for i, r in rows.items()}
    assert t.encode(df, "t").schema["encoding"].dataType.simpleString() == E.SCHEMA


def test_limits_that_cannot_hold_the_special_tokens_fail_before_any_row(t, df):
    for f in (lambda: t.with_truncation(1).encode(df, "t"), lambda: t.with_truncation(2).encode_pair(df, "t", "u"), lambda: t.encode_batch(df, "t", num_workers=0)):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize(("n", "direction"), [(2, "right"), (5, "right"), (5, "left"), (30, "left")])
def test_truncation_keeps_the_asked_end(t, df, n, direction):
    k, rows = t.kernel(), inputs(df)
    want = {i: None if r.t is None else slow_single(t, cut(k.content(r.t), n - 2, direction)) for i, r in rows.items()}
    assert seen(t.with_truncation(n, direction).encode(df, "t")) == want
    e = seen(t.encode(df, "t").withColumn("encoding", E.truncate("encoding", n, direction)))
    assert e == {i: None if r.t is None else (slow_single(t, k.content(r.t))[:n] if direction == "right" else slow_single(t, k.content(r.t))[-n:]) for i, r in rows.items()}


def iterative(a, b, avail):
    a0, b0 = a, b
    while a + b > avail:
        if a > b or (a == b and a0 > b0):
            a -= 1
        elif b > a or a0 <= b0:
            b -= 1
    return a, b


def test_longest_first_equals_taking_one_token_at_a_time(spark):
    rows = [(a, b, m) for a, b, m in itertools.product(range(9), range(9), range(1, 18))]
    d = spark.createDataFrame(rows, "a int, b int, m int")
    na, nb = E.pair_lengths(F.col("a"), F.col("b"), F.col("m"), 0, "longest_first")
    for r in d.select("a", "b", "m", na.alias("na"), nb.alias("nb")).collect():
        total = min(r.a + r.b, r.m)
        assert r.na + r.nb == total and r.na <= r.a and r.nb <= r.b
        assert sorted((r.na, r.nb)) == sorted(iterative(r.a, r.b, r.m))


@pytest.mark.parametrize("direction", ["right", "left"])
def test_only_one_sequence_gives_way(t, df, direction):
    k = t.kernel()
    some = df.where("t is not null and u is not null")
    rows, lim = inputs(some), 12
    sizes = {i: (len(k.content(r.t)[0]), len(k.content(r.u)[0])) for i, r in rows.items()}
    for strategy, other in (("only_first", 1), ("only_second", 0)):
        fit = [i for i, n in sizes.items() if sum(n) <= lim - 3 or n[other] < lim - 3]
        got = seen(t.with_truncation(lim, direction, strategy).encode_pair(some.where(F.col("k").isin(fit)), "t", "u"))
        want = {}
        for i in fit:
            c = [k.content(rows[i].t), k.content(rows[i].u)]
            if sum(sizes[i]) > lim - 3:
                c[1 - other] = cut(c[1 - other], lim - 3 - sizes[i][other], direction)
            want[i] = slow_pair(t, *c)
        assert got == want and any(sum(sizes[i]) > lim - 3 for i in fit)
        over = [i for i, n in sizes.items() if n[other] >= lim - 3 and sum(n) > lim - 3]
        assert over
        with pytest.raises(Exception, match="too short"):
            t.with_truncation(lim, direction, strategy).encode_pair(some.where(F.col("k").isin(over)), "t", "u").collect()
    none = seen(t.encode_pair(some, "t", "u", max_length=3))
    assert all(v == [special(t, "[CLS]", 0), special(t, "[SEP]", 0), special(t, "[SEP]", 1)] for v in none.values())


@pytest.mark.parametrize(("length", "multiple", "direction"), [(9, None, "left"), (9, None, "right"), (7, 4, "left"), (None, 8, "right")])
def test_padding_to_a_length(t, df, length, multiple, direction):
    rows = seen(t.encode(df, "t"))
    top = lambda n: -(-max(n, length or 0) // (multiple or 1)) * (multiple or 1)
    got = seen(t.with_padding(length, multiple, direction).encode(df, "t"))
    assert got == {i: None if x is None else padded(x, top(len(x)), direction) for i, x in rows.items()}


def test_padding_to_the_longest_of_a_batch(t, df):
    d = df.withColumn("g", F.col("k") % 3)
    rows = seen(t.encode(d, "t"))
    most = {g: max(len(x) for i, x in rows.items() if i % 3 == g and x is not None) for g in range(3)}
    assert seen(t.with_padding().encode_batch(d, "t", "g")) == {i: None if x is None else padded(x, most[i % 3]) for i, x in rows.items()}
    whole = -(-max(most.values()) // 8) * 8
    assert seen(t.with_padding(multiple=8, direction="left").encode_batch(d, "t", num_workers=3)) == {i: None if x is None else padded(x, whole, "left") for i, x in rows.items()}
    pairs = seen(t.encode_pair(d, "t", "u"))
    both = t.with_padding().encode_pair_batch(d, "t", "u", "g", pretokenized=False, num_workers=2)
    most = {g: max(len(x) for i, x in pairs.items() if i % 3 == g and x is not None) for g in range(3)}
    assert seen(both) == {i: None if x is None else padded(x, most[i % 3]) for i, x in pairs.items()}
    words = seen(t.encode_pretokenized_pair(d, "w", "w"))
    top = max(len(x) for x in words.values() if x is not None)
    got = seen(t.with_padding().encode_pair_batch(d, "w", "w", pretokenized=True, num_workers=2))
    assert got == {i: None if x is None else padded(x, top) for i, x in words.items()}


def slow_decoded(names):
    return "".join(n[2:] if n.startswith("##") else (" " if i else "") + n for i, n in enumerate(names))


def test_decoding_and_names(t, df, spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-2, len(LINES) + 3) for _ in range(rng.randrange(9))]) for i in range(40)]
    d = spark.createDataFrame(rows, "k long, ids array<int>")
    got = d.select("k", t.ids_to_tokens("ids").alias("n"), t.decode("ids").alias("a"), t.decode("ids", False).alias("b"), t.tokens_to_ids(t.ids_to_tokens("ids")).alias("i")).collect()
    for (k, ids), r in zip(rows, sorted(got, key=lambda r: r.k), strict=True):
        names = [LINES[i] if 0 <= i < len(LINES) else "[UNK]" for i in ids]
        assert r.n == names and r.i == [LINES.index(x) for x in names]
        assert r.a == slow_decoded([x for x in names if x[0] != "["]) and r.b == slow_decoded(names), ids
    sparse = WordPieceTokenizer(Vocabulary.from_map({"[UNK]": 3, "omen": 1_999_999_999}))
    assert spark.range(1).select(sparse.ids_to_tokens(F.lit([1_999_999_999, 4])).alias("n")).first().n == ["omen", "[UNK]"]


def test_added_special_tokens_are_left_out_when_decoding(t, spark):
    s, _ = t.add_special_tokens(["<omen>"])
    i = s.vocab.token_to_id("<omen>")
    r = spark.range(1).select(s.decode(F.lit([i, 5]).cast("array<int>")).alias("a"), s.decode(F.lit([i, 5]).cast("array<int>"), False).alias("b")).first()
    assert (r.a, r.b) == ("n", "<omen> n")


def test_alignment_answers_every_position(t, df):
    """Every lookup at every position, against a search through the encoding."""
    some = df.where("w is not null")
    e = t.encode_pretokenized_pair(some, "w", "w")
    asked = range(-1, 8)
    one = lambda i: F.struct(
        E.token_to_word("encoding", i).alias("word"), E.token_to_chars("encoding", i).alias("chars"), E.token_to_sequence("encoding", i).alias("seq"),
        E.word_to_tokens("encoding", i).alias("tokens"), E.word_to_chars("encoding", i).alias("span"), E.char_to_token("encoding", i, word=2).alias("at"), E.char_to_word("encoding", i, word=2).alias("at_word"),
    )
    labels = E.label_tokens("encoding", F.transform("w", lambda x, i: 10 + i)).alias("labels")
    got = {r.k: r for r in e.select("k", labels, E.n_sequences("encoding").alias("n"), *[one(i).alias(f"i{i}") for i in asked]).collect()}
    for k, x in seen(e).items():
        assert got[k].n == max([y[7] + 1 for y in x if y[7] is not None], default=0)
        assert got[k].labels == [-100 if y[6] is None or y[6] == z[6] else 10 + y[6] for y, z in zip(x, [special(t, "[CLS]", 0), *x], strict=False)]
        for i in asked:
            g, y = got[k][f"i{i}"], x[i] if 0 <= i < len(x) else None
            own = y is not None and y[4] == 0
            assert (g.word, g.seq, tuple(g.chars) if g.chars else None) == ((y[6], y[7], y[5]) if own else (None, None, None))
            mine = [j for j, z in enumerate(x) if z[6] == i and z[7] == 0]
            assert (tuple(g.tokens) if g.tokens else None) == ((mine[0], mine[-1] + 1) if mine else None)
            assert (tuple(g.span) if g.span else None) == ((x[mine[0]][5][0], x[mine[-1]][5][1]) if mine else None)
            hit = [j for j, z in enumerate(x) if z[6] == 2 and z[7] == 0 and z[5][0] <= i < z[5][1]]
            assert (g.at, g.at_word) == ((hit[0], 2) if hit else (None, None))


def test_merging_shifts_spans_and_words(t, df):
    some = df.where("t is not null").withColumn("g", F.col("k") % 2)
    x = seen(t.encode(some, "t"))
    got = seen(merge_groups(t.encode(some, "t"), ["g"], "k", "encoding"), key="g")
    for g in range(2):
        want, chars, words = [], 0, 0
        for k in sorted(k for k in x if k % 2 == g):
            want += [(*y[:5], (y[5][0] + chars, y[5][1] + chars) if y[5] != (0, 0) else (0, 0), None if y[6] is None else y[6] + words, y[7]) for y in x[k]]
            chars += max(y[5][1] for y in x[k])
            words += max([y[6] for y in x[k] if y[6] is not None], default=0) + 1
        assert got[g] == want
    assert t.encode(df, "t").select(E.length(E.empty())).first()[0] == 0


def test_lattice_and_fold_equal_the_kernel(spark):
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("moe", repeat=n)] + ["x", "mononon", "o'n", "\\"]
    v = Vocabulary.from_tokens([*LINES, "mo", "##oe", "##mo", "'", "##'"])
    k = WordPieceTokenizer(v).kernel()
    d = spark.createDataFrame([(w,) for w in words], "word string")
    want = {w: [p[1] for p in k.word(w)] for w in words}
    assert {r.word: r.ids for r in word_pieces(spark, d, v, 1).collect()} == want
    found = {r.word: r.found for r in d.select("word", walked("word", v).alias("found")).collect()}
    assert {w: [v.token_to_id(("##" if i else "") + p) for i, p in enumerate(x)] if x else [1] for w, x in found.items()} == want
    docs = spark.createDataFrame([(i % 2, words[i : i + 40]) for i in range(0, len(words), 20)], "g int, w array<string>")
    counts = [sorted(token_counts(spark, docs, "w", v, 1, ["g"], fold_tokens=n).collect()) for n in (0, 10_000)]
    assert counts[0] == counts[1] and sum(r.n_words for r in counts[0]) == sum(len(words[i : i + 40]) for i in range(0, len(words), 20))


def test_native_text_functions_equal_the_kernel(spark):
    texts = ["Ünï​X\tÄé ñ", "中a文", "ΟΔΟΣ", "", "a b\r\nc!"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i").select(T.normalize("t")).collect()]
    assert got == [normalize(x, Normalizer())[0] for x in texts]


def test_results_do_not_depend_on_partitions(t, spark, sf):
    d = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    a = sorted(map(str, t.encode(d.coalesce(1), "text").collect()))
    assert a == sorted(map(str, t.encode_batch(d, "text", num_workers=8).collect()))


def test_sql(t, spark, df):
    sql_functions.register(spark, t)
    df.createOrReplaceTempView("texts")
    k = t.kernel()
    got = {r.k: r for r in spark.sql("SELECT k, wp_count(t) AS n, wp_ids(t) AS ids FROM texts").collect()}
    rows = inputs(df)
    assert all((got[i].n, got[i].ids) == ((None, None) if r.t is None else (len(k.ids(r.t)), k.ids(r.t))) for i, r in rows.items())
    flat = [tuple(r) for r in spark.sql("SELECT k, x.* FROM texts, LATERAL wp_tokens(texts.t) x").collect()]
    assert sorted(flat) == sorted((i, j, *row) for i, r in rows.items() if r.t is not None for j, row in enumerate(zip(*k.content(r.t), strict=True)))


def test_streams(t, spark, sf, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/conversations.parquet", tmp_path / "in")
    q = encode_stream(read_texts(spark, str(tmp_path / "in"), schema), t, "text").writeStream.format("memory").queryName("enc").trigger(availableNow=True).start()
    q.awaitTermination(60)
    n = spark.read.parquet(f"{sf}/conversations.parquet").count()
    assert spark.table("enc").count() == n
    out = str(tmp_path / "out")
    s = read_texts(spark, str(tmp_path / "in"), schema, max_files=1)
    encode_batches(s, t.with_padding(), "text", lambda d, i: d.write.mode("overwrite").parquet(f"{out}/{i}")).trigger(availableNow=True).start().awaitTermination(60)
    got = spark.read.parquet(f"{out}/*")
    assert got.count() == n and got.select(F.count_distinct(F.size("encoding.ids"))).first()[0] == 1


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contents_without_special_tokens_are_not_copied(t, df):
    assert "concat(" not in _plan(t.encode(df, "t", add_special_tokens=False))


PLACES = {
    "added_token_strip": r"\s*then\s*", "added_token_normalized": "éau|ÉAU", "added_token_single_word": r"(?<!\w)then(?!\w)",
}


@pytest.mark.parametrize("name", PLACES)
def test_places_of_added_tokens(spark, tmp_path, name):
    """Number and places against a plain pattern; the tokens are gone through once for both."""
    rng = random.Random(name)
    some = ["", "then", " then\t\n", "thenthen", *("".join(rng.choices(["then", "éau", "ÉAU", " ", "　", "x", "_", ".", "中"], k=9)) for _ in range(40))]
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path))
    spans = [[m.span() for m in re.finditer(PLACES[name], x)] for x in some]
    assert sorted(map(tuple, out.collect())) == [(k, len(s), sum(3 * a + b for a, b in s)) for k, s in enumerate(spans)]
    assert _plan(out).count("filter(") == 1


@pytest.mark.parametrize("kind", ["normalized", "single_word"])
def test_memory_of_a_large_batch(spark, kind):
    """A batch of over 2 MB holds one slice's worth of Python and numpy memory at a time, not the contents of all its texts."""
    rng = random.Random(5)
    words = ["then", "ÉAU", "éau", "monde", "the", "x", "zz", "then.", "ofthen"]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(900)]
    tokens = {"normalized": AddedToken("ÉAU", normalized=True), "single_word": AddedToken("then", single_word=True, normalized=False)}
    t, _ = queries.tokenizer().add_tokens([tokens[kind]])
    run = content_udf(t.kernel()).func
    assert sum(len(x.encode()) for x in texts) > 2 << 20
    tracemalloc.start()
    try:
        n = sum(len(part) for part in run(iter([pa.array(texts)])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(texts) and peak < 110 << 20


@pytest.mark.parametrize(("name", "n"), [("added_token_single_word", 0), ("added_token_normalized", None), ("added_token_strip", None)])
def test_added_tokens_of_a_null_text(spark, tmp_path, name, n):
    """As the SQL has it: a null text has no single words, and of the others no number is known."""
    spark.createDataFrame([(1, None), (2, "a then b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path))
    assert out.schema["n"].dataType.simpleString() == "int"
    assert [tuple(r) for r in out.where("k = 1").collect()] == [(1, n, 0)]


def test_memory_with_many_remembered_words(spark):
    """A slice takes little beside what is remembered, and what is remembered is not copied for it."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeé", k=9)) for _ in range(200_000)]
    t, _ = queries.tokenizer().add_tokens([AddedToken("ÉAU", normalized=True)])
    k = t.kernel()
    run, texts = content_udf(k).func, pa.array([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)])
    tracemalloc.start()
    try:
        for _ in run(iter([texts])):
            pass
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        n = sum(len(part) for part in run(iter([texts])))
        more = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    assert n == len(texts) and len(k._entries) > 150_000 and more < 40 << 20


@pytest.mark.parametrize("name", PLACES)
def test_no_vectored_reads_for_added_tokens(spark, name):
    """Through these an executor would hold a row group's column once more, outside its heap."""
    scan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().collectLeaves().head()
    assert scan.relation().options().get("parquet.hadoop.vectored.io.enabled").get() == "false"
