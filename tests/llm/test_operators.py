"""The corpus operators against brute force, exact round trips and planted cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from subloom.llm import decontaminate, knlm, pieces, pii, quality_rules, secrets, sharding, simhash, suffix_dedup, warc
from subloom.llm.common import connected_components, key_filter, only, without

# secrets


def test_secret_spans(make, edge, spark):
    hexed, noise = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2", "q9ZxT4vLw8KpR2sYb7NdQe3H"
    rows = [*edge, (20, f'é token = "{hexed}" AKIA{"Q" * 16} AKIA12 password: abc {hexed[:23]}'), (21, f"auth {noise} and more"), (22, "auth tokenizer_configuration1 of the house")]
    got = {r.id: [(x.kind, x.text) for x in r.spans] for r in secrets.secret_spans(make(rows)).collect()}
    assert got[20] == [("assign", f'token = "{hexed}'), ("hex", hexed), ("access", "AKIA" + "Q" * 16)]
    assert got[21] == [("novel", noise)] and got[22] == [] and got[1] == [] == got[8]
    assert secrets.secret_spans(make([])).count() == 0


def test_base_spans_use_ascii_letters_only():
    assert secrets.base_spans("paſſword=abcdefgh to\u212aen=abcdefgh") == []  # the Kelvin sign is no ASCII letter
    assert [k for _, k, _ in secrets.base_spans("toKen=abcdefgh")] == [0]
    assert [k for _, k, _ in secrets.base_spans("API_KEY='abcdefgh'")] == [0]


PLAIN_SECRETS = [
    (0, r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "AKIA", '"', "'", " ", ":", "=", "é", "\n", "0123456789abcdef", "fedcba98", "QWERTYUIOPASDFGH", "x", "abc.d", "-", "_"]), max_size=14).map("".join))
def test_base_secrets_equal_the_plain_patterns(text):
    want = sorted((m.start(), kind, m.end()) for kind, pattern, ok in PLAIN_SECRETS for m in re.finditer(pattern, text) if ok(m))
    assert secrets.base_spans(text) == want


def test_novel_values_after_an_equals_sign_and_long_ones():
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    value = "Zx81" + "".join(rng.choice(letters) for _ in range(28))
    longer = "".join(rng.choice(letters) for _ in range(9000))
    for before, what, after in [("private_key=", value, "\n"), ("pwd=", value, ""), ("AWS_ACCESS_KEY=", value, "\nA=1"), ("auth=", value, " x"), ("https://h/x?session=", value, "&a=b"), ("use key-", value, " now"), ("private_key=", longer, ""), ("auth ", longer, " end")]:
        text = before + what + after
        assert [text[s:e] for s, _, e in secrets.novel_spans(text, [], secrets.Novelty())] == [what]


# quality rules


def slow_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + j for i, x in enumerate(win) if win.count(x) > 1 for j in range(5)}
    lines, dup = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], 0
    for i, x in enumerate(lines):
        dup += x in lines[:i]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x85 ", max_size=60))
def test_text_stats(t):
    assert quality_rules.text_stats(t)[:5] == slow_stats(t)


def test_binomial_bound_and_levels():
    from math import comb

    for k, n, p in ((0, 10, 0.3), (3, 20, 0.1), (9, 9, 0.5), (40, 200, 0.2)):
        assert abs(quality_rules.binomial_cdf(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9
    assert quality_rules.certified_level(20, [0] * 6, [5] * 6, 0.03, 0.05) == 0  # too few to certify anything
    assert quality_rules.certified_level(500, [0, 0, 1, 90, 0, 0], [1, 5, 5, 9, 9, 9], 0.03, 0.05) == 2


def test_rules_reject_what_the_holdout_certifies(make, spark):
    rng = random.Random(1)
    good = [(i, " ".join(f"word{rng.randrange(900)}" for _ in range(30))) for i in range(400)]
    bad = [(1000 + i, " ".join(f"W{rng.randrange(900)}$$$###" for _ in range(30))) for i in range(60)]
    docs = make([*good, *bad, (5000, None), (5001, "")]).withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad[:30]] + [(None, 1), (5, None)], "id long, quality int")
    q = {r.id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert all(q[i].kept for i, _ in good) and not any(q[i].kept for i, _ in bad) and q[5000].base_failed and q[5000].n_words == 0
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, _ in good}
    none = quality_rules.quality_rules(docs, labels.limit(0))
    assert none.where("kept").count() == 460 and quality_rules.quality_rules(docs.limit(0), labels).count() == 0


# WARC


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    warc.register(spark)
    rows = [(1, "http://a/1\r\nX: y", "x" * 2000), (2, None, "x" * 2000), (3, "u3", "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", "é\r\n\r\nWARC/1.1\r\n" * 200), (6, "u6", "é\r\n\r\nWARC/1.1\r\n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("z"))
    path = f"file://{tmp_path}/w"
    warc.archive_records(pages).repartition(2).write.format("warc").mode("append").option("path", path).option("blockBytes", 200).save()
    got = spark.read.format("warc").load(path)
    assert got.count() == 7 + 2
    r = got.where("record_type = 'response'").collect()
    text = {x.record_id: x.payload.decode() for x in r}
    assert text == {f"urn:page:{i}": h or "" for i, _, h in rows if i != 1}
    assert all(hashlib.sha1(x.payload).hexdigest() == x.payload_digest and x.payload_length == len(x.payload) for x in r)
    rev = got.where("record_type = 'revisit'").collect()
    assert [(x.record_id, x.refers_to, x.payload, x.payload_length) for x in rev] == [("urn:page:1", "urn:page:2", None, 2000)]
    plan = got.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert ") Filter" not in plan  # the reader tests headers itself
    slim = spark.read.format("warc").schema("record_id string, headers map<string,string>").load(path).where("record_id = 'urn:page:3'").collect()
    assert len(slim) == 1 and slim[0].headers["warc-type"] == "response"
    empty = f"file://{tmp_path}/none"
    warc.archive_records(pages.limit(0)).write.format("warc").mode("append").option("path", empty).save()
    assert spark.read.format("warc").load(empty).where("record_type <> 'warcinfo'").count() == 0


def test_warc_files_of_others(spark, tmp_path):
    import gzip

    recs = [warc.record("response", f"urn:x:{i}", b"body%d" % i * 50, uri="http://h/") for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    warc.register(spark)
    d = spark.read.format("warc").load(str(tmp_path))
    assert sorted(r.payload for r in d.collect()) == sorted([b"body%d" % i * 50 for i in range(3)] * 2)
    assert d.where("record_id = 'urn:x:2'").count() == 2 and d.where("target_uri like 'http%'").count() == 6


# suffix buckets


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=100, max_size=180).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=5), st.integers(0, 3))
def test_refinement_equals_comparing_strings(parts, repeat):
    ctx = parts + parts[:repeat]
    seen, want = set(), set()
    for i, c in enumerate(ctx):
        for s in range(len(c) - 99):
            (want.add((i, s)) if c[s : s + 100] in seen else seen.add(c[s : s + 100]))
    got = {(int(i), s) for i, a, b in zip(*suffix_dedup.later_windows(ctx), strict=True) for s in range(a, b + 1)}
    assert got == want


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeats_equal_brute_force(make, edge, hot):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(50)}" for _ in range(60)) for _ in range(4)]
    rows = [*edge, *((100 + i, base[i % 4][rng.randrange(40) :] + rng.choice(["", " tail", base[(i + 1) % 4]])) for i in range(40))]
    d = suffix_dedup.remove_repeats(make(rows), hot=hot).select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert sorted(set(map(tuple, d.collect()))) == sorted(suffix_dedup.brute(list(dict(rows).items()))) and d.count() == len(rows)
    assert suffix_dedup.remove_repeats(make([])).count() == 0


def test_repeats_shuffle_runs_and_texts_once(spark, make):
    """Disk counts what all exchanges write, for nothing says when Spark drops the files of those that are done."""
    rng = random.Random(8)
    words = ["%06x" % rng.randrange(1 << 24) for _ in range(40_000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(600)]
    texts = [t if i % 4 else t[:1500] + texts[0][100:300] + t[1500:] for i, t in enumerate(texts)] + texts[:200]  # passages and copies
    status, doubles = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        all_ = status.stageList(None, False, False, doubles, None)
        return {x.stageId(): x.shuffleWriteBytes() for x in (all_.apply(i) for i in range(all_.size()))}

    was, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = suffix_dedup.remove_repeats(make(list(enumerate(texts)))).select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
        got = sorted(map(tuple, d.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    wrote = sum(v for k, v in stages().items() if k not in before)
    assert got == sorted(suffix_dedup.brute(list(enumerate(texts))))
    assert wrote < 2 * sum(map(len, texts)), wrote / sum(map(len, texts))


# sharding


def test_shards_are_even_gapless_and_keep_groups_together(make):
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, "copy one") for i in range(9)] + [(2000 + i, None if i % 2 else "") for i in range(6)] + [(3000 + i, "a third of all " * 3) for i in range(150)]
    got = sharding.balanced_shards(make(rows), 5).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(x) for x in by.values()]
    assert len(by) == 5 and max(sizes) - min(sizes) <= 1 and all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    text = dict(rows)
    assert all(r.size == len((text[r.id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.id] or "").encode()) for r in got)
    where = {r.id: r.shard for r in got}
    assert len({where[1000 + i] for i in range(9)}) == 1 == len({where[2000 + i] for i in range(6)})
    assert len({where[3000 + i] for i in range(150)}) <= 3  # larger than one shard: as few as can be, but for what others hold
    assert sharding.balanced_shards(make([]), 5).count() == 0 and sharding.balanced_shards(make([(1, "x"), (1, "x")]), 5).count() == 2


def test_shards_gather_groups_that_outnumber_the_rest(make):
    for single, pairs, shards in ((0, 120, 24), (30, 90, 6)):
        rows = [(i, f"single {i}") for i in range(single)] + [(1000 + i, f"pair {i // 2}") for i in range(2 * pairs)]
        got = sharding.balanced_shards(make(rows), shards).collect()
        sizes, where = [0] * shards, {}
        for r in got:
            sizes[r.shard] += 1
            where.setdefault((r.id - 1000) // 2 if r.id >= 1000 else -1 - r.id, set()).add(r.shard)
        assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
        assert sum(len(x) > 1 for x in where.values()) <= (0 if single else shards - 1)  # without single rows, at most one a border


# pieces


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary.load()


def test_decoding_gives_the_text_back(make, edge, vocab):
    rows = [*edge, (30, "  a  b\n c\tÜé ﬁ ① 中文 \U0001f600"), (31, "<s> </s>")]
    got = pieces.decode(pieces.encode(make(rows)).select("id", F.get("best", F.lit(0))["ids"].alias("ids"))).collect()
    want = dict(rows)
    assert len(got) == len(rows) and all(r.text == want[r.id] for r in got)
    assert pieces.encode(make([])).count() == 0


def test_space_marks_of_the_text_come_back(make):
    rows = [(1, "a\u2581b \u2581 c"), (2, "\u2581"), (3, " \u2581 "), (4, None)]
    got = pieces.encode(make(rows), n=2).select("id", F.get("best", F.lit(0))["ids"].alias("ids"), F.get("best", F.lit(1))["ids"].alias("ids2"), F.lit("old").alias("text"))
    for c in ("ids", "ids2"):
        back = pieces.decode(got, c)
        assert back.columns == ["id", "ids", "ids2", "text"] and all(r.text == dict(rows)[r.id] for r in back.collect() if r[c] is not None)
        assert back.where(F.col(c).isNull()).count() == (1 if c == "ids" else 2)  # the lone mark has one segmentation


def every(v, part):
    if not part:
        return [(0.0, [])]
    out = []
    first = False
    for k in range(1, len(part) + 1):
        if part[:k] in v.pieces:
            first = first or k == 1
            i, s = v.pieces[part[:k]]
            out += [(s + t, [i, *ids]) for t, ids in every(v, part[k:])]
    if not first:
        out += [(v.unk_score + t, v.ids_of_unknown(part[0]) + ids) for t, ids in every(v, part[1:])]
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="thea in.é\n", min_size=1, max_size=9), st.integers(1, 4))
def test_n_best_equals_every_segmentation(vocab_text, n):
    v = pieces.Vocabulary.load() if not hasattr(test_n_best_equals_every_segmentation, "v") else test_n_best_equals_every_segmentation.v
    test_n_best_equals_every_segmentation.v = v
    t = pieces.SPACE + vocab_text.replace(" ", pieces.SPACE)
    want = sorted((s for s, _ in every(v, t)), reverse=True)[:n]
    assert [s for s, _ in pieces.nbest(v, t, n)] == pytest.approx(want)
    assert [s for s, _ in pieces.Segments(v, n).encode(vocab_text)] == pytest.approx(want)


def test_the_best_segmentation_alone_is_searched_by_a_star(monkeypatch):
    v = pieces.Vocabulary.load()
    text = "the old station and ein Haus, où\U0001f600 12345 in the end"
    want = pieces.Segments(v, 2).encode(text)[0]
    asked, search = [], pieces.nbest
    monkeypatch.setattr(pieces, "nbest", lambda v, part, n: asked.append(part) or search(v, part, n))
    got = pieces.Segments(v, 1).encode(text)
    assert got == [(pytest.approx(want[0]), want[1])]
    assert set(asked) == set(v.cut(pieces.SPACE + text.replace(" ", pieces.SPACE)))


# decontamination


def test_leaks_verbatim_and_reparameterised(make, spark):
    q = "A train leaves London at 9 and travels 120 km to Leeds. Anna then drives 45 km further to visit Bob who lives near the old station."
    other = "A train leaves Paris at 7 and travels 300 miles to Lyon. Carla then drives 80 miles further to visit Dan who lives near the old station."
    wrong = "A train leaves Paris at 7 and travels 7 miles to Lyon. Lyon then drives 9 miles further to visit Paris who lives near the new station."
    rows = [(1, f"intro words here. {q} outro"), (2, f"more text. {other} end"), (3, "Nothing of it is in this text but the old station near the town of someone."), (4, None), (5, ""), (6, wrong.replace("train", "bus").replace("drives", "walks"))]
    items = spark.createDataFrame([(7, q), (8, None), (9, "")], "item_id long, text string")
    got = {(r.id, r.item_id): r.consistency for r in decontaminate.leaks(make(rows), items).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[(1, 7)] == 1.0
    assert decontaminate.leaks(make(rows), items.limit(0)).count() == 0 and decontaminate.leaks(make([]), items).count() == 0


def test_words_as_they_are_are_hashed_when_asked_for():
    lex = decontaminate.Lexicon()
    ix, starts, kind, first = decontaminate.template("The old station, near Anna's house. It is old, old and far.", lex)
    assert not lex.exact.any()
    assert len(list(decontaminate.readings(lex, ix, starts, kind, first, 8, True))) == 3 and lex.exact[ix].all()
    assert len(set(lex.exact_of(ix).tolist())) == len({lex.names[i][0] for i in ix})
    for word, want in {"station,": "station", "a.": "a", ".a.": "a", "...": "...", "É!": "é"}.items():
        assert decontaminate.canonical(word.encode())[1] == (decontaminate.LITERAL, want)
    f = decontaminate.bloom(np.arange(1, 400, 2, dtype=np.uint64), 9)
    h = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bit = np.unpackbits(f, bitorder="little")
    assert decontaminate._maybe(f, h, 9).tolist() == [bool(bit[x & 511] and bit[x >> 32 & 511]) for x in h.tolist()]


def test_leaks_equal_brute_force(make, spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "7", "Rome", "km"]) + str(rng.randrange(40)).replace("3", "x") for _ in range(20))) for i in range(20)]
    docs = [(i, " ".join(rng.choice(items)[1].split()[rng.randrange(10) :] + [f"w{rng.randrange(99)}" for _ in range(9)])) for i in range(60)]
    lex = decontaminate.Lexicon()

    def slots(t):
        ix, starts, kind, h = decontaminate.template(t, lex)
        return {decontaminate._window(lex, ix, starts, kind, a, 8)[0]: set() for a in np.flatnonzero(h)}, [(w[0], tuple(w[1])) for a in np.flatnonzero(h) for w in [decontaminate._window(lex, ix, starts, kind, a, 8)]]

    want = set()
    for d, t in docs:
        for i, u in items:
            (dw, dl), (iw, il) = slots(t), slots(u)
            pairs = {p for a, s in dl for b, r in il if a == b for p in zip(r, s, strict=True)}
            ok = not pairs or min(len({a for a, _ in pairs}), len({b for _, b in pairs})) / len(pairs) >= 0.75
            if iw and len(set(dw) & set(iw)) >= 0.3 * len(iw) and set(dw) & set(iw) and ok:
                want.add((d, i))
    got = {(r.id, r.item_id) for r in decontaminate.leaks(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


QUESTION = "A train leaves London at 9 and travels 120 km to Leeds. Anna then drives 45 km further to visit Bob who lives near the old station."


def found(make, spark, rows, items):
    return {(r.id, r.item_id) for r in decontaminate.leaks(make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_leaks_judge_every_occurrence(make, spark):
    changed = QUESTION.replace("London", "Paris").replace("9", "7").replace("120", "300").replace("Leeds", "Lyon").replace("45", "80").replace("Bob", "Dan")
    third = changed.replace("Paris", "Rome").replace("7", "6").replace("300", "220").replace("Lyon", "Milan").replace("80", "35").replace("Dan", "Eve")
    assert found(make, spark, [(1, f"{QUESTION} {changed}"), (2, f"{changed} {third}")], [(7, QUESTION)]) == {(1, 7), (2, 7)}


def test_leaks_take_names_that_begin_sentences(make, spark):
    q = "Tom has 3 apples. Ann has 5 apples. Bob has 7 apples. How many apples do they have?"
    other = q.replace("Tom", "Carla").replace("Ann", "Dan").replace("Bob", "Eve").replace("3", "4").replace("5", "6").replace("7", "8")
    assert found(make, spark, [(1, other), (2, "Tom sells pears. Ann buys plums. Bob has nothing left at all.")], [(7, q)]) == {(1, 7)}


def test_leaks_hold_short_and_number_heavy_items(make, spark):
    items = [(7, "Who painted the famous ceiling there?"), (8, "12 + 7 = 19 3 + 4 = 7 8 2 6 1 9"), (9, "3 5 8 13")]
    rows = [(1, "It was asked again: who painted the famous ceiling there? Nobody in the room knew."), (2, "so 12 + 7 = 19 3 + 4 = 7 8 2 6 1 9 it is"), (3, "we saw 3 5 8 13 in it"), (4, "we saw 3 5 9 13 in it and who painted the ceiling")]
    assert found(make, spark, rows, items) == {(1, 7), (2, 8), (3, 9)}


# language model


def slow_kn(counts, key, order):
    """p of a key (bytes) by the recursion, from raw counts {bytes: n}."""
    tables = {order: dict(counts)}
    for m in range(order - 1, 0, -1):
        t = {}
        for g in tables[m + 1]:
            t[g[1:]] = t.get(g[1:], 0) + 1
        tables[m] = t

    def p(g):
        if not g:
            return 1 / 256
        t = tables[len(g)]
        n = [sum(c == i for c in t.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = []
        for i in (1, 2, 3):
            raw = i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.5 * min(i, 2)
            d.append(min(max(raw, 0.05), i - 0.05))
        ctx = {k: c for k, c in t.items() if k[:-1] == g[:-1]}
        if not ctx:
            return p(g[1:])
        dis = lambda c: d[min(c, 3) - 1]
        c = t.get(g, 0)
        return ((c - dis(c) if c else 0) + sum(map(dis, ctx.values())) * p(g[1:])) / sum(ctx.values())

    return p(key)


def test_kneser_ney_equals_the_recursion_and_sums_to_one(spark):
    rng = random.Random(2)
    text = bytes(rng.choice(b"aaabbc d") for _ in range(400))
    keys = knlm.grams(text, 3)
    counts = {}
    for k in keys.tolist():
        counts[k.to_bytes(3, "big")] = counts.get(k.to_bytes(3, "big"), 0) + 1
    ctx = [b"ab", b"zz"]
    wanted = list(counts) + [c + bytes([x]) for c in ctx for x in range(256)]
    df = spark.createDataFrame([("en", int.from_bytes(g, "big"), c) for g, c in counts.items()], "lang string, k long, c long")
    w = spark.createDataFrame([("en", int.from_bytes(g, "big")) for g in dict.fromkeys(wanted)], "lang string, k long")
    got = {r.k.to_bytes(3, "big"): r.logp for r in knlm.kneser_ney(df, w, 3).collect()}
    for g in dict.fromkeys(wanted):
        assert got[g] == pytest.approx(np.log(slow_kn(counts, g, 3)), abs=1e-9)
    assert all(sum(np.exp(got[c + bytes([x])]) for x in range(256)) == pytest.approx(1) for c in ctx)


def test_perplexity_separates_and_shards_agree(make, edge, spark):
    rng = random.Random(4)
    words = ["river", "stone", "garden", "winter", "letter", "morning", "silver"]
    good = [(100 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(120)]
    bad = [(900, "".join(chr(33 + rng.randrange(90)) for _ in range(400))), (901, "XQZ!! " * 60)]
    docs = make([*edge, *good, *bad])
    trusted = spark.createDataFrame([(i,) for i, _ in good[:80]] + [(None,)], "id long")
    one = {r.id: r for r in knlm.kn_quality(docs, trusted).collect()}
    assert all(one[i].kept for i, _ in good) and not one[900].kept and not one[901].kept and not one[1].kept and one[1].perplexity is None and not one[2].kept
    many = {r.id: r for r in knlm.kn_quality(docs, trusted, shard_rows=200).collect()}
    assert all(many[i].perplexity == pytest.approx(one[i].perplexity, rel=1e-6) for i, _ in good)
    assert knlm.kn_quality(make([]), trusted).count() == 0 and all(r.kept == bool(r.n_bytes) for r in knlm.kn_quality(docs, trusted.limit(0)).collect())


def test_perplexity_cut_follows_the_labels(make, spark):
    rng = random.Random(8)
    words = ["river", "stone", "garden", "winter", "letter", "morning", "silver", "bridge"]
    text = lambda odd: " ".join("".join(rng.sample(w, len(w))) if rng.random() < odd else w for w in (rng.choice(words) for _ in range(60)))
    good, toxic = [(i, text(0.02)) for i in range(300)], [(1000 + i, text(0.2)) for i in range(60)]
    unseen = [i for i, _ in good if np.uint64(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)).astype(np.int64) % 5 == 0]
    for i in unseen[:2]:  # outliers among those held out
        good[i] = (i, text(0.9))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int")
    got = {r.id: r.kept for r in knlm.kn_quality(make(good + toxic), knlm.trusted_ids(labels), rejected=knlm.rejected_ids(labels)).collect()}
    assert sum(not got[i] for i, _ in toxic) >= 54 and sum(got[i] for i, _ in good) >= 270
    old = {r.id: r.kept for r in knlm.kn_quality(make(good + toxic), knlm.trusted_ids(labels)).collect()}
    assert sum(not old[i] for i, _ in toxic) < 30


# personal data


def test_base_spans_and_redaction(make, edge, spark):
    t = "mail é a@b.cc_d@e.ff or +1 (212) 555-0100, card 4111 1111 1111 1111 / 4111111111111112 from 10.0.0.255 and 1.2.3.400, x@y"
    rows = [*edge, (40, t), (41, "call 555-123-4567 now"), (42, "1" * 3000 + " " + "a." * 3000)]
    d = make(rows)
    got = {r.id: r for r in pii.pii_spans(d).collect()}
    found = [(pii.KINDS[x.kind_no], t[x.start : x.end]) for x in got[40].base]
    assert found == [("email", "a@b.cc"), ("email", "_d@e.ff"), ("phone", "+1 (212) 555-0100"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255")]
    assert got[1].base == [] == got[42].base and len(got) == len(dict(rows))
    assert all(not (a.start < b.end and b.start < a.end) for r in got.values() for a in r.novel for b in r.base)
    out = {r.doc_id: r for r in pii.redact(d, length_col="n_chars").collect()}
    assert out[40].text.startswith("mail é [EMAIL][EMAIL] or [PHONE], card [CARD] / ") and out[40].n_chars == len(out[40].text) and out[1].text is None and out[8].text == dict(rows)[8]
    assert out[40].id == "x" and pii.redact(make([])).count() == 0


def plain_pii(text):
    """The base spans by the patterns as they are stated."""
    digits = lambda x: [int(c) for c in x if c in "0123456789"]
    luhn = lambda d: sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(y) <= 255 for y in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 14 <= len(digits(x)) <= 19 and luhn(digits(x))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 10 <= len(digits(x)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m[0]))


def test_base_personal_data_equals_the_plain_patterns(make):
    rng = random.Random(7)
    bits = ["a", "b.c", "@", "@d.ee", ".", "é", " ", "-", "+", "+49 ", "(0)", "12", "255.", "256.1.", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "000.1.2.3", "x_%", "5500-0000-0000-0004", "\n", "😀", "7"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 16)))) for i in range(600)]
    rows += [(600, " and ".join(f"+{rng.randrange(10**11, 10**12)}, {rng.randrange(10**16)} 😀" for _ in range(300)))]
    got = {r.id: ([(x.start, x.kind_no, x.end) for x in r.base], r.novel) for r in pii.pii_spans(make(rows)).collect()}
    text = dict(rows)
    assert {i: x for i, (x, _) in got.items()} == {i: plain_pii(t) for i, t in rows}
    for i, (base, novel) in got.items():
        assert all(n.end <= len(text[i]) and not any(a < n.end and n.start < b for a, _, b in base) for n in novel)
    out = {r.doc_id: r.text for r in pii.redact(make(rows)).collect()}
    names = [f"[{k.upper()}]" for k in (*pii.KINDS, "novel")]
    for i, (base, novel) in got.items():
        want, at = "", 0
        for a, k, b in sorted([*base, *((n.start, 4, n.end) for n in novel)]):
            if a >= at:
                want += text[i][at:a] + names[k]
            at = max(at, b)
        assert out[i] == want + text[i][at:]


def test_long_numbers_are_candidates_whole(spark):
    d = spark.createDataFrame([(1, "total 1" + "2" * 59 + " x"), (2, "jane" * 30 + " (at) mail (dot) example (dot) co (dot) uk (dot) eu (dot) org")], "id long, t string")
    got = {r.id: [(x.start, x.end) for x in r.c] for r in d.select("id", pii.candidates(F.col("t"), F.array().cast("array<struct<start:int,kind_no:int,end:int>>")).alias("c")).collect()}
    assert got[1] == [(6, 66)] and got[2] == [(0, 120 + len(" (at) mail (dot) example (dot) co (dot) uk (dot) eu (dot) org"))]


def test_boosted_trees_learn_and_match_their_expression(spark):
    rows = [(tuple(int(x) for x in np.random.default_rng(i).integers(0, 4, len(pii.FEATURES))), 0.0, 0.0) for i in range(60)]
    rows = [(x, float(x[0] > 1 and x[3] < 2), float(not (x[0] > 1 and x[3] < 2))) for x, _, _ in rows]
    m = pii.Boosted().fit(rows)
    assert all((m.score(x) > 0) == bool(a) for x, a, _ in rows)
    df = spark.createDataFrame([x for x, _, _ in rows], list(pii.FEATURES))
    assert [r[0] for r in df.coalesce(1).select(m.column(F.col)).collect()] == pytest.approx([m.score(x) for x, _, _ in rows])
    assert pii.calibrated_threshold([(1.0, 0, 5), (2.0, 50, 0)], 0.9) == 2.0


def test_trees_and_threshold_of_a_table_equal_those_of_its_rows(spark):
    rng = random.Random(11)
    rows = {tuple(rng.randrange(5) for _ in pii.FEATURES): (10 * rng.randrange(9), rng.randrange(90)) for _ in range(150)}
    df = spark.createDataFrame([(*x, a, b) for x, (a, b) in rows.items()], [*pii.FEATURES, "a", "b"])
    df = df.select(*[F.col(c).cast("int") for c in pii.FEATURES], "a", "b")
    plain = pii.Boosted(rounds=4).fit(sorted((x, a / 10, b / 10) for x, (a, b) in rows.items()))
    m = pii.Boosted(rounds=4).fit_table(df)
    assert [m.score(x) for x in rows] == pytest.approx([plain.score(x) for x in rows])
    scored = [(m.score(x), a / 10, b / 10) for x, (a, b) in rows.items()]
    for precision in (0.3, 0.6, 0.8, 0.99999):
        assert pii.table_threshold(df, m, precision, 7) == pytest.approx(pii.calibrated_threshold(scored, precision))


def test_training_counts_hold_every_span(spark):
    n = 20_500  # above the 20,000 spans that were once the most
    known = F.col("id") % 3 == 0
    one = F.struct(F.lit(0).alias("start"), F.lit(9).alias("end"), known.alias("known"), *[F.lit(0).alias(f) for f in pii.FEATURES])
    counts = pii.training_counts(spark.range(n).select("id", F.array(one).alias("cand"))).where("digits = 0 and at = 0")
    a, b, held = counts.agg(F.sum("a"), F.sum("b"), F.count_distinct("held")).first()
    yes = len(range(0, n, 3))
    assert (a, b, held) == (10 * yes, n - yes, 2)


# SimHash


def slow_components(fps):
    low = dict(fps)
    changed = True
    comp = {i: i for i, _ in fps}
    while changed:
        changed = False
        for i, a in low.items():
            for j, b in low.items():
                if bin(a ^ b).count("1") <= 2 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


def test_components_equal_brute_force(make, edge):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300)).split()
    rows = list(edge)
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9)}"
        rows.append((100 + i, " ".join(w)))
    got = {r.id: r for r in simhash.simhash_components(make(rows)).collect()}

    def fp(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = {i: fp(t) for i, t in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == want
    assert {i: r.component for i, r in got.items()} == slow_components(list(want.items()))
    assert simhash.simhash_components(make([])).count() == 0


def test_spark_and_python_hash_shingles_alike(spark):
    assert spark.sql("SELECT xxhash64('a b ç')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b ç".encode(), 42)


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_edges_connect_exactly_the_ball(spark, bits):
    rng = random.Random(bits)
    fps = {rng.getrandbits(64) for _ in range(5)}
    for f in list(fps):
        for _ in range(12):
            g = f
            for _ in range(rng.randrange(5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    rows = list(enumerate(fps))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    cc = {r.node: r.root for r in connected_components(simhash.fingerprint_edges(df, bits)).collect()}
    ids = {f: i for i, f in rows}
    par = {f: f for f in fps}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= bits:
                par[find(a)] = find(b)
    for a in fps:
        for b in fps:
            ra, rb = cc.get(simhash._signed(a), simhash._signed(a)), cc.get(simhash._signed(b), simhash._signed(b))
            assert (ra == rb) == (find(a) == find(b)), (ids[a], ids[b])


def test_near_copies_keep_one(make, edge):
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = list(base)
    near[100] = near[300] = "changed"
    far = [f"u{rng.randrange(5000)}" for _ in range(400)]
    d = make([*edge, (50, " ".join(base)), (51, " ".join(near)), (52, " ".join(base)), (53, " ".join(far))])
    kept = simhash.keep_one(d)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == d.columns and sorted(ids) == [1, 3, 4, 4, 7, 8, 10, 11, 50, 53]


def test_near_prints_take_repeats_once():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(850)]
    once, often = (simhash.near_prints(simhash.shingle_set(" ".join(w), 5)) for w in (words, words + words[-10:] * 30))
    near = sum((int(a) ^ int(b)).bit_count() <= 2 for a, b in zip(once, often, strict=True))
    assert near >= 10 and len(set(once.tolist())) == simhash.TABLES


def edited(rng, words, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"v{rng.randrange(10**6)}"
    return out


def jaccard(a, b):
    x, y = (set(simhash.shingle_set(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def groups(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force_in_a_family(make, edge):
    """A family whose members are not all similar to each other: a member that its first partner fails finds others."""
    rng = random.Random(16)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(100 + i, " ".join(edited(rng, base, rng.randrange(9)))) for i in range(150)]
    rows += [(300 + i, " ".join(edited(rng, [f"w{rng.randrange(900)}" for _ in range(40)], 0)) + " " + " ".join(base[:50])) for i in range(40)]
    some = dict(rows)
    links = [(a, b) for a in some for b in some if a < b and jaccard(some[a], some[b]) >= 0.8]
    want = groups(links, some)
    got = {r.id: r.root for r in simhash.near_duplicates(make([*edge, *rows])).collect()}
    assert {i: got[i] for i in some} == want and len(set(want.values())) < 150
    assert all(got[a] != got[b] for a in some for b in some if want[a] != want[b])


def test_near_duplicates_recall_by_similarity(make):
    rng = random.Random(17)
    rows, bands = [], {}
    for i in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(220)]
        other = edited(rng, base, rng.choice((1, 2, 3, 4)))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        j = jaccard(rows[-1][1], rows[-2][1])
        bands.setdefault(0.8 if 0.8 <= j < 0.85 else 0.85 if j >= 0.85 else 0, []).append(2 * i)
    got = {r.id: r.root for r in simhash.near_duplicates(make(rows)).collect()}
    found = {b: sum(got[i + 1] == i for i in x) / len(x) for b, x in bands.items()}
    assert found[0.85] >= 0.98 and found.get(0.8, 1) >= 0.9 and not found.get(0)


def test_pairs_between_leave_no_similar_pair_out(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(900)}" for _ in range(100)]
    texts = [" ".join(edited(rng, base, rng.randrange(7))) for _ in range(60)]
    found = [simhash.shingle_set(t, 5) for t in texts]
    each = spark.createDataFrame([(i, int(p)) for i, s in enumerate(found) for p in simhash.near_prints(s).view(np.int64)], "u long, p long")
    sets = spark.createDataFrame([(i, len(s), np.bincount((s & np.uint64(63)).astype(int), minlength=64).tolist(), s.view(np.int64).tolist()) for i, s in enumerate(found)], "u long, n int, parts array<int>, s array<long>")
    root = {i: min(i, i % 7) for i in range(40)}
    got = {(r.a, r.b) for r in simhash.pairs_between(each, spark.createDataFrame(list(root.items()), "node long, root long"), sets, 0.8).collect()}
    prints = [simhash.near_prints(s).tolist() for s in found]
    meet = {(i, j) for i in range(60) for j in range(i) if any((x ^ y).bit_count() <= 2 for x, y in zip(prints[i], prints[j], strict=True))}
    apart = {(j, i) for i, j in meet if root.get(i, i) != root.get(j, j)}
    similar = {(a, b) for a, b in apart if jaccard(texts[a], texts[b]) >= 0.8}
    assert similar and similar <= got <= apart
    links = {(r.a, r.b) for r in simhash.linked_pairs(spark.createDataFrame(sorted(apart), "a long, b long"), sets, 0.8).collect()}
    assert links == similar


def test_rows_are_told_apart_in_place(make, spark):
    d = make([(1, "a"), (1, "b"), (2, None), (2, None), (None, "c"), (3, "")])
    keys = spark.createDataFrame([(1, "b"), (2, None), (None, "c"), (9, "z"), (1, "b")], "k long, t string")
    at = {"k": F.col("doc_id"), "t": F.col("text")}
    out, kept = without(d, keys, **at), only(d, keys, **at)
    assert out.columns == d.columns == kept.columns and sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a"), (3, "")]
    assert kept.count() == 4 and without(d, keys.limit(0), **at).count() == 6 and only(make([]), keys, **at).count() == 0
    many = spark.range(5000).select(F.col("id").alias("k"))
    hit = key_filter(many, bits=12)  # too small on purpose: it lets others through and loses none
    assert many.where(hit(F.col("k"))).count() == 5000


def test_pipeline_stages_take_odd_rows_and_none(spark, sf, make, edge):
    import corpus_pipeline as c

    docs = make([*edge, (None, "words without an id that are told apart from all of the others here"), (13, None)]).withColumns({"u": F.lit(1), "x": F.lit(2), "n": F.lit(3)})
    text = sorted((str(r.doc_id), str(r.text)) for r in docs.collect())
    for name, f in c.STAGES:
        out = f(spark, docs, sf)
        rows = [r.asDict() for r in out.collect()]
        if name == "pieces":
            assert len(rows) == len(text) and sum(r["ids"] is None for r in rows) == 2
            assert f(spark, docs.limit(0), sf).count() == 0
            continue
        assert out.columns == docs.columns, name
        got = sorted((str(r["doc_id"]), str(r["text"])) for r in rows)
        if name == "quality_rules":
            assert got == [x for x in text if len(x[1].split()) >= 10 and x[1].split()[0] not in ("a", "é") and x[0] not in ("8", "9")] or set(got) <= set(text)
            assert not any(len(t.split()) < 10 for _, t in got)
        elif name == "simhash":  # rows of one id and text stay together; the smallest id of equal ones stays
            assert got.count(("4", edge[3][1])) == 2 and ("5", edge[3][1]) not in got and ("2", "") not in got and ("13", "None") not in got and ("12", "a B c") not in got
        else:
            assert got == text, name  # nothing in them leaks or is personal
        assert f(spark, docs.limit(0), sf).count() == 0


def test_pipeline_stages_keep_the_columns(spark, sf):
    import corpus_pipeline as c

    from subloom.llm.common import table, written

    docs = table(spark, sf, "documents")
    for _, f in c.STAGES[:-1]:
        out = written(f(spark, docs, sf), "test")
        assert out.schema.names == docs.schema.names and 0 < out.count() <= docs.count()
        docs = out
    done = c.STAGES[-1][1](spark, docs, sf)
    back = pieces.decode(done).join(docs.select("doc_id", F.col("text").alias("want")), "doc_id")
    assert back.where("text <=> want").count() == docs.count()
