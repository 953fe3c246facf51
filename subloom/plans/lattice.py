"""WordPiece as relational plans: no Python, a longest-match lattice over distinct words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.sources.vocabulary import PrefixSet, Vocabulary

#: A vocabulary has one row a token; up to this many (about 20 MB) it is broadcast, above that the joins shuffle.
BROADCAST_TOKENS = 300_000


def vocabulary_rows(spark: SparkSession, vocab: Vocabulary, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(piece, is_continuation, id, len) of everything that can be a piece of a word, with a broadcast hint while it is small."""
    rows = [(p, False, vocab.words.lookup(p)) for p in vocab.words if p] + [(p, True, vocab.continuations.lookup(p)) for p in vocab.continuations if p]
    df = spark.createDataFrame(rows, "piece string, is_continuation boolean, id int").withColumn("len", F.length("piece"))
    return F.broadcast(df) if len(rows) <= broadcast_tokens else df


def prefixes(
    spark: SparkSession, texts: DataFrame, text: str, vocab: Vocabulary, start: int = 0, continuation: bool = False,
) -> DataFrame:
    """texts with a row for every vocabulary piece that begins at start: piece, id, end. A hash join on substrings."""
    v = vocabulary_rows(spark, vocab).where(F.col("is_continuation") == continuation).select("piece", "id")
    longest = max(map(len, vocab.continuations if continuation else vocab.words), default=0)
    top = F.least(F.length(text) - start, F.lit(longest))
    d = texts.withColumn(
        "_n", F.explode(F.when(top >= 1, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))),
    )
    d = d.withColumn("piece", F.substring(F.col(text), F.lit(start + 1), F.col("_n")))
    return d.join(v, "piece").withColumn("end", F.col("_n") + start).drop("_n")


def word_pieces(
    spark: SparkSession, words: DataFrame, vocab: Vocabulary, unk_id: int, max_word_length: int = 200,
) -> DataFrame:
    """(word, ids) for words(word), which should be distinct and dealt by word: greedy longest-match ids, one unknown id where it fails.

    Candidate substrings are matched by a hash join with the vocabulary; the best at each place is a max, and the walk
    over a word's best matches is an array fold.
    """
    v = vocabulary_rows(spark, vocab)
    longest = max([*map(len, vocab.words), *map(len, vocab.continuations)], default=1)
    n = F.length("word")
    short = words.where(n.between(1, max_word_length))
    at = short.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    sub = at.select(
        "word", "pos",
        F.explode(F.sequence(F.lit(1), F.least(F.length("word") - F.col("pos"), F.lit(longest)))).alias("len"),
    )
    sub = sub.select(
        "word", "pos", "len", F.substring("word", F.col("pos") + 1, F.col("len")).alias("piece"),
        (F.col("pos") > 0).alias("is_continuation"),
    )
    hit = sub.join(v.select("piece", "is_continuation", "id"), ["piece", "is_continuation"])
    best = hit.groupBy("word", "pos").agg(F.max(F.struct("len", "id")).alias("m"))
    table = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos"), F.col("m")))).alias("best"))
    state = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("ids"))

    def step(acc, i):
        m = F.col("best")[acc["pos"]]
        go = (acc["pos"] == i) & m.isNotNull()
        return F.when(go, F.struct((acc["pos"] + m["len"]).alias("pos"), F.array_append(acc["ids"], m["id"]).alias("ids"))).otherwise(acc)

    walked = F.aggregate(F.sequence(F.lit(0), n - 1), state, step)
    done = table.select("word", walked.alias("w"), n.alias("n"))
    good = done.where(F.col("w.pos") == F.col("n")).select("word", F.col("w.ids").alias("ids"))
    return words.join(good, "word", "left").select("word", F.coalesce("ids", F.array(F.lit(unk_id))).alias("ids"))


#: A vocabulary of up to so many tokens is a constant hash set within an expression; above, the joins of word_pieces serve.
FOLD_TOKENS = 50_000


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def walked(word: str, vocab: Vocabulary, max_word_length: int = 200) -> Column:
    """array<string>: the greedy longest matches of the word column, which begins the word and which continue it told by
    their place; null where they don't cover the word.

    A fold over the places; at each one that the walk comes to, the longest piece is asked for first. No joins, no Python.
    """

    def longest(pieces: PrefixSet) -> str:
        by_length: dict[int, list[str]] = {}
        for p in pieces:
            by_length.setdefault(len(p), []).append(_quoted(p))
        cases = [f"when substring(`{word}`, i + 1, {n}) in ({', '.join(by_length[n])}) then {n}" for n in sorted(by_length, reverse=True) if n]
        return f"case {' '.join(cases)} else 0 end" if cases else "0"

    step = f"""get(transform(array(if(i = 0, {longest(vocab.words)}, {longest(vocab.continuations)})), n ->
        named_struct('pos', if(n = 0, -1, i + n), 'found', if(n = 0, acc.found, array_append(acc.found, substring(`{word}`, i + 1, n))))), 0)"""
    return F.expr(f"""if(length(`{word}`) not between 1 and {max_word_length}, null,
        aggregate(sequence(0, length(`{word}`) - 1), named_struct('pos', 0, 'found', cast(array() as array<string>)),
            (acc, i) -> if(acc.pos = i, {step}, acc), acc -> if(acc.pos = length(`{word}`), acc.found, null)))""")


def token_counts(
    spark: SparkSession, docs: DataFrame, pieces: str, vocab: Vocabulary, unk_id: int, by: list[str],
    change: Callable[[Column], Column] = lambda word: word, fold_tokens: int = FOLD_TOKENS,
) -> DataFrame:
    """(by, n_words, n_tokens, n_unk, id_sum): counts per group of rows with an array of words.

    (group, word) pairs are counted first and each is split once; what is shuffled then are counts of (group, piece).
    change is what is still to be done to each word, whole texts spared; words that it empties don't count.
    A word without a full segmentation is one unknown token.
    """
    pairs = docs.select(*by, F.explode(pieces).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("c"))
    # dealt out row by row: a small table of pairs would be left to a few tasks, and the walks are what takes time
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.select(*by, change(F.col("word")).alias("word"), "c").where("word <> ''")
    if vocab.size > fold_tokens:
        words = pairs.select("word").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word").distinct()
        x = pairs.join(word_pieces(spark, words, vocab, unk_id), "word")
        ids = x.select(*by, "c", F.posexplode("ids").alias("pos", "id"))
    else:
        found = pairs.select(
            *by, "c",
            F.posexplode(F.coalesce(walked("word", vocab), F.array(F.lit(None).cast("string")))).alias("pos", "piece"),
        )
        found = found.groupBy(*by, "piece", (F.col("pos") > 0).alias("is_continuation")).agg(F.sum("c").alias("c"))
        known = vocabulary_rows(spark, vocab).select("piece", "is_continuation", "id")
        ids = found.join(known, ["piece", "is_continuation"], "left")
        ids = ids.select(
            *by, "c", F.col("is_continuation").cast("int").alias("pos"), F.coalesce("id", F.lit(unk_id)).alias("id")
        )
    begins, c = F.col("pos") == 0, F.col("c")
    return ids.groupBy(*by).agg(
        F.sum(F.when(begins, c)).alias("n_words"), F.sum("c").alias("n_tokens"),
        F.sum(F.when(F.col("id") == unk_id, c).otherwise(0)).alias("n_unk"), F.sum(c * F.col("id")).alias("id_sum"),
    )
