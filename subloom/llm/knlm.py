"""Quality classifier: per-document perplexity under interpolated modified Kneser-Ney models of trusted text."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.llm.common import held, small, table, written

ORDER = 5  # symbols are bytes, so an n-gram of up to 7 fits a long without any hashing
_START = 0  # pads the beginning of a text
#: Bytes as the model sees them: control bytes become spaces, all digits 0, capitals stay (shouting is a feature).
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:32] = 32
_FOLD[48:58] = 48
_FOLD[127] = 32


def grams(text: bytes, order: int) -> np.ndarray:
    """The order-grams of a text, one for each byte, packed big-endian into uint64; the start is padded."""
    b = _FOLD[np.frombuffer(text, np.uint8)].astype(np.uint64)
    padded = np.concatenate([np.full(order - 1, _START, np.uint64), b])
    k = np.zeros(len(b), np.uint64)
    for j in range(order):
        k = (k << np.uint64(8)) | padded[j : j + len(b)]
    return k


def _distinct(docs: DataFrame, order: int, counted: bool) -> DataFrame:
    """(lang, k, c): distinct n-grams of each language with counts; blocks of text are pre-counted where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("knlm")
        seen: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in seen.items():
                k, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c, pa.int64())],
                    ["lang", "k", "c"],
                )
            seen.clear()

        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if raw := (t.as_py() or "").encode():
                    for at in range(0, len(raw), 4 << 20):  # a very long text in pieces; later ones keep their context
                        g = grams(raw[max(0, at - order + 1) : at + (4 << 20)], order)
                        seen.setdefault(lang, []).append(g if not at else g[order - 1 :])
                    size += len(raw)
                if size > 12 << 20:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, k long, c long").groupBy("lang", "k").agg((F.sum("c") if counted else F.lit(1)).cast("long").alias("c"))


def _pow(n: int) -> int:
    return (1 << (8 * n)) - 1


def kneser_ney(counts: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, k, logp): the interpolated modified Kneser-Ney log probability of every wanted order-gram.

    counts(lang, k, c) holds the highest-order counts of the trusted text. Lower orders use continuation counts
    (how many different bytes precede). Each order has its own three discounts from counts of counts; the
    last level is uniform over 256 bytes. All of it is equi-joins and aggregations on (lang, n-gram), sharded
    by the shuffle; no key repeats within a table, so none is hot.
    """
    tables = {order: counts}
    for m in range(order - 1, 0, -1):  # distinct left extensions, from the order above
        tables[m] = written(
            tables[m + 1].groupBy("lang", F.expr(f"k & {_pow(m)}").alias("k")).agg(F.count("*").alias("c")), f"kn{m}",
        )
    # p of the empty context, for every wanted last byte
    prob = wanted.select("lang", F.expr("k & 255").alias("k")).distinct().withColumn("p", F.lit(1 / 256.0))
    for m in range(1, order + 1):
        t = tables[m]
        n = t.groupBy("lang").agg(*[F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        d = [F.least(F.greatest(F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * min(i, 2))), F.lit(0.05)), F.lit(i - 0.05)) for i in (1, 2, 3)]
        n = n.select("lang", *[x.alias(f"d{i + 1}") for i, x in enumerate(d)])
        disc = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(small(n), "lang").select("lang", "k", "c", disc.alias("d"))
        ctx = t.groupBy("lang", F.expr("shiftright(k, 8)").alias("h")).agg(
            F.sum("c").alias("total"), F.sum("d").alias("freed"),
        )
        want = wanted.select("lang", F.expr(f"k & {_pow(m)}").alias("k")).distinct() if m < order else wanted.select("lang", "k")
        x = want.select(
            "lang", "k", F.expr("shiftright(k, 8)").alias("h"), F.expr(f"k & {_pow(max(1, m - 1))}").alias("low"),
        )
        x = x.join(prob.select("lang", F.col("k").alias("low"), F.col("p").alias("p_low")), ["lang", "low"])
        x = x.join(ctx, ["lang", "h"], "left").join(t, ["lang", "k"], "left")
        p = F.when(F.col("total").isNull(), F.col("p_low")).otherwise((F.coalesce(F.col("c") - F.col("d"), F.lit(0.0)) + F.col("freed") * F.col("p_low")) / F.col("total"))
        prob = x.select("lang", "k", p.alias("p"))
        if m < order:
            prob = written(prob, f"kn-p{m}")
    return prob.select("lang", "k", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, logp: DataFrame, order: int = ORDER, shard_rows: int = 4_000_000) -> DataFrame:
    """(id, lang, nll, n), one row per row of docs(id, lang, t): the sums over all n-grams of a text in the table logp.

    The table is cut by a hash of the n-gram into shards of about shard_rows, whose number grows with the model. One shard
    lives at a time: it is shipped as sorted arrays of 12 bytes an n-gram, every text adds up what the shard knows where it
    is, the sums are written, and the shard is dropped. Sums meet by (id, language, XXH64 of the text), so no pass needs
    row numbers that another agrees with; repeated rows have equal sums and come back as often as they stood.
    """
    spark = docs.sparkSession
    shards = max(1, -(-logp.count() * 5 // (4 * shard_rows)))
    d = docs.select("id", "lang", F.xxhash64("t").alias("x"), "t")
    passes = []
    for s in range(shards):
        part = logp if shards == 1 else logp.where(F.pmod(F.xxhash64("lang", "k"), F.lit(shards)) == s)
        t = part.select("lang", "k", F.col("logp").cast("float")).toArrow()
        tables = {}
        for lang in pc.unique(t.column("lang")).to_pylist():
            own = t.filter(pc.equal(t.column("lang"), lang))
            k, v = own.column("k").to_numpy(), own.column("logp").to_numpy()
            at = np.argsort(k)
            tables[lang] = (k[at], v[at])
        del t
        model = spark.sparkContext.broadcast(tables)
        del tables

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            held("knlm")
            for b in batches:
                nll, n = [], []
                for lang, t in zip(b.column(1).to_pylist(), b.column(3), strict=True):
                    raw, total = (t.as_py() or "").encode(), 0.0
                    keys, values = model.value.get(lang, (None, None))
                    for at in range(0, len(raw) if keys is not None else 0, 1 << 20):
                        g = grams(raw[max(0, at - order + 1) : at + (1 << 20)], order).view(np.int64)
                        g = g if not at else g[order - 1 :]
                        i = np.searchsorted(keys, g)
                        i[i == len(keys)] = 0
                        hit = keys[i] == g
                        total -= float(values[i[hit]].sum(dtype=np.float64))
                    nll.append(None if keys is None else total)
                    n.append(len(raw))
                cols = [b.column(0), b.column(1), b.column(2), pa.array(nll, pa.float64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "lang", "x", "nll", "n"])

        passes.append(written(d.mapInArrow(run, "id long, lang string, x long, nll double, n long"), "kn-pass"))
        model.destroy()
    if shards == 1:
        return passes[0].select("id", "lang", "nll", "n")
    sums = functools.reduce(DataFrame.unionAll, passes).groupBy("id", "lang", "x").agg(
        F.sum("nll").alias("nll"), F.max("n").alias("n"), F.count("*").alias("rows"),
    )
    times = (F.col("rows") / shards).cast("int")
    return sums.select("id", "lang", (F.col("nll") / times).alias("nll"), "n", F.explode(F.array_repeat(F.lit(0), times))).select("id", "lang", "nll", "n")


#: Quantiles of held-out trusted perplexity to choose from: at most 5 % of the trusted documents are lost.
LEVELS = (0.95, 0.955, 0.96, 0.965, 0.97, 0.975, 0.98, 0.985, 0.99, 0.995)


def chosen_cut(scored: DataFrame, held: DataFrame, rejected: DataFrame) -> DataFrame:
    """(lang, chosen): the quantile of LEVELS that tells held-out trusted from rejected(id, kind) best, by language; the higher of equals."""
    s = scored.where("perplexity is not null").select("id", "lang", "perplexity")
    levels = F.array(*[F.lit(x) for x in LEVELS])
    own = s.join(held, "id", "left_semi").groupBy("lang").agg(F.percentile_approx("perplexity", levels, 10000).alias("cuts"))
    bad = s.join(rejected.select(F.col("id").cast("long").alias("id"), "kind").distinct(), "id").join(small(own), "lang")
    caught = bad.groupBy("lang", "kind").agg(*[F.avg((F.col("perplexity") > F.get("cuts", F.lit(i))).cast("double")).alias(f"c{i}") for i in range(len(LEVELS))])
    mean = caught.groupBy("lang").agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(len(LEVELS))])
    score = F.array(*[F.struct((F.col(f"c{i}") - (1 - q)).alias("gain"), F.lit(q).alias("q"), F.get("cuts", F.lit(i)).alias("cut")) for i, q in enumerate(LEVELS)])
    return own.join(mean, "lang").select("lang", F.array_max(score)["cut"].alias("chosen"))


def kn_quality(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = 0.995, slack: float = 1.1, folds: int = 5, shard_rows: int = 4_000_000,
    rejected: DataFrame | None = None,
) -> DataFrame:
    """One row per row of docs: id, lang, n_bytes, perplexity, threshold, kept.

    trusted(id) names the documents of trusted text. All but one in folds (by hash of the id) train one model
    per language; the perplexities of those held out, which no model has seen, set the threshold: a document is
    kept while its perplexity a byte is at most slack times their quantile in its language. With rejected(id, kind), documents labelled
    bad in one way or another, a language that has some gets the one of the LEVELS instead, without slack, that catches
    most: the mean over the kinds of the share above it, less the share of the held-out trusted above it. Null and empty texts have no perplexity and aren't kept; a language without trusted text has no model and keeps all
    it has. Null languages form the language ''. Repeated rows repeat. Only the named columns are read.
    """
    d = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.col(text_col).alias("t"),
    )
    ids = trusted.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    unseen = F.pmod(F.xxhash64("id"), F.lit(folds)) == 0
    # one plan whatever the number of ids: both sides are shuffled and merged, so nothing that grows is broadcast
    good = d.join(ids.where(~unseen).hint("merge"), "id", "left_semi")
    counts = written(_distinct(good.select("lang", "t"), order, True), "kn-counts")
    wanted = written(
        _distinct(d.select("lang", "t"), order, False).select("lang", "k").join(
            small(counts.select("lang").distinct()), "lang", "left_semi",
        ),
        "kn-wanted",
    )
    logp = written(kneser_ney(counts, wanted, order), "kn-logp")
    scored = written(perplexities(d, logp, order, shard_rows), "kn-scored")
    scored = scored.withColumn("perplexity", F.when(F.col("n") > 0, F.exp(F.col("nll") / F.col("n"))))
    cut = scored.join(ids.where(unseen), "id", "left_semi").groupBy("lang").agg((slack * F.percentile_approx("perplexity", quantile, 10000)).alias("threshold"))
    if rejected is not None:
        cut = cut.join(small(chosen_cut(scored, ids.where(unseen), rejected)), "lang", "left").select(
            "lang", F.coalesce("chosen", "threshold").alias("threshold"),
        )
    out = scored.join(small(cut), "lang", "left")
    kept = F.when(F.col("n") == 0, False).when(F.col("threshold").isNull(), True).otherwise(F.col("perplexity") <= F.col("threshold"))
    return out.select("id", "lang", F.col("n").alias("n_bytes"), "perplexity", "threshold", kept.alias("kept"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The documents all of whose labels call them good and none toxic."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x")).where("q = 1 and x = 0").select(F.col("doc_id").alias("id"))


def rejected_ids(labels: DataFrame) -> DataFrame:
    """(id, kind) of the documents that a label calls bad or toxic; toxic ones count as such whatever their quality."""
    x = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    return x.where("x = 1 or q = 0").select(
        F.col("doc_id").alias("id"), F.when(F.col("x") == 1, "toxic").otherwise("bad").alias("kind"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return kn_quality(table(spark, sf_dir, "documents"), trusted_ids(labels), rejected=rejected_ids(labels)).withColumnRenamed("id", "doc_id")
