"""Quality rules with risk-controlled cutoffs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subloom.llm.common import held, small, table, written

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bangs",
)
_SPACES, _SYMBOLS, _WINDOW = " \t\n\x0b\x0c\r", "#*$%&|<>", 5
_UPPER = bytes(range(65, 91))

#: The cutoffs of each rule from lenient to strict. They are set before any holdout is seen, so
#: that the levels form one fixed testing sequence; a share above its cutoff rejects.
LEVELS = {
    "symbols_per_word": (2.0, 1.0, 0.8, 0.6, 0.45, 0.3),
    "upper_share": (0.98, 0.9, 0.8, 0.7, 0.6, 0.5),
    "bangs_per_word": (2.0, 1.0, 0.8, 0.6, 0.5, 0.4),
    "dup_line_share": (0.95, 0.8, 0.65, 0.5, 0.4, 0.3),
    "repeat_word_share": (0.199, 0.19, 0.18, 0.16, 0.14, 0.12),
    "mean_word_length": (60.0, 40.0, 30.0, 20.0, 16.0, 13.0),
}
NEVER = len(next(iter(LEVELS.values()))) + 1


def repeated_words(words: list[bytes], n: int = _WINDOW) -> int:
    """Words inside n-word windows that occur at least twice in the text, first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + n - max(i, end)
            end = i + n
    return covered


def text_stats(text: str | None) -> tuple[int, ...]:
    """STATS of one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    letters = upper + len(raw) - len(raw.translate(None, _UPPER.lower()))
    return (
        len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), dup,
        repeated_words(words), lines, letters, upper, text.count("!"),
    )


def corpus_stats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang",
    carry: bool = False,
) -> DataFrame:
    """(id, stratum, *STATS, base_failed, severity) for every row; severity is the first level that rejects, NEVER if none.

    With carry the whole row goes along as the struct row, so that it needs no join to come back.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    d = docs.select(F.col(id_col).cast("long").alias("id"), stratum.alias("stratum"), F.col(text_col).alias("t"), *row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            cols = list(zip(*[text_stats(t.as_py()) for t in b.column(2)], strict=True)) or [[] for _ in STATS]
            more = [b.column(3)] if carry else []
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *more, *[pa.array(c, pa.int64()) for c in cols]],
                ["id", "stratum", *(["row"] if carry else []), *STATS],
            )

    schema = T.StructType([
        d.schema["id"], d.schema["stratum"], *([d.schema["row"]] if carry else []),
        *[T.StructField(c, T.LongType()) for c in STATS],
    ])
    s = d.mapInArrow(run, schema)
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    value = {
        "symbols_per_word": per("n_symbols", "n_words"), "upper_share": per("n_upper", "n_letters"), "bangs_per_word": per("n_bangs", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_word_share": per("n_repeat_words", "n_words"), "mean_word_length": per("word_chars", "n_words"),
    }
    first = [F.coalesce(*[F.when(value[r] > c, F.lit(i + 1)) for i, c in enumerate(cuts)], F.lit(NEVER)) for r, cuts in LEVELS.items()]
    return s.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).withColumn("severity", F.least(*first))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), X ~ Bin(n, p), exactly summed from the top term down."""
    if k >= n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for i in range(k, -1, -1):
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        if term < total * 1e-17:
            break
    return min(1.0, total)


def certified_level(good: int, false: list[int], caught: list[int], alpha: float, delta: float) -> int:
    """The level to use: of those certified, the mildest that catches the most bad documents; 0 rejects nothing.

    Fixed-sequence testing from the mildest level on: level l is certified while the exact (Clopper-Pearson)
    upper bound of its false rejection rate at confidence 1 - delta is at most alpha, which is the same as
    P(Bin(good, alpha) <= false[l]) <= delta. The first failure ends the sequence, so no further correction
    is needed within a stratum.
    """
    ok = 0
    for f in false:
        if not good or binomial_cdf(int(f), int(good), alpha) > delta:
            break
        ok += 1
    best = max(caught[:ok], default=0)
    return caught.index(best) + 1 if best else 0


def cutoff_levels(stats: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05) -> DataFrame:
    """(stratum, level, n_good, n_false, n_strata): one certified level per stratum that has labelled documents.

    labels(id, quality): a document is good if all of its labels say 1, bad if one says 0; null labels are ignored.
    With probability 1 - delta, no stratum loses more than a share alpha of its good documents to the chosen
    level (Bonferroni over the strata). Documents that the base rule rejects are not counted.
    """
    lab = labels.where("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("q"))
    lev = range(1, NEVER)
    counts = (
        stats.where("not base_failed").select("id", "stratum", "severity").join(lab, "id").groupBy("stratum")
        .agg(
            F.count_if(F.expr("q = 1")).alias("n_good"),
            *[F.count_if(F.expr(f"q = 1 and severity <= {i}")).alias(f"f{i}") for i in lev],
            *[F.count_if(F.expr(f"q <> 1 and severity <= {i}")).alias(f"c{i}") for i in lev],
        )
    )
    counts = written(counts, "quality-strata")
    n_strata = counts.count()

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            rows = [
                (
                    r.stratum,
                    x := certified_level(
                        r.n_good, [getattr(r, f"f{i}") for i in lev], [getattr(r, f"c{i}") for i in lev], alpha,
                        delta / n_strata,
                    ),
                    r.n_good, getattr(r, f"f{x}") if x else 0, n_strata,
                )
                for r in p.itertuples()
            ]
            yield pd.DataFrame(rows, columns=["stratum", "level", "n_good", "n_false", "n_strata"])

    return counts.mapInPandas(choose, "stratum string, level int, n_good long, n_false long, n_strata long")


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    stratum_col: str | None = "lang", alpha: float = 0.03, delta: float = 0.05,
) -> DataFrame:
    """One row per row of docs: id, stratum, STATS, base_failed, severity, level, kept.

    kept is false if the base rule fails, or if the document's severity is within its stratum's certified level.
    Strata without (enough) labels reject nothing beyond the base rule. Null and empty texts have no words and
    fail the base rule; null strata form the stratum ''. No documents give no rows. Only the columns named are read.
    """
    stats = written(corpus_stats(docs, id_col, text_col, stratum_col), "quality")
    levels = written(cutoff_levels(stats, labels, alpha, delta), "quality-levels")
    return _judged(stats, levels)


def _judged(stats: DataFrame, levels: DataFrame) -> DataFrame:
    out = stats.join(small(levels.select("stratum", "level")), "stratum", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    return out.withColumn("kept", F.expr("not base_failed and severity > level"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    stratum_col: str | None = "lang", alpha: float = 0.03, delta: float = 0.05,
) -> DataFrame:
    """The rows of docs, unchanged, that quality_rules keeps.

    The statistics of all rows are taken where the rows are and joined to the labels without their texts; a second pass takes
    them again and drops rows in place, so no text is shuffled.
    """
    stats = written(corpus_stats(docs, id_col, text_col, stratum_col), "quality")
    levels = written(cutoff_levels(stats, labels, alpha, delta), "quality-levels")
    return _judged(corpus_stats(docs, id_col, text_col, stratum_col, carry=True), levels).where("kept").select("row.*")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(table(spark, sf_dir, "documents"), labelled(spark, sf_dir))
    return q.select(F.col("id").alias("doc_id"), *STATS[:5], "base_failed", "kept", "severity", "level")
