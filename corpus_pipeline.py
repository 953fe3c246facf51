"""Corpus pipeline: five filtering and encoding stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.llm import decontaminate, pieces, pii, quality_rules, simhash
from subloom.llm.common import table, without, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, quality_rules.labelled(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers, names and units, go."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).where("id is not null")
    return without(docs, found, id=F.col("doc_id").cast("long"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs, length_col="n_chars")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, score, ids): the best segmentation of what is left."""
    best = pieces.encode(docs).select("id", F.get("best", F.lit(0)).alias("a"))
    return best.select(
        F.col("id").alias("doc_id"), F.size("a.ids").cast("long").alias("n_pieces"),
        F.col("a.score").alias("score"), F.col("a.ids").alias("ids"),
    )


STAGES = [("quality_rules", rules), ("simhash", near_copies), ("decontaminate", benchmark_leaks), ("pii", personal_data), ("pieces", encoding)]
#: Trained thresholds, SimHash tables and A* search have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
