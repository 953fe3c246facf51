"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from subloom import queries as engine  # noqa: E402


def full_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Every field of every document's encoding, built and written nowhere."""
    return engine.tokenizer().encode(spark.read.parquet(f"{d}/documents.parquet"), "text").select("doc_id", "encoding")


HEADLINE = {
    "encode_document_ids": engine.QUERIES["encode_document_ids"], "count_document_tokens": engine.QUERIES["count_document_tokens"], "wordpiece_token_counts": engine.QUERIES["wordpiece_token_counts"],
    "full_encoding": full_encoding, "normalize_text": engine.QUERIES["normalize_text"], "encode_pair": engine.QUERIES["encode_pair"], "pad_batch_longest": engine.QUERIES["pad_batch_longest"], "decode_skip_special": engine.QUERIES["decode_skip_special"],
}


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    with tempfile.TemporaryDirectory() as split:
        # each table is one file with one row group, which only one task can read: deal it to 2 files a core first
        began = time.perf_counter()
        for name in ("documents", "conversations"):
            spark.read.parquet(f"{d}/{name}.parquet").repartition(2 * int(cpus)).write.parquet(f"{split}/{name}.parquet")
        measure(spark, split, d.rstrip("/").rsplit("/", 1)[-1], {"deal_input": round(time.perf_counter() - began, 3)})
    spark.stop()


def measure(spark: SparkSession, d: str, sf: str, seconds: dict[str, float]) -> None:
    """The dealing, which also starts the JVM's code, counts in the total."""
    run = lambda q: q.write.format("noop").mode("overwrite").save()
    run(engine.QUERIES["encode_single"](spark, d))  # starts the JVM's and the workers' code
    for name, q in HEADLINE.items():
        began = time.perf_counter()
        run(q(spark, d))
        seconds[name] = round(time.perf_counter() - began, 3)
    tokens = engine.QUERIES["count_document_tokens"](spark, d).agg(F.sum("n_tokens")).first()[0]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf,
        "tokens": tokens, "tokens_per_sec": round(tokens / seconds["encode_document_ids"]),
    }))


if __name__ == "__main__":
    main()
