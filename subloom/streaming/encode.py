"""Encoding streams. Single and pair encoding is row by row and works on streams as it is; what needs a batch, padding to
the longest, takes each micro-batch for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from subloom.tokenizer import WordPieceTokenizer


def read_texts(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """A stream of the files that come into a folder; glob picks them by name."""
    r = spark.readStream.schema(schema).format(fmt)
    r = r.option("pathGlobFilter", glob) if glob else r
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).load(path)


def encode_stream(stream: DataFrame, tokenizer: WordPieceTokenizer, text: str, out: str = "encoding") -> DataFrame:
    return tokenizer.encode(stream, text, out)


def encode_batches(
    stream: DataFrame, tokenizer: WordPieceTokenizer, text: str, sink, out: str = "encoding",
) -> DataStreamWriter:
    """A writer that pads every micro-batch to its longest row and hands it to sink(df, batch_id).

    A batch may be run again after a failure, under the same id: sinks write by it.
    """
    return stream.writeStream.foreachBatch(lambda df, i: sink(tokenizer.encode_batch(df, text, out=out), i))
