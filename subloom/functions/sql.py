"""The tokenizer in SQL: functions wp_encode, wp_ids, wp_count, wp_decode and the table function wp_tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from subloom.functions.encoding import CONTENT
from subloom.operators.encode import to_arrow
from subloom.operators.kernel import Kernel
from subloom.tokenizer import WordPieceTokenizer


def register(spark: SparkSession, tokenizer: WordPieceTokenizer, prefix: str = "wp") -> None:
    """Register the functions for one tokenizer as it is now.

    <prefix>_encode(text) gives the content struct, _ids its ids, _count their number, _tokens(text) a row a token:
    SELECT d.doc_id, t.* FROM documents d, LATERAL wp_tokens(d.text) t.
    """
    kernel = tokenizer.kernel()

    @F.arrow_udf(CONTENT)
    def encode(b: pa.Array) -> pa.Array:
        return to_arrow([kernel.content(t) if t is not None else None for t in b.to_pylist()])

    @F.arrow_udf("array<int>")
    def ids(b: pa.Array) -> pa.Array:
        return pa.array([kernel.ids(t) if t is not None else None for t in b.to_pylist()], pa.list_(pa.int32()))

    @F.arrow_udf("int")
    def count(b: pa.Array) -> pa.Array:
        return pa.array([len(kernel.ids(t)) if t is not None else None for t in b.to_pylist()], pa.int32())

    for name, f in (("encode", encode), ("ids", ids), ("count", count)):
        spark.udf.register(f"{prefix}_{name}", f)
    spark.udtf.register(f"{prefix}_tokens", tokens_udtf(kernel))


def tokens_udtf(kernel: Kernel):
    """text -> (i, token, id, start, end, word_id) rows."""

    class Tokens:
        def eval(self, text: str | None) -> Iterator[tuple]:
            if text is not None:
                for i, row in enumerate(zip(*kernel.content(text), strict=True)):
                    yield (i, *row)

    return F.udtf(Tokens, returnType="i int, token string, id int, start int, end int, word_id int")
