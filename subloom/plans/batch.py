"""Plans over batches of rows: padding to the longest of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subloom.config import Padding
from subloom.functions.encoding import apply_padding, length


def pad_batch(df: DataFrame, enc: str, padding: Padding, pad_id: int, batch: str | None = None) -> DataFrame:
    """Every encoding padded to the longest of its batch (then to the multiple), or to the fixed length.

    batch names the column that tells batches apart; none makes the whole table one. Lengths are aggregated and
    joined back: a row per batch, whichever side of the join is moved, and no batch meets in one task.
    """
    if padding.length is not None:
        return df.withColumn(enc, apply_padding(enc, padding, pad_id))
    key = F.coalesce(F.col(batch).cast("string"), F.lit("\0")) if batch else F.lit("")
    d = df.withColumn("_batch", key)
    most = d.groupBy("_batch").agg(F.max(length(enc)).alias("_longest"))
    if batch is None:  # one row
        most = F.broadcast(most)
    return d.join(most, "_batch").withColumn(enc, apply_padding(enc, padding, pad_id, F.col("_longest"))).drop("_batch", "_longest")
