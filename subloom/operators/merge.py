"""Merging encodings: of an array, or of the rows of a group in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subloom.functions.encoding import FIELDS, _struct, empty


def _step(acc: Column, enc: Column, growing: bool) -> Column:
    """acc holds (out, chars, words, n); spans and word ids of enc move by what came before, (0, 0) and null stay."""
    inserted = lambda o: (o["start"] == 0) & (o["end"] == 0)
    moved = F.transform(
        enc["offsets"],
        lambda o: F.when(inserted(o), o).otherwise(F.struct((o["start"] + acc["chars"]).alias("start"), (o["end"] + acc["chars"]).alias("end"))),
    )
    new = {
        "offsets": moved if growing else enc["offsets"],
        "word_ids": F.transform(enc["word_ids"], lambda w: w + acc["words"]),
    }
    out = _struct(lambda k: F.concat(acc["out"][k], new.get(k, enc[k])))
    far = F.coalesce(F.array_max(F.transform(enc["offsets"], lambda o: o["end"])), F.lit(0))
    last = F.coalesce(F.array_max(enc["word_ids"]), F.lit(0))  # an encoding without words still takes one
    return F.struct(out.alias("out"), (acc["chars"] + far).alias("chars"), (acc["words"] + last + 1).alias("words"))


def merge(encodings: Column | str, growing: bool = True) -> Column:
    """One encoding of an array of them, in order; none give the empty one, a single one stays as it is."""
    e = F.col(encodings) if isinstance(encodings, str) else encodings
    start = F.struct(empty().alias("out"), F.lit(0).alias("chars"), F.lit(0).alias("words"))
    return F.aggregate(e, start, lambda acc, x: _step(acc, x, growing), lambda acc: acc["out"])


def merge_groups(df: DataFrame, keys: list[str], order: str, enc: str, growing: bool = True) -> DataFrame:
    """(keys, enc): the encodings of each group merged in order.

    A merged encoding is one value, so a group is as large as its result must be; merge within bounded groups.
    """
    rows = F.array_sort(
        F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*[F.col(enc)[k].alias(k) for k in FIELDS]).alias("e"))),
        lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0),
    )
    return df.groupBy(*keys).agg(rows.alias("_r")).select(
        *keys, merge(F.transform("_r", lambda r: r["e"]), growing).alias(enc)
    )
