"""What the corpus operators share: tables, shared storage, lineage cuts and connected components."""

from __future__ import annotations

import atexit
import functools
import operator
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and \\x09-\\x0D; the same in Java, Python (bytes.split()) and RE2.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, on a local master alone, one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='subloom-')}"
        spark.sparkContext.setCheckpointDir(at)
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; Hadoop removes it when the driver ends."""
    path = f"{shared_dir(spark)}/subloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back. A lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(top)
        if "/subloom-" in top:
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most so many (narrow) rows, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_HELD: dict = {}


def held(name: str, make: Callable[[], object] = lambda: None):
    """What an operator remembers in this worker process. Workers serve many operators in turn, so whoever asks drops
    what others have left: a worker holds one memory at a time."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


FILTER_BITS = 24  # 2 MB, whatever the number of keys


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Four places of each 64-bit key in a filter of 2**bits bits."""
    h = keys.view(np.uint64)
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
        x = (h ^ (h >> np.uint64(31))) * np.uint64(odd)
        yield ((x ^ (x >> np.uint64(29))) >> np.uint64(64 - bits)).astype(np.int64)


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test of longs that is true for every key of keys (one long column) and for some others.

    A Bloom filter of fixed size: however many the keys, at most four times 2**bits / 8 bytes reach the driver, and one
    such array the executors. The fuller it is the more others it lets through; whoever asks looks at those exactly.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            if pa.types.is_binary(b.schema.field(0).type):
                for x in b.column(0):
                    f |= np.frombuffer(x.as_buffer(), np.uint8)
                continue
            k = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            for at in _places(k, bits):
                np.bitwise_or.at(f, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([f.tobytes()], pa.binary())], ["f"])

    few = keys.coalesce(32).mapInArrow(merged, "f binary").repartition(4).mapInArrow(merged, "f binary")
    f = np.zeros((1 << bits) // 8, np.uint8)
    for r in few.collect():  # at most four rows
        f |= np.frombuffer(bytes(r["f"]), np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(f.tobytes())

    @F.arrow_udf("boolean")
    def maybe(k: pa.Array) -> pa.Array:
        f, k = np.frombuffer(shared.value, np.uint8), k.fill_null(0).to_numpy(zero_copy_only=False)
        hit = np.ones(len(k), bool)
        for at in _places(k, bits):
            hit &= (f[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return pa.array(hit)

    return maybe


def _told_apart(
    docs: DataFrame, keys: DataFrame, at: dict[str, Column], how: str, more: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose key is certainly not in keys, the others after a join of the kind how with keys).

    more names columns of keys, one row a key, that come along; null in the first table.
    """
    more = more or []
    keys = written(keys.select(*at, *more).distinct(), "keys")
    maybe = key_filter(keys.select(F.xxhash64(*at)))
    own = {n: f"_subloom_{n}" for n in at}
    d = docs.withColumns({own[n]: c for n, c in at.items()})
    test, names = maybe(F.xxhash64(*own.values())), [F.col(f"`{c}`") for c in docs.columns]
    some = d.where(test)
    same = functools.reduce(operator.and_, [some[own[n]].eqNullSafe(keys[n]) for n in at])
    none = [F.lit(None).cast(keys.schema[m].dataType).alias(m) for m in more]
    return d.where(~test).select(*names, *none), some.join(keys, same, how).select(
        *[some[c] for c in docs.columns], *[keys[m] for m in more]
    )


def beside(docs: DataFrame, keys: DataFrame, more: list[str], **at: Column) -> DataFrame:
    """Every row of docs with the columns more of the row of keys that has its key; null where none has."""
    clear, rest = _told_apart(docs, keys, at, "left", more)
    return clear.unionAll(rest)


def without(docs: DataFrame, keys: DataFrame, **at: Column) -> DataFrame:
    """The rows of docs whose key at (column of keys: expression over docs) is not in keys; null equals null.

    Rows that a filter of fixed size lets through go into an exact join; the others, whole texts above all, stay
    where they are.
    """
    clear, rest = _told_apart(docs, keys, at, "left_anti")
    return clear.unionAll(rest)


def only(docs: DataFrame, keys: DataFrame, **at: Column) -> DataFrame:
    """The rows of docs whose key is in keys, likewise."""
    return _told_apart(docs, keys, at, "left_semi")[1]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of its component.

    Alternating large-star and small-star rounds: each node looks only at the minimum of its neighbourhood
    (a partial aggregate), so a hub's neighbours never meet in one task; the joins that hand the minimum back
    are plain equi-joins that adaptive execution can split. Every round is written to the shared folder.
    Nulls and self-loops are dropped; no edges give no rows.
    """

    def round_of(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(low, "a")
        return small.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges",
    )
    before = mark(e)
    while before[0]:
        new = written(round_of(e), "edges")
        remove(e)
        e, now = new, mark(new)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
