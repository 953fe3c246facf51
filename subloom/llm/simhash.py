"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.llm.common import connected_components, held, only, partitions, table, without, written


def shingles(text: str | None, n: int) -> list[bytes]:
    """n-word shingles, repeats included; fewer words give the whole sequence, none give none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(n)), strict=False)]


def simhash(text: str | None, n: int = 3, tables: int = 1) -> list[int]:
    """tables independent 64-bit fingerprints; a bit is set if over half the shingle hashes have it. No words: zero.

    Long texts are hashed in blocks, so memory does not follow the text's length times 64.
    """
    found = shingles(text, n)
    out = []
    for t in range(tables):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(found), 8192):
            h = np.fromiter((xxhash.xxh64_intdigest(x, 42 + t) for x in found[at : at + 8192]), "<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little"))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every whole text, as a long. Null and empty texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for b in batches:
            fps = [_signed(simhash(t.as_py(), n)[0]) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


def ball(fp: str, radius: int, bits: int = 64) -> F.Column:
    """All variants of fp with up to radius flipped bits, each with the mask that leads to it."""
    flips = [0]
    for _ in range(radius):
        flips = sorted({f ^ (1 << k) for f in flips for k in range(bits)} | set(flips))
    return F.transform(
        F.array(*[F.lit(_signed(f)) for f in flips]),
        lambda m: F.struct(F.col(fp).bitwiseXOR(m).alias("v"), m.alias("m")),
    )


def fingerprint_edges(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of fps(fp) that connect exactly the pairs within max_bits.

    max_bits is 0, 1 or 2. Every fingerprint emits the ball of half the radius (one bit) and is shuffled on the
    variants. For radius 2 all members of one variant lie within one bit of it, so they are within two
    bits of each other; the members of a variant are kept as one 64-bit mask of flipped bits (a fixed-size
    partial aggregate, at most 65 members) and are linked to the lowest one. The distance is verified again.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits is 0, 1 or 2")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    met = (
        # dealt out row by row: a repartition by the key that distinct has used would be dropped from the plan, and the ball
        # be left to the few tasks that a small table of fingerprints is merged into
        fps.select("fp").distinct().repartition(partitions(fps.sparkSession)).select(F.explode(ball("fp", 1)).alias("x")).select("x.v", "x.m")
        .groupBy("v").agg(F.bit_or("m").alias("mask"), F.max(F.col("m") == 0).alias("own"), F.count("*").alias("n"))
        .where("n > 1")
    )
    members = F.concat(
        F.when(F.col("own"), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>")),
        F.filter(F.array(*[F.lit(_signed(1 << k)) for k in range(64)]), lambda m: F.col("mask").bitwiseAND(m) != 0),
    )
    pairs = met.select(F.transform(members, lambda m: F.col("v").bitwiseXOR(m)).alias("fps"), "v")
    if max_bits == 2:  # a star on the lowest fingerprint: all of a variant's members are mutual neighbours
        pairs = pairs.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:  # only the pairs with the centre itself are one bit apart
        pairs = pairs.where(F.array_contains("fps", F.col("v"))).select(
            F.col("v").alias("a"), F.explode("fps").alias("b"),
        )
    return pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, max_bits: int = 2,
) -> DataFrame:
    """(id, fp, component): one row per document; component is the smallest id reachable over links.

    Copies share a fingerprint and collapse before any ball is hashed. Null or wordless texts have fingerprint
    zero and link like any other. Repeated rows stay repeated. No documents give no rows. Other columns of docs
    are ignored, whatever their names.
    """
    fp = written(fingerprints(docs, id_col, text_col, n), "simhash")
    low = written(fp.groupBy("fp").agg(F.min("id").alias("low")), "simhash-low")
    cc = connected_components(fingerprint_edges(low, max_bits))
    of = low.join(cc.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "low",
    )
    of = written(of, "simhash-roots")
    label = of.join(of.groupBy("root").agg(F.min("low").alias("component")), "root").select("fp", "component")
    return fp.join(label, "fp").select("id", "fp", "component")


TABLES, BITS = 14, 24  # a near print: 40 bits that tell tables and neighbourhoods apart, then 24 SimHash bits
PARTS = 64  # of the shingles' hash space, for the bound on what two texts share
_RNG = np.random.default_rng(512)
_XOR = _RNG.integers(0, 1 << 63, (TABLES, 1), dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, (TABLES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Every hash of h, spread anew for each table: (tables, len(h))."""
    x = (h ^ _XOR) * _ODD
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """XXH64 of the distinct n-word shingles, ascending."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in shingles(text, n)), np.uint64))


def near_prints(found: np.ndarray) -> np.ndarray:
    """One 64-bit print a table, of a set of shingle hashes that is not empty.

    The low BITS are a SimHash: a bit is set if over half the shingles have it. The others are a MinHash of the set in
    this table: texts whose least shingle differs never meet there, however many texts there are.
    """
    least, ones = np.full(TABLES, np.iinfo(np.uint64).max, np.uint64), np.zeros((TABLES, BITS), np.int64)
    for at in range(0, len(found), 2048):
        x = _mixed(found[at : at + 2048])
        least = np.minimum(least, x.min(axis=1))
        low = x.astype("<u8").view(np.uint8).reshape(TABLES, -1, 8)[:, :, : BITS // 8]
        ones += np.unpackbits(low, axis=2, bitorder="little").sum(axis=1, dtype=np.int64)
    bits = np.packbits(2 * ones > len(found), axis=1, bitorder="little").astype(np.uint64)
    low = bits[:, 0] | bits[:, 1] << np.uint64(8) | bits[:, 2] << np.uint64(16)
    high = (least[:, None] ^ _XOR[::-1]) * _ODD
    high = (high ^ (high >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (high >> np.uint64(BITS) << np.uint64(BITS))[:, 0] | low


def _ball24() -> Column:
    """The variants (v, m) of the print p in a ball of one bit; m names the bit, or the centre."""
    each = [(F.col("p"), 1 << BITS), *((F.col("p").bitwiseXOR(F.lit(1 << k)), 1 << k) for k in range(BITS))]
    return F.explode(F.array(*[F.struct(v.alias("v"), F.lit(m).alias("m")) for v, m in each]))


def _members() -> Column:
    """The prints that emitted the variant v, from the mask of their marks; at most BITS + 1."""
    own = F.when(F.col("mask").bitwiseAND(F.lit(1 << BITS)) != 0, F.array("v")).otherwise(F.array().cast("array<long>"))
    bits = F.array(*[F.lit(1 << k) for k in range(BITS)])
    flipped = F.transform(
        F.filter(bits, lambda m: F.col("mask").bitwiseAND(m) != 0), lambda m: F.col("v").bitwiseXOR(m.cast("long")),
    )
    return F.concat(own, flipped)


def met_prints(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shared(p), pairs(a, b)) of each(u, p), texts and their prints.

    shared are the prints that lie within two bits of another one or belong to several texts. pairs are first candidates, a linear
    number: every text of a print with the least text of that print; and that of every print with those of the
    lowest and of the highest print near it. Ball hashing: prints emit the ball of radius one and meet on
    its variants, whose members are a mask (a partial aggregate of fixed size). Only prints whose MinHash occurs with another
    print emit.
    """
    low = written(each.groupBy("p").agg(F.min("u").alias("u"), F.count("*").alias("n")), "near-low")
    place = F.shiftright("p", BITS)
    some = low.groupBy(place.alias("place")).agg(F.count("*").alias("k")).where("k > 1").select("place")
    emit = low.select("p", place.alias("place")).join(some, "place", "left_semi")
    met = emit.select(_ball24().alias("x")).groupBy("x.v").agg(F.bit_or("x.m").alias("mask")).where("bit_count(mask) > 1")
    met = met.select(_members().alias("all"))
    near = met.select(F.explode("all").alias("p"), F.array_min("all").alias("lo"), F.array_max("all").alias("hi"))
    near = written(near.groupBy("p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "near-met")
    twice = low.where("n > 1")
    same = each.join(twice.select("p", F.col("u").alias("a")), "p").where("u <> a").select("a", F.col("u").alias("b"))
    other = near.select("p", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("q")).where("p <> q")
    other = other.join(low.select("p", F.col("u").alias("a")), "p").join(
        low.select(F.col("p").alias("q"), F.col("u").alias("b")), "q",
    )
    other = other.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return written(near.select("p").union(twice.select("p")).distinct(), "near-shared"), written(same.union(other).distinct(), "near-pairs")


def linked_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose sets(u, n, parts, s) have a Jaccard similarity of at least similarity.

    First a bound that is never too low: two sets share no more than the lesser count in each part of the hash space.
    """
    share = similarity / (1 + similarity)  # of the sum of the sizes
    slim = lambda x: sets.select(F.col("u").alias(x), F.col("n").alias(f"n{x}"), F.col("parts").alias(f"p{x}"))
    likely = pairs.join(slim("a"), "a").join(slim("b"), "b").where(_common("pa", "pb") >= share * (F.col("na") + F.col("nb")) - 1e-9)
    likely = written(likely.select("a", "b", "na", "nb"), "near-likely")
    full = lambda x: sets.select(F.col("u").alias(x), F.col("s").alias(f"s{x}"))
    both = likely.join(full("a"), "a").join(full("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return written(
        both.where(shared >= similarity * (F.col("na") + F.col("nb") - shared)).select("a", "b"), "near-edges",
    )


def _common(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.least(a, b)), F.lit(0), lambda s, c: s + c)


def pairs_between(each: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of texts that meet in each(u, p), whose groups in roots(node, root) differ and whose sets may be similar.

    Pairs within a group can't change the groups, so with these no candidate that matters is left out. What is left out
    otherwise can be shown to be less similar: a shingle that only one of the texts here holds is shared with none.
    So a text of n shingles, c of them held by others too, links only with texts of at most c (1 + s) / s - n shingles,
    and two share no more than the lesser count of such shingles in each part. These bounds are asked of variants, of prints
    and of texts in turn, so a dense group of copies that are not all similar to each other gives few pairs.
    """
    up = (1 + similarity) / similarity
    ids = each.join(roots.select(F.col("node").alias("u"), "root"), "u", "left").select("u", "p", F.coalesce("root", "u").alias("root"))
    ids = written(ids, "near-members")
    part = ids.groupBy("p").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    ball = part.select(_ball24().alias("x"), "lo", "hi").groupBy("x.v").agg(
        F.bit_or("x.m").alias("mask"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )
    mixed = written(ball.where("lo <> hi").select(F.explode(_members()).alias("p")).distinct(), "near-mixed")
    ids = ids.join(mixed, "p", "left_semi")
    held = sets.join(ids.select("u").distinct(), "u", "left_semi").select("u", F.explode("s").alias("h"))
    alone = held.groupBy("h").agg(F.count("*").alias("k"), F.min("u").alias("u")).where("k = 1")
    alone = alone.select("u", F.expr(f"int(h & {PARTS - 1})").alias("i")).groupBy("u").agg(F.collect_list("i").alias("alone"))  # at most a text's shingles
    gone = F.coalesce("alone", F.array().cast("array<int>"))
    rest = sets.select("u", "n", "parts").join(alone, "u", "left")
    rest = rest.select(
        "u", "n", F.transform("parts", lambda c, i: c - F.size(F.filter(gone, lambda x: x == i))).alias("parts"),
    )
    rest = rest.withColumn("most", up * F.aggregate("parts", F.lit(0), lambda s, c: s + c) - F.col("n") + 1e-6)
    ids = written(ids.join(rest.where(F.col("most") >= similarity * F.col("n")), "u"), "near-ids")
    entry = F.struct("p", "lo", "hi", "least", "most", "k")
    prints = ids.groupBy("p").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("most").alias("most"),
        F.count("*").alias("k"),
    )
    all_ = prints.select(_ball24().alias("x"), entry.alias("e")).groupBy("x.v").agg(F.collect_list("e").alias("all"))  # at most BITS + 1
    able = F.filter("all", lambda e: e["most"] >= F.array_min(F.transform("all", lambda o: o["least"])))
    fit = lambda x, y: (x["p"] <= y["p"]) & (F.least(x["lo"], y["lo"]) < F.greatest(x["hi"], y["hi"])) & (x["most"] >= y["least"]) & (y["most"] >= x["least"])
    few = lambda x, y: F.when(x["k"] <= y["k"], F.struct(x["p"].alias("p"), y.alias("o"))).otherwise(F.struct(y["p"].alias("p"), x.alias("o")))
    two = F.flatten(F.transform(able, lambda x: F.transform(F.filter(able, lambda y: fit(x, y)), lambda y: few(x, y))))
    two = written(all_.select(F.explode(two).alias("x")).select("x.p", "x.o").distinct(), "near-two")
    a = ids.select(
        "p", F.col("u").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("most").alias("ma"),
        F.col("parts").alias("pa"),
    )
    b = ids.select(
        F.col("p").alias("q"), F.col("u").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"),
        F.col("most").alias("mb"), F.col("parts").alias("pb"),
    )
    one = two.join(a, "p").where("(o.lo <> o.hi or o.lo <> ra) and ma >= o.least and na <= o.most").withColumn("q", F.col("o.p"))
    met = one.join(b, "q").where("ra <> rb and na <= mb and nb <= ma").where(up * _common("pa", "pb") >= F.col("na") + F.col("nb") - 1e-6)
    return written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-between")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """(id, x, root): one row per row of docs; x is XXH64 of the text, root the smallest id of its group of near copies.

    Equal texts (null is empty) are joined first, and one of each goes on. Texts link when the Jaccard similarity of
    their sets of n-word shingles is at least similarity; texts without words link with their equals only. Candidates are the
    pairs whose prints (see near_prints) differ by at most two bits in one of TABLES tables, found by ball
    hashing. A linear number of them (met_prints) is verified exactly and makes groups; then all that lie
    between different groups are (pairs_between). With p the chance that a SimHash bit differs, a pair of similarity s is a
    candidate in a table with s * P(Bin(24, p) <= 2): over all tables 0.97 at 0.8, 0.99 at 0.85. Groups are
    the same whatever the order of rows. Repeated rows repeat; two texts may share an id; null ids count as no id. No
    documents give no rows; other columns of docs are ignored.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for b in batches:
            sets = (shingle_set(t.as_py(), n) for t in b.column(4))
            found = pa.array([near_prints(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], found], ["id", "x", "crc", "len", "f"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            found = [shingle_set(t.as_py(), n) for t in b.column(4)]
            parts = [np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS).astype(np.int32) for s in found]
            cols = [
                pa.array([len(s) for s in found], pa.int32()), pa.array(parts, pa.list_(pa.int32())),
                pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *cols], ["id", "x", "crc", "len", "n", "parts", "s"])

    key = ["x", "crc", "len"]
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t"))
    d = d.select(
        "id", F.xxhash64("t").alias("x"), F.crc32(F.encode("t", "utf-8")).alias("crc"),
        F.octet_length("t").cast("long").alias("len"), "t",
    )
    fps = written(d.mapInArrow(prints, "id long, x long, crc long, len long, f array<long>"), "near-prints")
    texts = fps.groupBy(*key).agg(F.min("id").alias("id"), F.first("f").alias("f"))
    texts = written(texts.withColumn("u", F.monotonically_increasing_id()), "near-texts")
    each = texts.where("f is not null").select("u", F.explode("f").alias("p"))
    shared, pairs = met_prints(each)
    each = written(each.join(shared, "p", "left_semi").select("u", "p"), "near-each")
    own = written(texts.join(each.select("u").distinct(), "u", "left_semi").select("u", "id", *key), "near-own")
    sets = only(d, own, id=F.col("id"), x=F.col("x")).mapInArrow(
        sets_of, "id long, x long, crc long, len long, n int, parts array<int>, s array<long>",
    )
    # rows that repeat an id and a text come once; a text that another one's id and XXH64 let through is told apart by the rest of the key
    sets = sets.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("n", "parts", "s")])
    sets = written(sets.join(own.select("u", *key), key).select("u", "n", "parts", "s"), "near-sets")
    edges = linked_pairs(pairs, sets, similarity)
    roots = connected_components(edges)
    more = linked_pairs(pairs_between(each, roots, sets, similarity), sets, similarity)
    if not more.isEmpty():
        roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    of = written(
        texts.join(roots, texts.u == roots.node, "left").select(*key, "id", F.coalesce("root", "u").alias("u")),
        "near-groups",
    )
    label = of.join(of.groupBy("u").agg(F.min("id").alias("root")), "u").select(*key, "root")
    return fps.select("id", *key).join(label, key).select("id", "x", "root")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8,
) -> DataFrame:
    """The rows of docs, unchanged, without those whose group of near copies has a smaller id, or has one where they have none.

    Rows that share an id and a text stay or go together. No text that stays is shuffled, but for what a filter of fixed
    size lets through.
    """
    gone = near_duplicates(docs, id_col, text_col, n, similarity).where("not id <=> root").select("id", "x")
    return without(docs, gone, id=F.col(id_col).cast("long"), x=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = simhash_components(table(spark, sf_dir, "documents"))
    return c.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
