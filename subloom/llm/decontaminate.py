"""Benchmark decontamination by template canonicalisation: typed placeholders, a hash join of windows, slot consistency."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subloom.llm.common import held, table, written

#: Unit words that a re-parameterised question may exchange.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres "
    "dollar dollars euro euros cent cents eur usd gbp percent degree degrees mph kph kmh".split()
)
_EDGE = re.compile(r"^[^\w$€£%]+|[^\w$€£%]+$")
_NUMBER = re.compile(r"[$€£]?[0-9][0-9.,:/-]*%?")
_ATTACHED = re.compile(r"([$€£]?[0-9][0-9.,]*)([A-Za-zµ°]{1,4})")
_ENDS = frozenset(".,;:!?")  # after a word of letters alone there is nothing else to look at
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_MARK = {NUMBER: "<num>", NAME: "<name>", UNIT: "<unit>"}
_MARK_HASH = {k: xxhash.xxh64_intdigest(m, 7) for k, m in _MARK.items()}
WINDOW = 8


class Lexicon(dict):
    """word -> its index in three growing arrays; bounded: it starts anew before it holds limit words.

    A word that begins a sentence is compared in lower case; elsewhere a capital marks a name.
    """

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.names: list[tuple[str, str]] = []
        self.kind = np.zeros((2, 1024), np.int8)  # inside a sentence, and at its start
        self.hash = np.zeros((2, 1024), np.uint64)
        self.exact = np.zeros(1024, np.uint64)
        self.ends = np.zeros(1024, bool)

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.names)
        if i == len(self.ends):
            self.kind, self.hash, self.exact, self.ends = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in (self.kind, self.hash, self.exact, self.ends))
        both = canonical(word)
        for j, (kind, value) in enumerate(both):
            self.kind[j, i] = kind
            self.hash[j, i] = h = (_MARK_HASH.get(kind) or xxhash.xxh64_intdigest(value, 7)) if not j or both[0] is not both[1] else h
        self.ends[i] = word[-1:] in b".!?:" or (word[-2:-1] in b".!?" and word[-1:] in b"\"')")
        self.names.append((both[0][1], both[1][1]))
        return i

    def exact_of(self, ix: np.ndarray) -> np.ndarray:
        """Hashes of words as they are, made when they are first asked for."""
        for i in np.unique(ix[self.exact[ix] == 0]).tolist():
            self.exact[i] = xxhash.xxh64_intdigest(self.names[i][0], 8)
        return self.exact[ix]


def canonical(word: bytes) -> tuple[tuple[int, str], tuple[int, str]]:
    """(kind, value) of a word inside a sentence and at its start: a literal's value is its lower-case core, a slot's is
    what stands in it."""
    core = word.decode("utf-8", "replace")
    if core[-1:] in _ENDS and core[:-1].isalpha():
        core = core[:-1]
    elif not core.isalpha():
        core = _EDGE.sub("", core) or core
        if _NUMBER.fullmatch(core):
            x = NUMBER, core.strip("$€£%").rstrip(".,:")
            return x, x
        if m := _ATTACHED.fullmatch(core):
            x = NUMBER, m[1].strip("$€£") + " " + m[2].lower()
            return x, x
    low = core.lower()
    x = (UNIT if low in UNITS else LITERAL), low
    return (NAME, low) if x[0] == LITERAL and core[:1].isupper() else x, x


def template(text: str | None, lex: Lexicon, n: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word index, starts, kind, window hash) of a text's words. Windows of n words; fewer words form one window.

    Windows with fewer than half literal words say too little and get hash 0 (none).
    """
    words = (text or "").encode().split()
    if len(lex) + len(words) > lex.limit and len(lex):
        lex.reset()
    ix = np.fromiter(map(lex.__getitem__, words), np.int64, len(words))
    if not len(ix):
        return ix, ix.astype(bool), ix.astype(np.int8), ix.astype(np.uint64)
    starts = np.concatenate([[True], lex.ends[ix[:-1]]])
    side = starts.astype(np.int8)
    kind = lex.kind[side, ix]
    return ix, starts, kind, _hashes(lex.hash[side, ix], kind == LITERAL, min(n, len(ix)))


def _hashes(h: np.ndarray, literal: np.ndarray, n: int) -> np.ndarray:
    """The hashes of all windows of n words; 0 where fewer than half are literal."""
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + m]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    literal = np.concatenate([[0], np.cumsum(literal)])
    out[2 * (literal[n:] - literal[:-n]) < n] = 0
    return out


def readings(
    lex: Lexicon, ix, starts, kind, first, n: int, exact: bool,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(window hashes, starts, kind) of a text's readings of n words; first are the hashes of the literal one.

    In the literal reading a word that begins a sentence is a literal; in the second, given where it differs, a capital
    makes it a name there too; it meets only its like. The exact reading (kind None), if wanted, takes all words as they are.
    """
    yield first, starts, kind
    inside = lex.kind[0, ix]
    if (turned := inside != kind).any():
        h = _hashes(lex.hash[0, ix], inside == LITERAL, n)
        some = np.concatenate([[0], np.cumsum(turned)])
        h[some[n:] == some[:-n]] = 0
        h ^= np.where(h != 0, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        yield h, np.zeros_like(starts), inside
    if exact:
        yield _hashes(lex.exact_of(ix), np.ones(len(ix), bool), n), starts, None


def _window(lex: Lexicon, ix, starts, kind, at: int, n: int) -> tuple[str, list[str]]:
    """The window's template and the values of its slots, in order."""
    if kind is None:
        return " ".join(["=", *(lex.names[i][0] for i in ix[at : at + n])]), []
    parts, slots = [], []
    for j in range(at, min(at + n, len(ix))):
        value = lex.names[ix[j]][int(starts[j])]
        if kind[j] == LITERAL:
            parts.append(value)
        else:
            parts.append(_MARK[int(kind[j])])
            slots.append(f"{int(kind[j])}:{value}")
    return " ".join(parts), slots


def bloom(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two-probe Bloom filter of 2**bits bits, as bytes."""
    f = np.zeros(1 << bits, bool)
    mask = np.uint64((1 << bits) - 1)
    f[(hashes & mask).astype(np.int64)] = True
    f[((hashes >> np.uint64(32)) & mask).astype(np.int64)] = True
    return np.packbits(f, bitorder="little")


def _maybe(filter_: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    a = (hashes & mask).astype(np.int64)
    hit = ((filter_[a >> 3] >> (a & 7).astype(np.uint8)) & 1).astype(bool)
    at = np.flatnonzero(hit)  # few are left for the second probe
    b = ((hashes[at] >> np.uint64(32)) & mask).astype(np.int64)
    hit[at] = (filter_[b >> 3] >> (b & 7).astype(np.uint8)) & 1
    return hit


_ROWS = "id long, at array<int>, n int, base long, h long, template string, slots array<string>"


def windows(
    texts: DataFrame, n: int = WINDOW, keep: np.ndarray | None = None, bits: int = 0, short: tuple[int, ...] = (),
    exact: bool = False,
) -> DataFrame:
    """(id, at, n, base, h, template, slots) of the template windows of texts(id, t), in all readings.

    Without a filter the texts are items: n is the length of a window, n words or all of a shorter text, and base the
    hash of its literal reading. An item none of whose windows has enough literal words is read exactly. With a filter they are
    documents: windows of n words and of each of the short lengths, read exactly too if exact, and only those that
    the filter may hold. A window whose template and slots occur again in the same text is given once, with all places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held("decontaminate", Lexicon)
        schema = pa.schema([
            ("id", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.int32()), ("base", pa.int64()),
            ("h", pa.int64()), ("template", pa.string()), ("slots", pa.list_(pa.string())),
        ])
        for b in batches:
            rows = []
            for id_, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ix, starts, kind, full = template(t.as_py(), lex, n)
                if not len(ix):
                    continue
                for m in (min(n, len(ix)),) if keep is None else (n, *short):
                    if m > len(ix):
                        continue
                    first = full if m == min(n, len(ix)) else _hashes(
                        lex.hash[starts.astype(np.int8), ix], kind == LITERAL, m,
                    )
                    seen: dict[tuple, list[int]] = {}
                    for h, s, k in readings(
                        lex, ix, starts, kind, first, m, exact if keep is not None else not first.any(),
                    ):
                        some = h != 0
                        if keep is not None:
                            some &= _maybe(keep, h, bits)
                        base = h if k is None else first
                        for at in np.flatnonzero(some & (base != 0)).tolist():
                            what, slots = _window(lex, ix, s, k, at, m)
                            what = what if k is None or k is kind else "~ " + what
                            if (key := (what, *slots)) in seen:
                                seen[key].append(at)
                            else:
                                seen[key] = [at]
                                rows.append((
                                    id_, seen[key], m, int(base[at].astype(np.int64)), int(h[at].astype(np.int64)),
                                    what, slots,
                                ))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                        schema=schema,
                    )
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema,
                )

    return texts.mapInArrow(run, _ROWS)


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    n: int = WINDOW, min_share: float = 0.3, min_consistency: float = 0.75, bloom_bits: int = 23,
) -> DataFrame:
    """(id, item_id, n_shared, n_windows, consistency): the pairs of a document and a benchmark item it holds.

    A pair counts if the document shares at least min_share of the item's distinct template windows and the slot
    values map consistently: of the pairs (item value, document value) seen, the share that a one-to-one
    reading explains is at least min_consistency. Both are asked of the whole document and of each occurrence (matches of
    one or about one alignment, where values that stay the same always fit), so copies with other values don't hide each other.
    Items of under n words are sought in windows of their own length, and items without literal windows by their words.

    Document windows are screened by a Bloom filter of the item windows (2**bloom_bits bits whatever the
    inputs; it lets false ones through, never drops a true one) before the hash join on (hash, template). Null
    and empty texts match nothing; null ids are kept as they are; repeated rows of an id count as one document;
    no items give no rows.
    """
    it = written(
        windows(items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("t")), n), "items",
    )
    it = it.select(
        F.col("id").alias("item_id"), F.get("at", F.lit(0)).alias("item_at"), F.col("n").alias("len"), "base", "h",
        "template", F.col("slots").alias("item_slots"),
    )
    spark = docs.sparkSession
    # the filter is built in parts of fixed size and or-ed: the driver sees no hashes
    bits = bloom_bits

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            f |= bloom(b.column(0).to_numpy().astype(np.int64).view(np.uint64), bits)
        yield pa.RecordBatch.from_arrays([pa.array([f.tobytes()], pa.binary())], ["f"])

    f = np.zeros((1 << bits) // 8, np.uint8)
    for r in it.select("h").coalesce(8).mapInArrow(part, "f binary").collect():  # at most 8 rows of 2**bits / 8 bytes
        f |= np.frombuffer(bytes(r["f"]), np.uint8)
    n_win = it.groupBy("item_id").agg(F.count_distinct("base").alias("n_windows"))
    short = tuple(r["len"] for r in it.where(F.col("len") < n).select("len").distinct().collect())  # at most n - 1
    exact = not it.where(F.col("template").startswith("= ")).isEmpty()
    hit = windows(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), n, f, bits, short, exact,
    )
    hit = hit.select("id", "at", "h", "template", "slots").distinct()
    met = written(
        hit.join(it, ["h", "template"]).select(
            "id", "item_id", "base", "len", "slots", "item_slots", F.explode("at").alias("at"), "item_at",
        ),
        "leaks",
    )
    by = W.partitionBy("id", "item_id").orderBy("diag")
    met = met.withColumn("diag", F.col("at") - F.col("item_at"))
    met = met.withColumn("new", (F.col("diag") - F.lag("diag").over(by) > F.col("len") / 2).cast("int"))
    met = met.withColumn("occ", F.coalesce(F.sum("new").over(by), F.lit(0)))
    met = met.select("id", "item_id", "base", "slots", "item_slots", F.explode(F.array(2 * F.col("occ").cast("long"), 2 * (F.col("diag").cast("long") + (1 << 31)) + 1, F.lit(-1).cast("long"))).alias("occ"))  # about one alignment, just one, the whole document
    key = ["id", "item_id", "occ"]
    share = met.groupBy(*key).agg(F.count_distinct("base").alias("n_shared"))
    pair = met.select(*key, F.explode(F.arrays_zip("item_slots", "slots")).alias("x")).select(*key, F.col("x.item_slots").alias("a"), F.col("x.slots").alias("b")).distinct()
    other = (F.col("occ") < 0) | (F.col("a") != F.col("b"))
    fits = pair.groupBy(*key).agg(
        F.count_distinct(F.when(other, F.col("a"))).alias("na"),
        F.count_distinct(F.when(other, F.col("b"))).alias("nb"), F.count_if(~other).alias("same"),
        F.count("*").alias("np"),
    )
    out = share.join(n_win, "item_id").join(fits, key, "left")
    out = out.withColumn("consistency", F.coalesce((F.col("same") + F.least("na", "nb")) / F.col("np"), F.lit(1.0)))
    out = out.where((F.col("n_shared") >= min_share * F.col("n_windows")) & (F.col("consistency") >= min_consistency))
    return out.groupBy("id", "item_id").agg(
        F.max("n_shared").alias("n_shared"), F.max("n_windows").alias("n_windows"),
        F.max("consistency").alias("consistency"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")
