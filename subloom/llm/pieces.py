"""SentencePiece encoding and decoding: N-best segmentation by backward A* over the piece lattice."""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subloom.llm.common import held, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a SPACE that the text itself holds, so that it comes back as it was: a lone surrogate, which no text has.
LITERAL_SPACE = "\udc81"


class Vocabulary:
    """Pieces, scores and byte fallback of a model file; small and of fixed size, so it travels with the tasks."""

    def __init__(self, pieces: dict[str, tuple[int, float]], spelled: list[bytes], byte_ids: list[int], unk_id: int):
        self.pieces, self.spelled, self.byte_ids, self.unk_id = pieces, spelled, byte_ids, unk_id
        self.mark = zlib.crc32(b"\0".join(spelled))
        self.unk_score = min((s for _, s in pieces.values()), default=0.0) - 10.0
        #: every beginning of a piece; the whole pieces carry (id, score)
        self.begins: dict[str, tuple[int, float] | None] = {p[:k]: None for p in pieces for k in range(1, len(p))} | pieces
        # two neighbouring characters that stand so in no piece are a cut: no path of the lattice crosses it
        chars = sorted({c for p in pieces for c in p})
        self.kind = np.zeros(0x110000, np.uint16)  # 0: in no piece
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        n = len(chars) + 1
        pairs = {(p[k], p[k + 1]) for p in pieces for k in range(len(p) - 1)}
        joined = np.zeros(n * n, bool)
        joined[[int(self.kind[ord(x)]) * n + int(self.kind[ord(y)]) for x, y in pairs]] = True
        self.joined, self.kinds = np.packbits(joined, bitorder="little"), n

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spelled, byte_ids = {}, [], [-1] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                spelled.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                spelled.append(b"")
            else:
                spelled.append(p.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    pieces[p] = (i, sp.get_score(i))
        return cls(pieces, spelled, byte_ids, sp.unk_id())

    def ids_of_unknown(self, c: str) -> list[int]:
        ids = [self.byte_ids[b] for b in (SPACE if c == LITERAL_SPACE else c).encode()]
        return [self.unk_id] if -1 in ids else ids

    def cut(self, text: str) -> list[str]:
        """The parts of a text (space marks in place) between cuts."""
        k = self.kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        at = k[:-1] * self.kinds + k[1:]
        ends = np.flatnonzero(((self.joined[at >> 3] >> (at & 7).astype(np.uint8)) & 1) == 0) + 1
        ends = [*ends.tolist(), len(text)]
        return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


Edge = tuple[int, float, int]  # start, score, id; -1 is an unknown character


def lattice(v: Vocabulary, part: str) -> tuple[list[float], list[list[Edge]]]:
    """The Viterbi score of every prefix of part, and the edges into every place."""
    size, get = len(part), v.begins.get
    low = float("-inf")
    best = [0.0] + [low] * size
    into: list[list[Edge]] = [[] for _ in range(size + 1)]
    for s in range(size):
        at, one = best[s], False
        for e in range(s + 1, size + 1):
            hit = get(part[s:e], 0)
            if hit == 0:
                break  # no piece begins like this
            if hit:
                into[e].append((s, hit[1], hit[0]))
                if at + hit[1] > best[e]:
                    best[e] = at + hit[1]
                one = one or e == s + 1
        if not one:
            into[s + 1].append((s, v.unk_score, -1))
            if at + v.unk_score > best[s + 1]:
                best[s + 1] = at + v.unk_score
    return best, into


def nbest(v: Vocabulary, part: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations (score, ids), best first.

    Forward: the Viterbi score of every prefix. Backward: A* from the end, whose estimate of what is left is that
    score. It is exact, so paths complete in order of their score and no path outside the n best is finished. Of equal
    scores the one whose last pieces are longer comes first.
    """
    best, into = lattice(v, part)
    found: list[tuple[float, list[int]]] = []
    count = itertools.count()
    heap: list = [(-best[-1], len(part), 0, 0.0, None)]
    while heap and len(found) < n:
        _, at, _, done, path = heapq.heappop(heap)
        if not at:
            ids: list[int] = []
            while path is not None:
                s, i, path = path
                ids += v.ids_of_unknown(part[s]) if i < 0 else [i]
            found.append((done, ids))
            continue
        for s, score, i in into[at]:
            total = done + score
            heapq.heappush(heap, (-(best[s] + total), s, next(count), total, (s, i, path)))
    return found


def best_and_gap(v: Vocabulary, part: str) -> tuple[float, list[int], float]:
    """The best score and ids, and how much worse the second best is (infinite if there is none).

    The best path is read off the forward scores, longer last pieces first: A*, whose estimate they are, would expand
    the same path alone. A path that isn't the best has an edge that isn't on it; the best path through each edge is a prefix score, the
    edge and the best score of the rest, so one pass backward gives the second best.
    """
    best, into = lattice(v, part)
    size = len(part)
    low = float("-inf")
    rest = [low] * size + [0.0]
    ids: list[int] = []
    second, node = low, size
    for e in range(size, 0, -1):
        after = rest[e]
        if after == low:
            continue
        on = node == e
        for s, score, i in into[e]:
            if score + after > rest[s]:
                rest[s] = score + after
            if on and best[s] + score == best[e]:
                on, node = False, s
                ids += [i] if i >= 0 else v.ids_of_unknown(part[s])[::-1]
            elif best[s] + score + after > second:
                second = best[s] + score + after
    return best[size], ids[::-1], best[size] - second


class Segments(dict):
    """part -> its row: best ids, score and gap; bounded, it starts anew before it holds limit parts."""

    def __init__(self, v: Vocabulary, n: int, limit: int = 600_000):
        self.v, self.n, self.limit = v, n, limit
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids: list[bytes] = []
        self.best, self.gap = np.zeros(1024), np.zeros(1024)

    def __missing__(self, part: str) -> int:
        self[part] = i = len(self.ids)
        if i == len(self.best):
            self.best, self.gap = np.concatenate([self.best, self.best]), np.concatenate([self.gap, self.gap])
        if self.n == 1:  # nothing is asked of the second best
            self.best[i], ids = nbest(self.v, part, 1)[0]
        else:
            self.best[i], ids, self.gap[i] = best_and_gap(self.v, part)
        self.ids.append(np.array(ids, np.int32).tobytes())
        return i

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text as (score, ids in 32-bit little endian).

        Parts are independent, so an alternative of the whole differs in parts whose second choice costs little: only
        the n - 1 with the smallest gaps can take part in the n best, and only they are searched by A* for them. With
        n = 1 A* finds the best segmentation of every part.
        """
        parts = self.v.cut(SPACE + text.replace(SPACE, LITERAL_SPACE).replace(" ", SPACE)) if text else []
        if len(self) + len(parts) > self.limit and len(self):
            self.reset()
        ix = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        base = list(map(self.ids.__getitem__, ix.tolist()))
        total = float(self.best[ix].sum())
        if self.n == 1 or not len(ix):
            return [(total, b"".join(base))]
        gaps = self.gap[ix]
        k = min(self.n - 1, len(ix))
        near = np.sort(np.argpartition(gaps, k - 1)[:k]) if k < len(ix) else np.arange(len(ix))
        options: list[tuple[float, tuple]] = [(0.0, ())]
        for at in near.tolist():
            own = nbest(self.v, parts[at], self.n)
            options = heapq.nsmallest(
                self.n,
                ((d + own[0][0] - s, (*c, (at, ids)) if j else c) for d, c in options for j, (s, ids) in enumerate(own)),
                key=lambda x: x[0],
            )
        out = []
        for d, changes in options:
            mine = base if not changes else list(base)
            for at, ids in changes:
                mine[at] = np.array(ids, np.int32).tobytes()
            out.append((total - d, b"".join(mine)))
        return out


def _segments(v: Vocabulary, n: int) -> Segments:
    """One memo per worker process, vocabulary and N; workers serve many tasks."""
    return held(f"pieces {n} {v.mark}", lambda: Segments(v, n))


def decode_ids(v: Vocabulary, ids: bytes) -> str:
    """The text of ids (32-bit little endian): spelled bytes joined, without the space that encoding puts first."""
    out = b"".join(map(v.spelled.__getitem__, np.frombuffer(ids, np.int32).tolist())).decode("utf-8", "replace")
    return out[1:] if out.startswith(" ") else out


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1, model: str = MODEL,
) -> DataFrame:
    """(id, best array<struct<score double, ids array<int>>>): the n best segmentations of every whole text, best first.

    A null text gives a null list; an empty one the empty segmentation. Unknown characters become their UTF-8
    bytes. The vocabulary is read on the driver and shipped (its size is the model file's). No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    one = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _segments(shared.value, n)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # ids are wider than text: small batches go back
                b = whole.slice(at, 256)
                lists = [memo.encode(t) if t is not None else None for t in b.column(1).to_pylist()]
                flat = [x for found in lists if found for x in found]
                ids = np.frombuffer(b"".join(x for _, x in flat), np.int32)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for _, x in flat])]).astype(np.int32)
                inner = pa.StructArray.from_arrays(
                    [
                        pa.array([s for s, _ in flat], pa.float64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())),
                    ],
                    ["score", "ids"],
                )
                outer = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int32)
                mask = pa.array([x is None for x in lists])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(pa.array(outer), inner, mask=mask).cast(one)], ["id", "best"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, "id long, best array<struct<score:double,ids:array<int>>>",
    )


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """encoded with a column text, last: the text of its ids; a column text that it has goes. Null ids give null; byte runs
    that are not UTF-8 give U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    if ids != "text":
        encoded = encoded.drop("text")
    names = [c for c in encoded.columns if c != "text"]
    at = encoded.columns.index(ids)
    stay = [i for i, c in enumerate(encoded.columns) if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            col = b.column(at)
            text = [None if x is None else decode_ids(v, np.asarray(x, np.int32).tobytes()) for x in (y.values.to_numpy(zero_copy_only=False) if y.is_valid else None for y in col)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in stay), pa.array(text, pa.string())], [*names, "text"],
            )

    kept = [f for f in encoded.schema.fields if f.name != "text"]
    return encoded.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = encode(table(spark, sf_dir, "documents"), n=2).select(
        "id", F.get("best", F.lit(0)).alias("a"), F.get("best", F.lit(1)).alias("b"),
    )
    back = decode(best.select(
        "id", F.col("a.ids").alias("ids"), F.col("a.score").alias("score"), F.col("b.score").alias("second_score"),
        F.xxhash64("b.ids").alias("second_hash"),
    ))
    return back.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "score", "second_score",
        F.xxhash64("ids").alias("ids_hash"), "second_hash", F.crc32(F.encode("text", "utf-8")).alias("decoded_crc32"),
    )
