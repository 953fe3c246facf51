"""Removal of repeated byte strings by bucket-pointer refinement of suffix buckets.

A 100-byte string is compared only where the same anchor leads: the leftmost least hash among its 32-byte grams.
Equal strings have equal anchors at equal places, so runs of windows with one anchor (about one for every 35
bytes) are what is shuffled. Runs that are equal as a whole are settled by one sort; the others of an anchor meet
in one task, where their suffixes are put into buckets by their first eight bytes and each bucket is refined by
sorting on the bucket pointers of later offsets, 8, 16, 32, then 36 bytes on, each level using the last one's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subloom.llm.common import table, written

SPAN, GRAM = 100, 32
_WINDOWS = SPAN - GRAM + 1  # grams in a string
_BLOCK = 4 << 20
_POS = (1 << 24) - 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(0, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK, HOT = 8_192, 16_384
_LENGTH = 24  # bits of a span's length: none is longer than a piece of _BLOCK windows


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all 32-byte grams, by doubling."""
    h, k = _BYTE[b], 1
    for m in _MULT:
        h = h[:-k] * m + h[k:]
        k *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def runs(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, anchor, anchor hash) of the maximal runs of windows with one anchor.

    b holds texts one after the other; text i is b[starts[i]:ends[i]].
    """
    none = np.zeros(0, np.int64)
    if len(b) < SPAN:
        return none, none, none, none, none.astype(np.uint64)
    h = gram_hashes(b)
    m = (h & ~np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        m = np.minimum(m[:-k], m[k:])
    k = _WINDOWS - 64
    m = np.minimum(m[:-k], m[k:])
    anchor = (m & np.uint64(_POS)).astype(np.int64)
    edge = np.zeros(len(m) + 1, np.int8)
    ok = ends - starts >= SPAN
    edge[starts[ok]] += 1
    edge[ends[ok] - SPAN + 1] -= 1
    inside = np.cumsum(edge[:-1]).astype(bool)
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(fresh)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    last = np.flatnonzero(stop)
    return np.searchsorted(starts, first, "right") - 1, first, last, anchor[first], h[anchor[first]]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c, doc, place): a row per run, place being at << 8 | n; c hashes the run's bytes and the anchor's place in them.

    Of runs that are equal as a whole, all but the first of a block are settled here: runs of them that follow each other
    make one row with n = 0, whose c is the number of its windows and whose h is a mix of its own place, so that what a
    block repeats is spread and not sorted with the anchor.
    """

    def flush(ids, offs, parts):
        raw = b"".join(parts)
        ends = np.cumsum([len(x) for x in parts])
        starts = ends - [len(x) for x in parts]
        of, first, last, anchor, h = runs(np.frombuffer(raw, np.uint8), starts, ends)
        rel = anchor - first
        c = [xxhash.xxh64_intdigest(raw[a:e], r) for a, e, r in zip(
            first.tolist(), (last + SPAN).tolist(), rel.tolist(), strict=True,
        )]
        at, c, doc = first - starts[of] + np.array(offs, np.int64)[of], np.array(c, np.uint64), np.array(ids, np.int64)[of]
        order = np.lexsort((at, doc, c, h))
        head = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]])]) if len(order) else np.zeros(0, bool)
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        again = np.zeros(len(order), bool)
        again[order] = (doc[order] != doc[lead]) | (at[order] != at[lead])  # a repeated row of one document is no repeat
        joins = np.zeros(len(order), bool)  # runs of a text lie side by side
        joins[1:] = again[1:] & again[:-1] & (of[1:] == of[:-1])
        keep = np.flatnonzero(~joins)
        end = last[np.append(keep[1:], len(order)) - 1] if len(keep) else last
        again, at, doc, h, n = again[keep], at[keep], doc[keep], h[keep], end - first[keep] + 1
        h = np.where(
            again,
            (h ^ (doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + at.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9),
            h,
        )
        c = np.where(again, n, c[keep].view(np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(c), pa.array(doc), pa.array(at << 8 | np.where(again, 0, n))],
            ["h", "c", "doc", "place"],
        )

    for b in batches:
        ids, offs, parts, size = [], [], [], 0
        for id_, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = (t.as_py() or "").encode()
            for o in range(0, max(1, len(raw) - SPAN + 1), _BLOCK):  # every window once, whatever the length
                piece = raw[o : o + _BLOCK + SPAN - 1]
                if size + len(piece) > 2 * _BLOCK:
                    yield flush(ids, offs, parts)
                    ids, offs, parts, size = [], [], [], 0
                ids.append(id_)
                offs.append(o)
                parts.append(piece)
                size += len(piece)
        if parts:
            yield flush(ids, offs, parts)


def refine(b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bucket pointers of depth SPAN by bucket-pointer refinement.

    b: bytes; room[p]: how many bytes from p on belong to the same context. For positions with room for SPAN bytes,
    equal pointers mean equal strings. Pointers of positions with less room stop at the depth they have room for.
    """
    n = len(b)
    ptr = np.full(n, -1, np.int64)
    wide = np.zeros(n + 8, np.uint64)
    for j in range(8):
        wide[: n - j] |= b[j:].astype(np.uint64) << np.uint64(56 - 8 * j)
    at = np.flatnonzero(room >= 8)
    order = at[np.argsort(wide[at])]
    key = wide[order]
    head = np.concatenate([[True], key[1:] != key[:-1]]) if len(order) else np.zeros(0, bool)
    ptr[order] = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    depth = 8
    while depth < SPAN:
        step = min(depth, SPAN - depth)  # the last pair overlaps: 64 bytes here and 64 bytes from 36 on
        active = np.flatnonzero((room >= depth + step) & (ptr >= 0))
        size = np.bincount(ptr[active], minlength=1)
        active = active[size[ptr[active]] > 1]  # singletons are in place
        key = ptr[active] * np.int64(n + 1) + ptr[active + step]
        order = np.argsort(key)
        active, key = active[order], key[order]
        old = ptr[active]
        i = np.arange(len(active))
        bucket = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), i, 0)) if len(i) else i
        group = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), i, 0)) if len(i) else i
        ptr[active] = old + group - bucket
        depth += step
    return ptr


def later_windows(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, first, last) of maximal runs of windows that equal a window of an earlier place in the list."""
    b = np.frombuffer(b"".join(contexts), np.uint8)
    length = np.array([len(x) for x in contexts])
    ends = np.cumsum(length)
    room = np.repeat(ends, length) - np.arange(len(b))
    ptr = refine(b, room)
    at = np.flatnonzero(room >= SPAN)
    _, first = np.unique(ptr[at], return_index=True)
    later = np.ones(len(at), bool)
    later[first] = False
    at = at[later]
    of = np.searchsorted(ends, at, "right")
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    end = np.concatenate([new[1:], [True]]) if len(at) else new
    begin = (ends - length)[of[new]]
    return of[new], at[new] - begin, at[end] - begin


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, start, stop) from rows (h, doc, at, ctx) sorted by them; whole anchors are taken CHUNK rows at a time."""

    def settle(rows):
        of, first, last = later_windows([r[3] for r in rows])
        doc = np.array([r[1] for r in rows], np.int64)[of]
        at = np.array([r[2] for r in rows], np.int64)[of]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(at + first), pa.array(at + last + SPAN)], ["doc", "start", "stop"],
        )

    rows: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and rows[-1][:3] == r[:3]:
                continue  # a repeated row of the same document
            if len(rows) >= CHUNK and rows[-1][0] != r[0]:
                yield settle(rows)
                rows = []
            rows.append(r)
    if rows:
        yield settle(rows)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, doc, at, ctx, hot) from documents (id, t, marks); those without marks give none."""
    for b in batches:
        out: list[tuple] = []
        for id_, t, marks in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            if not marks:
                continue
            raw = (t.as_py() or "").encode()
            for m in marks:
                at, n = divmod(m["place"], 256)
                out.append((m["h"], id_, at, raw[at : at + n + SPAN - 1], m["hot"]))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out, strict=True)], ["h", "doc", "at", "ctx", "hot"],
                )
                out = []
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*out, strict=True)], ["h", "doc", "at", "ctx", "hot"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, spans) -> id, n_bytes, n_removed, n_spans, kept, where spans (start << 24 | length) are what to remove, in
    any order."""
    for whole in batches:
        for o in range(0, whole.num_rows, 512):
            b = whole.slice(o, 512)
            rows = []
            for id_, t, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw = (t.as_py() or "").encode()
                if not spans.is_valid:
                    rows.append((id_, len(raw), 0, 0, raw))
                    continue
                s = spans.values.to_numpy()
                s, e = s >> _LENGTH, (s >> _LENGTH) + (s & ((1 << _LENGTH) - 1))
                edge = np.bincount(s, minlength=len(raw) + 1) - np.bincount(e, minlength=len(raw) + 1)
                gone = np.cumsum(edge)[: len(raw)] > 0
                rows.append((
                    id_, len(raw), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()),
                    np.frombuffer(raw, np.uint8)[~gone].tobytes(),
                ))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc, start, stop) byte spans to remove: every SPAN-byte string that also starts earlier (smaller id, or the same
    document further left); spans may overlap and repeat. Null texts are empty; texts under SPAN bytes have none;
    repeated rows (id and text) count as one document.

    An anchor whose different contexts number over hot does not go to one task: its windows are spread by a
    128-bit digest instead, and the least (document, place) of each stays.
    """
    d = _documents(docs, id_col, text_col)
    # one exchange by anchor serves both windows; runs are the bulk of what is shuffled
    anchors = d.mapInArrow(_anchor_rows, "h long, c long, doc long, place long").repartition("h")
    same, own = W.partitionBy("h", "c").orderBy("doc", "place"), W.partitionBy("h")
    met = (
        anchors.withColumn("r", F.rank().over(same)).withColumn("contexts", F.sum((F.col("r") == 1).cast("int")).over(own))
        .withColumns({"at": F.expr("shiftright(place, 8)"), "n": F.expr("place & 255")})
        .withColumn("windows", F.expr("CASE WHEN n = 0 THEN c WHEN r > 1 THEN n END"))
        .where("windows is not null or contexts > 1")
    )
    marks = written(
        met.select(
            "doc", F.expr(f"at + windows + {SPAN - 1}").alias("stop"), F.expr("CASE WHEN windows is null THEN h END").alias("h"),
            F.expr("CASE WHEN windows is null THEN place ELSE at END").alias("place"), (F.col("contexts") > hot).alias("hot"),
        ),
        "anchors",
    )
    full = marks.where("stop is not null").select("doc", F.col("place").alias("start"), "stop")
    part = marks.where("stop is null").groupBy("doc").agg(F.collect_list(F.struct("h", "place", "hot")).alias("marks"))
    # a left join, as in remove_repeats: both then read one exchange of the texts
    ctx = d.join(part, d.id == part.doc, "left").select("id", "t", "marks").mapInArrow(
        _contexts, "h long, doc long, at long, ctx binary, hot boolean",
    )
    kind = "doc long, start long, stop long"
    cool = ctx.where("not hot").select("h", "doc", "at", "ctx").repartition("h").sortWithinPartitions("h", "doc", "at").mapInArrow(_refined, kind)
    parts = [full, cool]
    if marks.where("hot and stop is null").limit(1).count():
        each = ctx.where("hot").distinct().select(
            "doc", "at", "ctx", F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - SPAN)).alias("s"),
        )
        key = F.md5(F.substring("ctx", F.col("s") + 1, F.lit(SPAN)))
        each = each.select("doc", (F.col("at") + F.col("s")).alias("start"), key.alias("g"))
        low = each.groupBy("g").agg(F.min(F.struct("doc", "start")).alias("low"))
        parts.append(each.join(low, "g").where("struct(doc, start) <> low").select(
            "doc", "start", (F.col("start") + SPAN).alias("stop"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary): every row of docs without its repeated spans. No documents give no rows."""
    span = F.expr(f"shiftleft(start, {_LENGTH}) | stop - start")
    spans = repeated_spans(docs, id_col, text_col, hot).groupBy("doc").agg(F.collect_list(span).alias("spans"))
    d = _documents(docs, id_col, text_col)
    return d.join(spans, d.id == spans.doc, "left").select("id", "t", "spans").mapInArrow(
        _cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary",
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute(texts: list[tuple[int, str | None]], span: int = SPAN) -> list[tuple[int, int, int, int, str]]:
    """The result by definition, for small inputs with distinct ids."""
    seen, out = set(), []
    for id_, t in sorted(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - span + 1):
            w = raw[s : s + span]
            if w in seen:
                gone[s : s + span] = b"\1" * span
            seen.add(w)
        runs_ = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((
            id_, len(raw), sum(gone), runs_,
            hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest(),
        ))
    return out


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
     w AS (SELECT doc_id, s, substr(x, CAST(2 * s + 1 AS BIGINT), 200) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS s FROM d)),
     r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
     i AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS b FROM r),
     j AS (SELECT doc_id, s, sum(b) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM i),
     v AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS e FROM j GROUP BY doc_id, k),
     z AS (SELECT doc_id, a, e FROM v UNION ALL SELECT doc_id, length(x) // 2, length(x) // 2 FROM d),
     y AS (SELECT doc_id, a, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a, e), 0) AS p FROM z),
     q AS (SELECT y.doc_id, string_agg(substr(x, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) AS h FROM y JOIN d USING (doc_id) GROUP BY y.doc_id),
     c AS (SELECT doc_id, sum(e - a) AS n, count(*) AS m FROM v GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(m, 0) AS BIGINT) AS n_spans,
       sha256(unhex(h)) AS kept_sha256
FROM d JOIN q USING (doc_id) LEFT JOIN c USING (doc_id)
"""
