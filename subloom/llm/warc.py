"""WARC archives as a Python data source: splits from the manifest, headers first, payloads only where asked for."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from subloom.llm.common import beside, scratch, table, written

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, "
    "payload_length long, refers_to string, profile string, headers map<string,string>, payload binary"
)
_HEADER = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type",
    "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length", "refers_to": "warc-refers-to", "profile": "warc-profile",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 16 << 20


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _clean(v: object) -> str:
    return re.sub(r"[\r\n\x00]+", " ", str(v)).strip()


def record(
    kind: str, record_id: str, payload: bytes = b"", *, uri: str | None = None, date: str = "1970-01-01T00:00:00Z",
    refers_to: str | None = None, digest: str | None = None, length: int | None = None, info: bool = False,
) -> bytes:
    """One uncompressed record. Responses hold the HTTP head and the payload, revisits the head alone."""
    length = len(payload) if length is None else length
    digest = digest or hashlib.sha1(payload).hexdigest()
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if info:
        block = payload
        head.append("Content-Type: application/warc-fields")
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
        head += [
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            f"X-Payload-Length: {length}",
        ]
        if kind == "revisit":
            head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_clean(refers_to)}>"]
        else:
            block += payload
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """One gzip member whose extra field 'sl' holds its compressed and raw lengths, so that readers can step over it."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    length: int

    def __init__(self, path: str, start: int, length: int):
        super().__init__(None)
        self.path, self.start, self.length = path, start, length


@dataclass
class Written(WriterCommitMessage):
    name: str
    blocks: list
    records: int


class Source:
    """Buffered bytes of one split; skip() steps over them without looking."""

    def __init__(self, f, length: int):
        self.f, self.left, self.buf = f, length, b""

    def fill(self, n: int) -> bool:
        while len(self.buf) < n and self.left:
            got = self.f.read(min(self.left, max(1 << 18, n - len(self.buf))))
            if not got:
                self.left = 0
                break
            self.left -= len(got)
            self.buf += bytes(got)
        return len(self.buf) >= n

    def take(self, n: int) -> bytes:
        self.fill(n)
        out, self.buf = self.buf[:n], self.buf[n:]
        return out

    def skip(self, n: int) -> None:
        inside = min(n, len(self.buf))
        self.buf = self.buf[inside:]
        if n > inside:
            step = min(n - inside, self.left)
            self.f.seek(self.f.tell() + step)
            self.left -= step


class Member:
    """Reads raw bytes of the record at hand, from a gzip member or a plain file, as far as asked for."""

    def __init__(self, src: Source):
        self.src, self.out, self.z, self.rest = src, b"", None, None
        if src.fill(4) and src.buf[:2] == b"\x1f\x8b":
            self.z = zlib.decompressobj(31)
            if src.buf[3] & 4 and src.fill(24) and src.buf[12:14] == b"sl":
                self.rest = struct.unpack("<I", src.buf[16:20])[0]

    def pull(self) -> bool:
        if self.z is None:
            if not self.src.fill(1):
                return False
            self.out += self.src.take(1 << 14)
            return True
        if self.z.eof or not (self.z.unconsumed_tail or self.src.fill(1)):
            return False
        if self.z.unconsumed_tail:
            self.out += self.z.decompress(self.z.unconsumed_tail, 1 << 14)
        else:
            piece = self.src.take(min(4096, self.rest) if self.rest else 4096)
            if self.rest is not None:
                self.rest -= len(piece)
            self.out += self.z.decompress(piece, 1 << 14)
        if self.z.eof and self.z.unused_data:
            self.src.buf = self.z.unused_data + self.src.buf
            if self.rest is not None:
                self.rest += len(self.z.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        at = self.out.find(mark)
        while at < 0 and self.pull():
            at = self.out.find(mark)
        if at < 0:
            return b""
        got, self.out = self.out[:at], self.out[at + len(mark) :]
        return got

    def exactly(self, n: int) -> bytes:
        if self.z is None:  # a plain file: no copy in small pieces
            more = n - len(self.out)
            if more > 0:
                self.out += self.src.take(more)
        parts, have = [self.out], len(self.out)
        self.out = b""
        while have < n and self.pull():
            parts.append(self.out)
            have += len(self.out)
            self.out = b""
        got = b"".join(parts)
        got, self.out = got[:n], got[n:]
        return got

    def end(self, n: int) -> None:
        """Leave the record with n raw bytes of its block unread."""
        if self.z is None:
            n += 4
            inside = min(n, len(self.out))
            self.src.buf = self.out[inside:] + self.src.buf
            self.src.skip(n - inside)
        elif self.rest is not None:
            self.src.skip(self.rest)
        else:
            while self.pull():
                self.out = b""


def read_records(src: Source, wanted, columns: list[str]) -> Iterator[dict]:
    """Records of a split. wanted(fields) sees the parsed header; the block of a record it turns down is never decoded."""
    block_too = "payload" in columns
    while src.fill(1):
        m = Member(src)
        head = m.until(b"\r\n\r\n")
        if not head.lstrip(b"\r\n").startswith(b"WARC/"):
            if not head.strip():
                return
            raise ValueError(f"no WARC record: {head[:40]!r}")
        h: dict[str, str] = {}
        for line in head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            h[k.strip().lower()] = v.strip()
        n = int(h.get("content-length", 0))
        row = {c: h.get(x) for c, x in _HEADER.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else None
        if (d := row["payload_digest"]) and d.lower().startswith("sha1:"):
            d = d[5:]
            row["payload_digest"] = base64.b32decode(d).hex() if len(d) == 32 else d.lower()
        row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
        if not wanted(row):
            m.end(n)
            continue
        if "headers" in columns:
            row["headers"] = list(h.items())
        if block_too:
            block = m.exactly(n)
            if (row["content_type"] or "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            row["payload"] = block if row["record_type"] != "revisit" else None
            n = 0
        m.end(n)
        yield row


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.columns, self.path, self.tests = schema.fieldNames(), options["path"], []
        self.block = int(options.get("blockBytes", BLOCK))

    def pushFilters(self, filters):
        """Equality, membership and prefixes of header fields are tested before a block is decoded; the rest go back."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo | In | StringStartsWith) and name in _HEADER and name != "payload_length":
                self.tests.append(("starts", name, f.value) if isinstance(f, StringStartsWith) else (
                    "in", name, [f.value] if isinstance(f, EqualTo) else list(f.value),
                ))
            elif isinstance(f, IsNotNull) and name in _HEADER:
                self.tests.append(("some", name, None))
            else:
                yield f

    def partitions(self):
        """One split per block of the manifest; files of other writers, which have none, are a split each."""
        fs, at = _fs(self.path)
        out = []
        found = [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.File]
        manifests = sorted(x.path for x in found if x.base_name.startswith("_manifest-"))
        for m in manifests:
            for name, blocks in json.loads(fs.open_input_file(m).read()):
                out += [Split(f"{at}/{name}", s, n) for s, n in blocks]
        if not manifests:
            out = [Split(x.path, 0, x.size) for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        return out or [Split("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        tests, columns = [(how, name, set(v) if how == "in" else v) for how, name, v in self.tests], self.columns
        wanted = lambda r: all(r[n] is not None and (how == "some" or (r[n] in v if how == "in" else r[n].startswith(v))) for how, n, v in tests)
        kinds = {"payload": pa.binary(), "payload_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string())}
        fields = pa.schema([(c, kinds.get(c, pa.string())) for c in columns])
        fs, _ = _fs(self.path)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start)
            rows, held = [], 0
            for r in read_records(Source(f, partition.length), wanted, columns):
                rows.append({c: r.get(c) for c in columns})
                held += 256 + len(r.get("payload") or b"")
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=fields)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=fields)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes one archive under a name of its own; only the names that the driver commits are in the manifest,
    so what a lost or repeated attempt has left is never read."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.block = options["path"], overwrite, int(options.get("blockBytes", BLOCK))
        self.level = int(options.get("level", 6))
        if overwrite:
            fs, at = _fs(self.path)
            if fs.get_file_info(at).type == pafs.FileType.Directory:
                fs.delete_dir_contents(at)

    def write(self, iterator):
        fs, at = _fs(self.path)
        fs.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        blocks, start, end, n = [], 0, 0, 0
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            first = member(
                record("warcinfo", f"urn:uuid:{uuid.uuid4()}", b"format: WARC File Format 1.1\r\n", info=True),
                self.level,
            )
            out.write(first)
            end = len(first)
            for b in iterator:
                for r in b.to_pylist():
                    raw = record(
                        r["record_type"], r["record_id"], r["payload"] or b"", uri=r.get("target_uri"),
                        refers_to=r.get("refers_to"), digest=r.get("payload_digest"), length=r.get("payload_length"),
                    )
                    packed = member(raw, self.level)
                    if end - start > self.block:
                        blocks.append([start, end - start])
                        start = end
                    out.write(packed)
                    end += len(packed)
                    n += 1
        return Written(name, [*blocks, [start, end - start]], n)

    def commit(self, messages):
        fs, at = _fs(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/_manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([[m.name, m.blocks] for m in messages if m is not None]).encode())

    def abort(self, messages):
        fs, at = _fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{at}/{m.name}")


class WarcDataSource(DataSource):
    """format("warc"): path; blockBytes; level. Give a schema to leave columns (the payload above all) unread."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


URN = "urn:page:"


def archive_records(
    pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url",
    min_revisit_bytes: int = 1000,
) -> DataFrame:
    """The records to write, one per row of pages: equal payloads of min_revisit_bytes or more point to the largest id.

    Payloads are equal if length and SHA-256 are. Keys alone are grouped and joined; the pages, payloads with them, stay where
    they are, but for those that revisit another and what a filter of fixed size lets through beside them. If one id has several rows,
    a revisit names that id, and the first response record of the id stands for them only where the rows' payloads agree.
    """
    p = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("target_uri"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload"),
    )
    p = p.withColumn("n", F.octet_length("payload").cast("long")).withColumn(
        "k", F.when(F.col("n") >= min_revisit_bytes, F.sha2("payload", 256)),
    )
    keys = written(p.where("k is not null and id is not null").select("id", "k"), "warc-keys")
    twice = keys.groupBy("k").agg(F.max("id").alias("to"), F.count("*").alias("c")).where("c > 1").select("k", "to")
    again = keys.join(twice, "k").where("id <> to").select("id", "k", "to")
    p = beside(p, again, ["to"], id=F.col("id"), k=F.col("k")).withColumn("again", F.col("to").isNotNull())
    return p.select(
        F.concat(F.lit(URN), "id").alias("record_id"),
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(F.col("again"), F.concat(F.lit(URN), "to")).alias("refers_to"),
        F.sha1("payload").alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = scratch(spark, "warc")
    archive_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").option("path", path).save()
    keep = "record_id string, record_type string, payload_digest string, payload_length long, refers_to string, payload binary"
    got = spark.read.format("warc").schema(keep).load(path).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.substring(c, len(URN) + 1, 30).cast("long")
    whole = F.col("record_type") == "response"  # what the archive really holds; revisits have only their headers
    return got.select(
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS d FROM pages),
     q AS (SELECT page_id, octet_length(b) AS n, d, max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q
"""
