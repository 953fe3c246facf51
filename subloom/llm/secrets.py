"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty of strings in sensitive contexts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subloom.llm.common import table

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs [0-9a-f]+ of 24 or more
#: Words that make what follows them sensitive, and the strings looked at there.
CONTEXT = re.compile(
    r"(?:key|secret|token|passw|pwd|auth|credential|private|bearer|signature|session|access)", re.IGNORECASE | re.ASCII,
)
#: A string begins after anything else or after '=', which also ends a base64 string.
START = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-](?=[A-Za-z0-9+/_=-]{15})")
BODY = re.compile(r"[A-Za-z0-9+/_=-]*")
REACH, AROUND = 48, 256
#: Identifiers and code fragments that prime the compressor.
IDENTIFIERS = (
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 import from return function class def self None null true false "
    "public private static void const string int float double boolean var let async await export default module require "
    "password passwd secret token api_key apikey access_key secret_key client_secret client_id username user_name authorization bearer "
    "credentials private_key public_key session_id signature certificate configuration settings environment variable example placeholder "
    "changeme your_password_here your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 test_token dummy sample localhost http:// https:// www. .com "
    "index.html application/json content-type user-agent get_value set_value initialize connection database host port timeout "
    "BEGIN PRIVATE KEY END PRIVATE KEY AWS_SECRET_ACCESS_KEY AWS_ACCESS_KEY_ID GITHUB_TOKEN the and of to in is that for it with as was on be by"
)
KINDS = ("assign", "access", "hex", "novel")


class Novelty:
    """Marginal compressed bytes of a string, given the dictionary and the text around it."""

    def __init__(self, dictionary: str = IDENTIFIERS, level: int = 6):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=level)
        self._z = zstandard.ZstdCompressor(dict_data=primed, write_checksum=False, write_content_size=False)

    def marginal(self, before: str, what: str, after: str) -> float:
        return len(self._z.compress((before + what + after).encode())) - len(self._z.compress((before + after).encode()))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(
    text: str, known: list[tuple[int, int, int]], novelty: Novelty, min_bits: float = 4.0,
) -> list[tuple[int, int, int]]:
    """Strings within REACH characters after a sensitive word whose marginal cost is at least min_bits a character.

    A string begins at a boundary, after '=' or where '_' or '-' joins it to the sensitive word (then it holds no '='
    but at its end), and goes on to its real end. The cost is taken against the AROUND characters before and after,
    with the string's other occurrences in them left in, so a repeated identifier costs next to nothing. Strings that
    touch a known span, or hold no digit beside letters, are left out; of strings within each other the outer one is given.
    """
    out: list[tuple[int, int, int]] = []
    tried: set[int] = set()
    run = (0, 0)  # the last run of string characters: its end serves all starts in it
    for c in CONTEXT.finditer(text):
        last = c.end() + REACH
        starts = [m.start() for m in START.finditer(text, c.end(), min(len(text), last + 16)) if m.start() <= last]
        joined = c.end() + 1 if text[c.end() : c.end() + 1] in ("_", "-") else -1
        for s in [joined, *starts] if joined >= 0 else starts:
            if not run[0] <= s < run[1]:
                run = s, BODY.match(text, s).end()
            e = run[1]
            if e - s < 16 or s in tried or (s == joined and "=" in text[s:e].rstrip("=")) or (out and s < out[-1][2]):
                continue
            tried.add(s)
            what = text[s:e]
            if any(a < e and s < b for a, _, b in known) or not (any(x.isdigit() for x in what) and any(x.isalpha() for x in what)):
                continue
            if 8 * novelty.marginal(text[max(0, s - AROUND) : s], what, text[e : e + AROUND]) >= min_bits * (e - s):
                out.append((s, 3, e))
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = 4.0) -> DataFrame:
    """(id, spans array<struct<kind,start,end,text>>) for every row of docs, by start, then kind.

    Offsets are code points, end exclusive. Null texts are empty; texts without secrets get an empty array. Base
    spans always stay; the novelty spans are added. Other columns are ignored. Rows stay in their partition: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e]} for s, k, e in sorted(base + novel_spans(text, base, novelty, min_bits))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, "id long, spans array<struct<kind:string,start:int,end:int,text:string>>"
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_spans(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long")
    return s.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text(F.filter("spans", lambda x: x.kind != "novel")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count("novel").alias("n_novel"),
    )
