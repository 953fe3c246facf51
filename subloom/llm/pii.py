"""Personal data: fixed patterns, high-recall generators and boosted trees, all as DataFrame expressions.

Nothing here leaves the JVM but sums over all spans: by feature and value, from which the trees grow, and by range of scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subloom.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns with possessive loops and anchored starts: each finds the same leftmost matches as the plain
#: form (a match can only begin where the last one ended or where its run of characters begins) in linear time.
_L = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"  # of digits: zeros, then at most 255
#: High-recall generators: written-out addresses, and any grouped or long number, of any length. They overlap the base spans.
#: Loops are possessive: linear, and no deep recursion in long runs. A number ends where no letter, digit, @ or _ follows.
_DOT = r"(?:\.|\x20\.\x20|\x20?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\])\x20?)"
GENERATORS = {
    "mail_like": rf"(?<![{_L}])[{_L}]++\x20?(?:@|\((?:at|AT)\)|\[(?:at|AT)\])\x20?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]{{2,}}+)++",
    "number_like": r"(?<![A-Za-z0-9.@_-])[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9]){5,}+(?![A-Za-z0-9@_])",
}
#: A text without this has no match of the pattern, so the pattern is not tried.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+", "mail_like": "", "number_like": ""}
_REACH = 24
#: Words that announce personal data in English, German, French and Spanish.
WORDS = r"(?i)(?:phone|tel|call|fax|mobil|cell|mail|contact|kontakt|card|karte|carte|tarjeta|visa|account|konto|compte|cuenta|iban|ssn|passport|ausweis|address|adresse|host|server|login|user)"
#: Labelled examples (before, span, after, label) of formats that a corpus may not hold.
SEEDS = (
    ("call me on ", "(555) 123-4567", " after six", 1), ("phone: ", "555-123-4567", "\n", 1), ("tel ", "030 1234 5678", ", ", 1), ("mobile ", "+44 20 7946 0958", ".", 1),
    ("card ", "4111 1111 1111 1111", " exp", 1), ("Karte ", "5500-0000-0000-0004", " ", 1), ("ssn ", "123-45-6789", " ", 1), ("passport no ", "123456789", ",", 1),
    ("mail ", "jane.doe (at) example (dot) org", " ", 1), ("contact ", "bob [at] mail [dot] example [dot] com", ".", 1), ("login ", "ann@example.com", " ", 1), ("write to ", "x.y@example.co.uk", "", 1),
    ("account ", "12-3456-7890-12", " ", 1), ("fax ", "(030) 123 45 67", ";", 1), ("konto ", "1234 5678 9012", " ", 1), ("call ", "+1 (212) 555-0100", " ", 1),
    ("on ", "2024-01-15", " we", 0), ("at ", "12:30:45", " the", 0), ("dated ", "15/01/2024", ".", 0), ("in ", "1999 2000 2001", " and", 0), ("about ", "1000000", " people", 0),
    ("version ", "1.2.3.4.5.6", " of", 0), ("pages ", "120-135 140", " in", 0), ("total of ", "12345678", " units", 0), ("isbn ", "978-3-16-148410-0", " ", 0), ("ratio ", "16:9 4:3 3:2", " ", 0),
    ("sum ", "1 2 3 4 5 6 7 8", " is", 0), ("id ", "20240115123045", "\n", 0), ("from ", "1914-1918", " the", 0), ("in ", "01/02 03/04", " of", 0), ("scored ", "21-19 21-17", " to", 0), ("lat ", "52.520008", " lon", 0),
)
FEATURES = (
    "digits", "groups", "longest", "plus", "paren", "at", "dots", "dashes", "slashes", "spaces", "word", "left",
    "right", "year",
)


_BLOCK = 256


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step gives for each item, as array<kind>, with a state handed from item to item: step(state, item) -> (state, value).

    Values are gathered in blocks, so a list of n costs n * _BLOCK rather than n * n.
    """
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    start = F.struct(state.alias("state"), none.alias("now"), nothing.alias("done"))

    def add(acc: Column, x: Column) -> Column:
        new, value = step(acc["state"], x)
        room = F.size(acc["now"]) < _BLOCK
        return F.struct(
            new.alias("state"), F.array_append(F.when(room, acc["now"]).otherwise(none), value).alias("now"),
            F.when(room, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"),
        )

    return F.aggregate(items, start, add, lambda acc: F.flatten(F.array_append(acc["done"], acc["now"])))


def spans(text: Column, pattern: str, kind: str, needs: str = "") -> Column:
    """array<struct<start,end,text,before,after>> of the leftmost matches, in code points, with _REACH characters before
    and one after. All of it comes from the pieces between the matches, so no match looks for its place in the text."""
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
    )
    row = "struct<start:int,end:int,text:string,before:string,after:string>"
    none = F.array().cast(f"array<{row}>")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    last = lambda x: F.substring(x, -_REACH, _REACH)

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        s = state["at"] + F.length(x["gap"])
        hit = F.coalesce(x["hit"], F.lit(""))
        before = last(F.concat(state["tail"], last(x["gap"])))
        new = F.struct(
            (s + F.length(hit)).alias("at"), last(F.concat(state["tail"], last(x["gap"]), last(hit))).alias("tail"),
        )
        value = F.struct(
            s.alias("start"), (s + F.length(hit)).alias("end"), x["hit"].alias("text"), before.alias("before"),
            x["after"].alias("after"),
        )
        return new, value

    def found(p: Column) -> Column:
        after = lambda i: F.substring(F.concat_ws("", F.get(p, i + 1)["gap"], F.get(p, i + 1)["hit"]), 1, 1)
        own = F.transform(
            p, lambda x, i: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), after(i).alias("after")),
        )
        return F.filter(scan(own, start, step, row), lambda x: x["text"].isNotNull())

    has = F.contains(text, F.lit(needs)) if needs else F.lit(True)
    if kind in ("card", "number_like"):
        has = F.regexp_like(text, F.lit(r"[0-9][\x20().:/-]{0,2}[0-9]"))
    if kind == "mail_like":
        has = F.regexp_like(text, F.lit(r"@|[(\[](?:at|AT)[)\]]"))
    return F.when(has, F.get(F.transform(F.array(pieces), found), F.lit(0))).otherwise(none)


def valid(kind: str, t: Column) -> Column:
    """The base check of one match."""
    digits = F.regexp_replace(t, "[^0-9]", "")
    if kind == "ip":
        return F.regexp_like(t, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start,kind_no,end>> of all valid base matches by start, then kind."""
    def of(i: int, k: str) -> Column:
        ok = F.filter(spans(text, BASE[k], k, _NEEDS[k]), lambda x: valid(k, x["text"]))
        return F.transform(
            ok, lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind_no"), x["end"].alias("end")),
        )

    per = [of(i, k) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*per))


def features(before: Column, span: Column, after: Column) -> dict[str, Column]:
    """Small integers of a span's format and context; the base checks (Luhn, octets) are not among them."""
    n = lambda cls: F.length(F.regexp_replace(span, f"[^{cls}]", ""))
    side = lambda c: F.when(F.length(c) == 0, 0).when(F.regexp_like(c, F.lit(r"^\s$")), 1).when(F.regexp_like(c, F.lit(r"^[A-Za-z0-9]$")), 3).otherwise(2)
    digits = n("0-9")
    return {
        "digits": F.least(digits, F.lit(20)),
        "groups": F.least(F.size(F.regexp_extract_all(span, F.lit("[0-9]+"), F.lit(0))), F.lit(9)),
        "longest": F.least(
            F.coalesce(F.array_max(F.transform(F.split(span, "[^0-9]+"), F.length)), F.lit(0)), F.lit(20),
        ),
        "plus": F.startswith(span, F.lit("+")).cast("int"),
        "paren": F.contains(span, F.lit("(")).cast("int"),
        "at": F.regexp_like(span, F.lit(r"@|[(\[](?:at|AT)[)\]]")).cast("int"),
        "dots": F.least(n("."), F.lit(5)),
        "dashes": F.least(n("-"), F.lit(5)),
        "slashes": F.least(n("/:"), F.lit(5)),
        "spaces": F.least(n("\\x20"), F.lit(8)),
        "word": F.regexp_like(before, F.lit(WORDS)).cast("int"),
        "left": side(F.right(before, F.lit(1))),
        "right": side(F.left(after, F.lit(1))),
        "year": F.regexp_like(span, F.lit(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")).cast("int"),
    }


def reaches(base: Column) -> Column:
    """array<struct<start,end>> of base, sorted by start: for each span the furthest end of it and those before it."""
    row = "struct<start:int,end:int>"
    return scan(
        base, F.lit(0), lambda far,
        x: (F.greatest(far, x["end"]), F.struct(x["start"].alias("start"), F.greatest(far, x["end"]).alias("end"))), row,
    )


def touched(x: Column, reach: Column) -> Column:
    """Whether a base span overlaps x: of those that start before its end, found by bisection, one ends after its start."""
    n = F.size(reach)
    halves = F.filter(F.array(*[F.lit(1 << k) for k in reversed(range(24))]), lambda p: p <= n)
    before = F.aggregate(
        halves, F.lit(0), lambda k,
        p: F.when((k + p <= n) & (F.get(reach, k + p - 1)["start"] < x["end"]), k + p).otherwise(k),
    )
    return F.coalesce(F.get(reach, before - 1)["end"] > x["start"], F.lit(False))


def candidates(text: Column, base: Column) -> Column:
    """array<struct<start,end,known,features...>>: the generators' spans; known if a base span touches it."""

    def one(x: Column, reach: Column) -> Column:
        known = touched(x, reach)
        more = [c.cast("int").alias(f) for f, c in features(x["before"], x["text"], x["after"]).items()]
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), known.alias("known"), *more)

    def of(reach: Column) -> Column:
        return F.flatten(F.array(*[F.transform(spans(text, p, k, _NEEDS[k]), lambda x: one(x, reach)) for k, p in GENERATORS.items()]))

    return F.get(F.transform(F.array(reaches(base)), of), F.lit(0))


class Boosted:
    """Gradient-boosted regression trees on logistic loss over weighted rows of small integers, and their expression."""

    def __init__(self, rounds: int = 24, depth: int = 2, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.ridge, self.trees, self.bias = rounds, depth, rate, ridge, [], 0.0

    def _tree(self, rows, depth: int):
        """rows: (features, gradient, curvature). Newton leaves; splits by gain over every observed cut."""
        g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
        leaf = self.rate * g / (h + self.ridge)
        if not depth or len(rows) < 2:
            return leaf
        at: list[dict[int, list[float]]] = [{} for _ in FEATURES]
        for x, a, b in rows:
            for f, sums in enumerate(at):
                s = sums.setdefault(x[f], [0.0, 0.0])
                s[0] += a
                s[1] += b
        found = self._split(at, g, h)
        if found is None:
            return leaf
        f, cut = found[:2]
        return (
            f, cut, self._tree([r for r in rows if r[0][f] <= cut], depth - 1),
            self._tree([r for r in rows if r[0][f] > cut], depth - 1),
        )

    def _split(self, at: list[dict[int, list[float]]], g: float, h: float) -> tuple[int, int, float, float] | None:
        """(feature, cut, gradient and curvature up to the cut) of the best cut, from the sums of each feature's values."""
        best, whole = (1e-6, None), g * g / (h + self.ridge)
        for f, sums in enumerate(at):
            gl = hl = 0.0
            for cut in sorted(sums)[:-1]:
                gl += sums[cut][0]
                hl += sums[cut][1]
                gain = gl * gl / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - whole
                if gain > best[0] + 1e-12:
                    best = (gain, (f, cut, gl, hl))
        return best[1]

    def fit_table(self, counts: DataFrame) -> Boosted:
        """fit for a table of any size: FEATURES, and a and b, the weights of label 1 and 0 in tenths, as whole numbers.

        A tree's level is one aggregate of gradients by node, feature and value; its number of rows is the features'
        values. Sums are decimal, so they don't depend on the order of the rows.
        """
        pos, neg = (int(x or 0) / 10 for x in counts.agg(F.sum("a"), F.sum("b")).first())
        self.bias, self.trees = math.log((pos + 0.5) / (neg + 0.5)), []
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("v")) for i, c in enumerate(FEATURES)]))
        for _ in range(self.rounds):
            d = counts.withColumn("p", 1 / (1 + F.exp(-self.column(F.col))))
            g, h = (F.col("a") * (1 - F.col("p")) - F.col("b") * F.col("p")) / 10, (F.col("a") + F.col("b")) * F.col("p") * (1 - F.col("p")) / 10
            d = d.select(*FEATURES, *[x.cast("decimal(28,10)").alias(n) for n, x in (("g", g), ("h", h))])
            splits: dict[int, tuple] = {}  # by node: the root is 1, below n are 2 n and 2 n + 1
            leaves: dict[int, float] = {}
            node = F.lit(1)
            for level in range(self.depth):
                sums: dict[int, list[dict]] = {}
                for r in d.select(node.alias("n"), "g", "h", cells.alias("x")).groupBy("n", "x.f", "x.v").agg(F.sum("g"), F.sum("h")).collect():
                    sums.setdefault(r[0], [{} for _ in FEATURES])[r[1]][r[2]] = [float(r[3]), float(r[4])]
                for n in range(1 << level, 2 << level):
                    if n not in sums:
                        continue
                    g_all, h_all = (sum(x[i] for x in sums[n][0].values()) for i in (0, 1))
                    leaves[n] = self.rate * g_all / (h_all + self.ridge)
                    if (found := self._split(sums[n], g_all, h_all)) is None:
                        continue
                    f, cut, gl, hl = found
                    splits[n] = (f, cut)
                    leaves[2 * n], leaves[2 * n + 1] = self.rate * gl / (hl + self.ridge), self.rate * (g_all - gl) / (h_all - hl + self.ridge)
                deeper = F.lit(0)  # rows of a node that isn't split are settled
                for n, (f, cut) in splits.items():
                    if n >> level == 1:
                        deeper = F.when(node == n, F.when(F.col(FEATURES[f]) <= cut, 2 * n).otherwise(2 * n + 1)).otherwise(deeper)
                node = deeper

            def tree(n: int):
                return (*splits[n], tree(2 * n), tree(2 * n + 1)) if n in splits else leaves.get(n, 0.0)  # noqa: B023

            self.trees.append(tree(1))
        return self

    def fit(self, rows: list[tuple[tuple[int, ...], float, float]]) -> Boosted:
        """rows: (features, weight of label 1, weight of label 0)."""
        pos, neg = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.bias, self.trees = math.log((pos + 0.5) / (neg + 0.5)), []
        score = [self.bias] * len(rows)
        for _ in range(self.rounds):
            p = [1 / (1 + math.exp(-s)) for s in score]
            tree = self._tree(
                [(x, a * (1 - q) - b * q, (a + b) * q * (1 - q)) for (x, a, b), q in zip(rows, p, strict=True)],
                self.depth,
            )
            self.trees.append(tree)
            score = [s + self._leaf(tree, x) for s, (x, _, _) in zip(score, rows, strict=True)]
        return self

    @staticmethod
    def _leaf(tree, x) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x) -> float:
        return self.bias + sum(self._leaf(t, x) for t in self.trees)

    def column(self, of: Callable[[str], Column]) -> Column:
        def expr(t) -> Column:
            return F.when(of(FEATURES[t[0]]) <= t[1], expr(t[2])).otherwise(expr(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        out = F.lit(float(self.bias))
        for t in self.trees:
            out = out + expr(t)
        return out


def calibrated_threshold(scored: list[tuple[float, float, float]], precision: float) -> float:
    """The lowest score above which held-out rows (score, positives, negatives) keep the asked precision (with one
    pseudo-negative, so that few rows can't promise much); infinite if none do."""
    best, pos, neg = math.inf, 0.0, 1.0
    for s in sorted({r[0] for r in scored}, reverse=True):
        pos += sum(r[1] for r in scored if r[0] == s)
        neg += sum(r[2] for r in scored if r[0] == s)
        if pos / (pos + neg) >= precision:
            best = s
    return best


def _ends(tree) -> tuple[float, float]:
    """The least and the largest leaf."""
    if not isinstance(tree, tuple):
        return tree, tree
    (a, b), (c, d) = _ends(tree[2]), _ends(tree[3])
    return min(a, c), max(b, d)


def table_threshold(held: DataFrame, model: Boosted, precision: float, ranges: int = 1024) -> float:
    """calibrated_threshold for a table of any size, of fit_table's columns: the driver sees the sums of so many ranges of
    scores; within each, scores are ordered where they are."""
    low, high = (model.bias + sum(_ends(t)[i] for t in model.trees) for i in (0, 1))
    d = held.select("a", "b", model.column(F.col).alias("s"))
    place = F.floor((F.col("s") - low) / (high - low) * ranges) if high > low else F.lit(0)
    d = d.groupBy("s").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("r", place.cast("int"))
    pos, neg, above = 0, 10, []
    for r in sorted(d.groupBy("r").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect(), key=lambda x: -x["r"]):
        above.append(f"({r['r']}, {pos}L, {neg}L)")
        pos, neg = pos + r["a"], neg + r["b"]
    if not above:
        return math.inf
    over = F.broadcast(held.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(above)} AS x(r, pos, neg)"))
    down = W.partitionBy("r").orderBy(F.desc("s"))
    d = d.select("s", "r", F.sum("a").over(down).alias("a"), F.sum("b").over(down).alias("b")).join(over, "r")
    pos, neg = F.col("pos") + F.col("a"), F.col("neg") + F.col("b")
    best = d.where(pos / (pos + neg) >= precision).agg(F.min("s")).first()[0]
    return math.inf if best is None else best


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def training_counts(found: DataFrame) -> DataFrame:
    """(FEATURES, held, a, b): all spans of the generators and the seed examples, counted by features; a and b are the
    weights of label 1 and 0 in tenths."""
    x = found.select("id", F.explode("cand").alias("x")).select("id", "x.*")
    x = x.select(*FEATURES, (F.abs(F.xxhash64("id", "start")) % 2).cast("int").alias("held"), F.col("known").cast("int").alias("y"))
    # the same spans once more without what only the base pattern asks for, so that the trees look past it
    x = x.unionByName(x.where("y = 1 and plus = 1").withColumn("plus", F.lit(0)))
    weight = lambda y, yes, no: [(F.lit(yes) * y).cast("long").alias("a"), (F.lit(no) * (1 - y)).cast("long").alias("b")]
    values = ", ".join(f"({_sql(a)}, {_sql(b)}, {_sql(c)}, {y}, {i % 2})" for i, (a, b, c, y) in enumerate(SEEDS))
    seeds = found.sparkSession.sql(f"SELECT * FROM VALUES {values} AS s(before, span, after, y, held)")
    named = [c.cast("int").alias(f) for f, c in features(F.col("before"), F.col("span"), F.col("after")).items()]
    both = x.select(*FEATURES, "held", *weight(F.col("y"), 10, 1)).unionByName(
        seeds.select(*named, "held", *weight(F.col("y"), 50, 50)),
    )
    return both.groupBy(*FEATURES, "held").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def fit(found: DataFrame, precision: float = 0.9) -> tuple[Boosted, float]:
    """Train on all of the generators' spans of the corpus (label: a base span touches it) and the seed examples.

    Half of the spans, by hash, and every second seed example set the threshold; the trees see only the others. Spans
    that no base span touches are unlabelled rather than clean: they count a tenth each as negatives. Spans of equal
    features are counted first; trees and threshold come from aggregates over those counts.
    """
    counts = written(training_counts(found), "pii-counts")
    model = Boosted().fit_table(counts.where("held = 0"))
    return model, table_threshold(counts.where("held = 1"), model, precision)


def pii_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9,
) -> DataFrame:
    """(id, base, novel): for every row the base spans and the spans that the trees add, as struct<start,kind_no,end>.

    Offsets are code points, end exclusive. kind_no counts KINDS; 4 is a span added by the method, which never
    touches a base span. Null texts are empty; texts without personal data get empty arrays; repeated rows repeat.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).select("id", text.alias("t"))
    # texts stay behind: what is written holds spans and features alone
    found = written(
        d.select("id", "t", base_spans(F.col("t")).alias("base")).select(
            "id", "base", candidates(F.col("t"), F.col("base")).alias("cand"),
        ),
        "pii",
    )
    model, threshold = fit(found, precision)
    return found.select("id", "base", _added(F.col("cand"), model, threshold).alias("novel"))


def _added(cand: Column, model: Boosted, threshold: float) -> Column:
    """The candidates that the trees select, as struct<start,kind_no,end>, by start."""
    if math.isinf(threshold):
        return F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    keep = F.filter(cand, lambda x: ~x["known"] & (model.column(lambda f: x[f]) >= threshold))
    return F.array_sort(F.transform(
        keep, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind_no"), x["end"].alias("end")),
    ))


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
    precision: float = 0.9,
) -> DataFrame:
    """The rows of docs with every personal span of the text replaced by its kind in brackets.

    length_col, if given, is set to the new length in code points. Null texts stay null. The first pass trains (see
    fit); the second finds the spans of each row again in place, so no text is shuffled.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t"))
    found = written(
        d.select("id", "t", base_spans(F.col("t")).alias("base")).select("id", candidates(F.col("t"), F.col("base")).alias("cand")).where(F.size("cand") > 0),
        "pii",
    )
    model, threshold = fit(found, precision)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), t.alias("t"))
    row = row.select("row", "t", base_spans(F.col("t")).alias("base")).select(
        "row", "t", "base", candidates(F.col("t"), F.col("base")).alias("cand"),
    )
    row = row.select(
        "row",
        redacted(F.col("t"), F.array_sort(F.concat("base", _added(F.col("cand"), model, threshold)))).alias("new"),
    )
    value = {text_col: F.when(F.col("row")[text_col].isNotNull(), F.col("new"))}
    if length_col and length_col in docs.columns:
        value[length_col] = F.when(F.col("row")[text_col].isNotNull(), F.length("new")).otherwise(F.col("row")[length_col]).cast(docs.schema[length_col].dataType)
    return row.select(*[value.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def joined(spans_col: Column) -> Column:
    name = F.array(*[F.lit(k) for k in (*KINDS, "novel")])
    return F.array_join(
        F.transform(spans_col, lambda x: F.concat_ws(":", F.get(name, x["kind_no"]), x["start"], x["end"])), ",",
    )


def redacted(text: Column, spans_col: Column) -> Column:
    """The text with each maximal run of overlapping spans replaced by the first span's kind in brackets.

    Four bytes a character make places in the text direct, so long texts with many spans take linear time.
    """
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "novel")])

    def part(wide: Column, a: Column, b: Column) -> Column:
        return F.decode(F.substring(wide, 4 * a + 1, 4 * (b - a)), "UTF-32")

    def done(wide: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            value = F.when(x["start"] >= at, F.concat(part(wide, at, x["start"]), F.get(name, x["kind_no"]))).otherwise(F.lit(""))
            return F.greatest(at, x["end"]), value

        last = F.aggregate(spans_col, F.lit(0), lambda at, x: F.greatest(at, x["end"]))
        return F.concat(F.array_join(scan(spans_col, F.lit(0), step, "string"), ""), part(wide, last, F.length(text)))

    return F.when(F.size(spans_col) == 0, text).otherwise(F.get(
        F.transform(F.array(F.encode(text, "UTF-32")), done), F.lit(0),
    ))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pii_spans(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind_no"] == i)).cast("long")
    return s.select(
        F.col("id").alias("doc_id"),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "novel"))).alias("spans"),
        F.size("novel").cast("long").alias("n_novel"),
    )
