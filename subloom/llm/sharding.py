"""Sharding by balanced label propagation: linked documents move to their neighbours' shards under exact quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from subloom.llm.common import partitions, remove, small, table, written


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with rank (long, from 0 without gaps) within group, by order; no group is sorted in one task.

    Rows are range-partitioned by (group, order) and written; their places within a partition are then fixed, and
    the partitions' counts (one row a partition and group) give the offsets. order must tell all rows apart.
    """
    s = df.repartitionByRange(partitions(df.sparkSession), group, *order).sortWithinPartitions(group, *order).withColumn("_m", F.monotonically_increasing_id())
    s = written(s, name).withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.expr("_m & 8589934591"))
    part = s.groupBy(group, "_p").agg(F.min("_i").alias("_f"), F.count("*").alias("_c"))
    off = part.select(
        group, "_p", "_f",
        F.coalesce(F.sum("_c").over(W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
    )
    off = written(off, f"{name}-offsets")
    return s.join(small(off), [group, "_p"]).withColumn("rank", F.col("_o") + F.col("_i") - F.col("_f")).drop("_m", "_p", "_i", "_f", "_o")


def circulation(want: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Of want {(from, to): rows}, how many may go at once so that every node gives as many as it gets.

    Cycles with a request in them are taken off, opposite requests first, then longer ones, until none is left.
    Nodes below 0 make no requests; they only hand on.
    """
    left = {k: n for k, n in want.items() if n > 0 and k[0] != k[1]}
    out: dict[tuple[int, int], int] = {}

    def take(cycle: list[tuple[int, int]]) -> None:
        n = min(left[e] for e in cycle)
        for e in cycle:
            out[e] = out.get(e, 0) + n
            left[e] -= n
            if not left[e]:
                del left[e]

    asked = sorted(e for e in left if e[0] >= 0 and e[1] >= 0)
    for a, b in asked:
        if (a, b) in left and (b, a) in left:
            take([(a, b), (b, a)])
    for a, b in asked:
        while (a, b) in left:  # breadth first: the shortest way from b back to a
            came, queue = {b: b}, [b]
            for x in queue:
                for y in [y for z, y in sorted(left) if z == x and y not in came]:
                    came[y] = x
                    queue.append(y)
            if a not in came:
                break
            cycle, x = [(a, b)], a
            while x != b:
                cycle.append((came[x], x))
                x = came[x]
            take(cycle)
    return out


def propagate(
    linked: DataFrame, singles: int | list[int], shards: int, rounds: int | None = None, salt: int = 0,
) -> tuple[DataFrame, list[int]]:
    """(linked(u, gid, shard), free) after balanced label propagation; free[b] is how many unlinked rows shard b holds.

    Each round, every group looks for the shard that holds most of its members (ties by a hash of the group and the
    round) among those that hold other rows too; members elsewhere, where fewer are, ask to move there. Rows that go
    round in a circle change no shard's count, so the largest circulation found in the requests moves; unlinked rows,
    which are all alike, go wherever they are needed. Every move joins a member to more of its group, so rounds end
    by themselves; a shard that could take nobody is left out of the next round's choice, so a group that is larger than
    a shard fills another. Without rounds they go on until nothing moves four times in a row, each with other ties.
    """
    spark = linked.sparkSession
    have = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # at most a row a shard
    free = [(singles - b + shards - 1) // shards for b in range(shards)] if not isinstance(singles, list) else list(singles)
    rows = F.create_map(*[F.lit(x) for b in range(shards) for x in (b, free[b] + have.get(b, 0))])
    still, turn, closed = 0, 0, set()
    while still < 4 and turn != rounds:
        turn += 1
        cnt = linked.groupBy("gid", "shard").agg(F.count("*").alias("n"))
        tie = F.xxhash64("gid", "shard", F.lit(salt + turn))
        best = cnt.groupBy("gid").agg(
            F.max(F.when((F.col("n") < rows[F.col("shard")]) & ~F.col("shard").isin(*closed), F.struct("n", tie.alias("h"), "shard"))).alias("b"),
            F.count("*").alias("k"),
        )
        best = best.where("k > 1 and b is not null").select(
            "gid", F.col("b.shard").alias("to"), F.col("b.n").alias("n_to"),
        )
        ask = cnt.join(best, "gid").where("shard <> to and n <= n_to").select("gid", "shard", "to", "n")
        ask = written(ask, "shard-asks")
        want = {(r["shard"], r["to"]): r["n"] for r in ask.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}  # at most a row a pair of shards
        if not want:
            remove(ask)
            if not closed:
                break
            still, closed = still + 1, set()
            continue
        # node -1 stands for the unlinked rows' way from any shard to any other
        flow = circulation(want | {(b, -1): free[b] for b in range(shards)} | {(-1, b): sum(free) for b in range(shards)})
        for (a, b), n in flow.items():
            if b == -1:
                free[a] -= n
            elif a == -1:
                free[b] += n
        blocked = {b for _, b in want} - {b for _, b in flow}
        go = {a * shards + b: n for (a, b), n in flow.items() if a >= 0 and b >= 0}
        if not go:
            still, closed = still + 1, closed | blocked
            remove(ask)
            continue
        still, closed = 0, blocked
        quota = F.create_map(*[F.lit(x) for k, n in go.items() for x in (k, n)])
        movers = linked.join(ask.select("gid", "shard", "to"), ["gid", "shard"]).select(
            "u", "gid", "to", (F.col("shard") * shards + F.col("to")).alias("way"),
        )
        moves = written(
            ranked(movers, "way", ["gid", "u"], "shard-movers").where(F.col("rank") < quota[F.col("way")]).select("u", "to"),
            "shard-moves",
        )
        new = written(
            linked.join(moves, "u", "left").select("u", "gid", F.coalesce("to", "shard").alias("shard")), "shard-rows",
        )
        for x in (linked, ask, moves):
            remove(x)
        linked = new
    return linked, free


def settle(linked: DataFrame, shards: int) -> DataFrame:
    """linked(u, gid, shard) with the rows of split groups dealt anew over the places they hold, group after group.

    If fewer groups than shards are split, nothing changes. Else at most one group is split at each border of two shards.
    """
    split = linked.groupBy("gid").agg(F.count_distinct("shard").alias("k")).where("k > 1").select("gid")
    split = written(split, "shard-split")
    if split.count() < shards:
        return linked
    rows = written(linked.join(split, "gid").select("u", "gid", "shard", F.lit(0).alias("one")), "shard-unsettled")
    held = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # at most a row a shard
    to, end = F.lit(None).cast("int"), sum(held.values())
    for b in sorted(held, reverse=True):
        to = F.when(F.col("rank") < end, F.lit(b)).otherwise(to)
        end -= held[b]
    # later whens are outermost: the lowest shard whose end lies beyond the rank wins
    dealt = ranked(rows, "one", ["gid", "u"], "shard-settled").select("u", to.alias("to"))
    return written(
        linked.join(dealt, "u", "left").select("u", "gid", F.coalesce("to", "shard").alias("shard")), "shard-rows",
    )


def gather(linked: DataFrame, singles: int, shards: int, max_rounds: int) -> tuple[DataFrame, list[int]]:
    """Propagation for max_rounds rounds, then the groups still split are settled, then propagation to its end."""
    linked, free = propagate(linked, singles, shards, max_rounds)
    return propagate(settle(linked, shards), free, shards, salt=max_rounds)


def seat(u: F.Column, singles: int, shards: int, free: list[int]) -> F.Column:
    """The shard of unlinked row u when shard b holds free[b] of them: rows stay where they began, what is too many fills what is too few."""
    start = [(singles - b + shards - 1) // shards for b in range(shards)]
    b, j = (u % shards).cast("int"), F.floor(u / shards).cast("long")
    first, over = {}, 0
    for x in range(shards):
        first[x] = over
        over += max(0, start[x] - free[x])
    index = F.create_map(*[F.lit(v) for x in range(shards) for v in (x, first[x])])[b] + j - F.create_map(*[F.lit(v) for x in range(shards) for v in (x, free[x])])[b]
    to, end = b, over
    for x in reversed(range(shards)):
        if free[x] > start[x]:
            to = F.when(index < end, F.lit(x)).otherwise(to)
            end -= free[x] - start[x]
    return F.when(j < F.create_map(*[F.lit(v) for x in range(shards) for v in (x, free[x])])[b], b).otherwise(to)


def balanced_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", max_rounds: int = 16,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot, linked): shards whose row counts differ by one at most, and gapless slots.

    Documents are linked when their texts are equal (null counts as empty): XXH64, CRC-32 and length agree. They
    start dealt out evenly in the order of a hash of the id, those without links first; label propagation then gathers
    the groups. Repeated rows are rows of their own. No documents give no rows. Only the two columns named are read.
    """
    t = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    d = docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t")).select(
        "id", (F.octet_length("t") + 8).cast("long").alias("size"), F.crc32("t").alias("text_crc32"),
        F.xxhash64("t").alias("x"),
    )
    d = written(d, "shard-docs")
    key = ["x", "text_crc32", "size"]
    group = d.groupBy(*key).agg(F.min("id").alias("gid"), F.count("*").alias("n")).where("n > 1").select(*key, "gid")
    d = d.join(group, key, "left").withColumn("one", F.lit(0)).withColumn("linked", F.col("gid").isNotNull()).withColumn("r", F.xxhash64("id", F.lit(11)))
    d = written(
        ranked(d, "one", ["linked", "r", "id", "x"], "shard-start").select(
            F.col("rank").alias("u"), "id", "size", "text_crc32", "gid",
        ),
        "shard-dealt",
    )
    begin = (F.col("u") % shards).cast("int").alias("shard")
    singles = d.where("gid is null").count()
    linked, free = gather(
        written(d.where("gid is not null").select("u", "gid", begin), "shard-rows"), singles, shards, max_rounds,
    )
    moved = linked.select("u", F.col("shard").alias("new"))
    placed = d.join(moved, "u", "left").select(
        "u", "id", "size", "text_crc32", F.col("gid").isNotNull().alias("linked"),
        F.coalesce("new", seat(F.col("u"), singles, shards, free)).alias("shard"),
    )
    return ranked(placed, "shard", ["u"], "shard-slots").select(
        "id", "size", "text_crc32", "shard", F.col("rank").alias("slot"), "linked",
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = balanced_shards(table(spark, sf_dir, "documents"))
    return s.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
