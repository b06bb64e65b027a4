"""Sharding by minimum-cost-flow: from old shards to new capacities, moving the fewest bytes.

Old shards supply their bytes, new shards take theirs, and a byte costs 1 where its shard
changes and 0 where it stays. The flow problem is as large as the number of shards, not as the
data, and is solved on the driver. Its answer is a list of byte ranges per old shard: the first
part stays, the next go to other shards. Documents find their range by a running sum in two
levels (blocks of a shard, documents of a block), so no task holds a shard. Only documents in
ranges that leave move, and only files of shards that lose or gain are written again.

Documents above a 64th of a shard, of which there are at most 64 for each shard, are placed
first, one by one; ranges then end among small documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged, unused

OLD_SHARDS, SHARDS = 16, 24
BLOCK_DOCS = 20_000
LARGE_PART = 64


def min_cost_flow(supply: list[int], capacity: list[int], stay: list[int | None]) -> dict[tuple[int, int], int]:
    """Flows ``(old, new) -> bytes`` that ship all supplies at the least bytes moved.

    Successive shortest augmenting paths; ``stay[i]`` is the new shard where old shard i's bytes
    cost nothing (None: nowhere). Capacities must suffice.
    """
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    cost = lambda i, j: 0 if stay[i] == j else 1
    while any(left):
        # distances over old shards 0..n-1 and new shards n..n+m-1, from those with bytes left
        dist = [0 if x else 1 << 60 for x in left] + [1 << 60] * m
        back: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if dist[i] < 1 << 60:
                    for j in range(m):
                        if dist[i] + cost(i, j) < dist[n + j]:
                            dist[n + j], back[n + j], changed = dist[i] + cost(i, j), i, True
            for (i, j), f in flow.items():
                if f and dist[n + j] - cost(i, j) < dist[i]:
                    dist[i], back[i], changed = dist[n + j] - cost(i, j), n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (dist[n + j], stay.count(j) == 0, j), default=None)
        if end is None or dist[n + end] >= 1 << 60:
            raise ValueError("the capacities do not hold the supplies")
        path = [n + end]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        push = min([left[path[0]], room[end], *(flow[(b, a - n)] for a, b in zip(path, path[1:]) if a >= n)])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[(a, b - n)] = flow.get((a, b - n), 0) + push
            else:
                flow[(b, a - n)] -= push
        left[path[0]] -= push
        room[end] -= push
    return {k: f for k, f in flow.items() if f}


def level(loads: list[int], total: int) -> list[int]:
    """Room on top of ``loads`` that makes the fullest of them as low as ``total`` more allows."""
    order = sorted(range(len(loads)), key=lambda j: loads[j])
    used, out = 0, [0] * len(loads)
    for k, j in enumerate(order):
        top = loads[order[k + 1]] if k + 1 < len(order) else None
        used += loads[j]
        if top is None or top * (k + 1) - used >= total:
            each, extra = divmod(total + used, k + 1)
            for r, x in enumerate(order[:k + 1]):
                out[x] = each + (r < extra) - loads[x]
            break
    return out


@dataclass(frozen=True)
class Plan:
    """Where bytes go: ranges (old, from, to, new) of small documents, large ones by key."""

    ranges: list[tuple[int, int, int, int]]
    large: list[tuple[int, int, int]]


def plan(loads: dict[int, int], large: list, shards: int) -> Plan:
    """``loads``: bytes of small documents per old shard; ``large``: (key, old, size) rows."""
    total = sum(loads.values()) + sum(x[2] for x in large)
    own = [0] * shards
    placed = []
    for key, old, size in sorted(large, key=lambda x: (-x[2], x[0])):
        at = old if old < shards and (own[old] + size) * shards <= total else min(range(shards), key=lambda j: (own[j], j))
        own[at] += size
        placed.append((key, old, at))
    olds = sorted(loads)
    room = level(own, sum(loads.values()))
    flow = min_cost_flow([loads[o] for o in olds], room, [o if o < shards else None for o in olds])
    ranges = []
    for k, o in enumerate(olds):
        at = 0
        for j in sorted((j for i, j in flow if i == k), key=lambda j: (j != o, j)):
            ranges.append((o, at, at + flow[(k, j)], j))
            at += flow[(k, j)]
    return Plan(ranges, placed)


def sized(docs: DataFrame, old_shards: int = OLD_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, key and old shard (by hash of doc_id) of every row; staged."""
    text = F.coalesce("text", F.lit(""))
    return staged(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
                              F.xxhash64("doc_id", "text").alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(old_shards)).cast("int").alias("old")), "sized")


def assign(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (doc_id, size, key, old and more) with shard and slot.

    Shards differ in bytes by about the largest small document (a 64th of a shard), if no single
    document is larger than a shard. Slots number a shard's rows from 0 without gaps. Equal rows
    stand next to each other. An empty table gives no rows.
    """
    spark = rows.sparkSession
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    big = F.col("size") * (shards * LARGE_PART) > total
    large = [tuple(r) for r in rows.where(big).select("key", "old", "size").collect()] if total else []
    blocks = n // (BLOCK_DOCS * max(1, shards)) + 16
    rows = rows.withColumn("large", big).withColumn("block", F.when(big, F.lit(-1)).otherwise(F.pmod("key", F.lit(blocks))).cast("int"))
    sums = staged(rows.groupBy("old", "block").agg(F.sum("size").alias("bytes")), "blocks")
    loads = {r.old: r.bytes for r in sums.where("block >= 0").groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}
    made = plan(loads, large, shards)

    over = Window.partitionBy("old").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.where("block >= 0").select("old", "block", F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("offset"))
    within = Window.partitionBy("old", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    small = rows.where(~big).withColumn("end", F.sum("size").over(within)).join(sums, ["old", "block"])
    small = small.withColumn("mid", F.col("end") + F.col("offset") - F.expr("size div 2")).drop("end", "offset")
    ranges = F.broadcast(spark.createDataFrame(made.ranges, "its int, lo long, hi long, shard int"))  # at most old + new shards rows
    small = small.join(ranges, (F.col("old") == F.col("its")) & (F.col("mid") >= F.col("lo")) & (F.col("mid") < F.col("hi"))).drop("its", "lo", "hi", "mid")
    first = {k: s for k, _, s in sorted(made.large, key=lambda x: (x[0], -x[2]))}  # equal large rows go to the least of their shards
    placed = F.broadcast(spark.createDataFrame(sorted(first.items()), "its long, shard int"))  # at most 64 rows a shard
    placed_rows = rows.where(big).join(placed, F.col("key") == F.col("its")).drop("its")
    out = staged(small.unionByName(placed_rows).drop("large"), "assigned")

    pieces = out.groupBy("shard", "old", "block").agg(F.count("*").alias("m"))
    before = Window.partitionBy("shard").orderBy("old", "block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = staged(pieces.select("shard", "old", "block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first")), "pieces")
    place = F.row_number().over(Window.partitionBy("shard", "old", "block").orderBy("key", "doc_id")) - 1
    return (out.withColumn("place", place).join(pieces, ["shard", "old", "block"])
            .withColumn("slot", (F.col("place") + F.col("first")).cast("long")).drop("place", "first", "block"))


def reshard(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, old.

    The law is ``bytes``: shards near equal in bytes. Size is the text's UTF-8 bytes (null: none)
    plus 8. Null doc_ids are hashed as such; repeated rows are dealt each.
    """
    return assign(sized(docs, old_shards), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old")


def moves(assigned: DataFrame) -> DataFrame:
    """Bytes and documents per (old, shard): what stays and what is transferred."""
    return assigned.groupBy("old", "shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("docs"))


def rewrite(docs: DataFrame, assigned: DataFrame, path: str) -> list[int]:
    """Write the files of the shards that lose or gain documents under ``path`` (``shard=k``
    folders); return the shards left as they are, whose old files stay valid.

    ``docs`` is the old layout with a column ``old``; ``assigned`` has key, old and shard. Rows
    are found by doc_id and text, null or not; equal rows all go to the least of their shards.
    Other columns are written as they are.
    """
    moved = [(r.old, r.shard) for r in moves(assigned).collect() if r.old != r.shard]
    touched = sorted({s for pair in moved for s in pair})
    own, its = unused(docs, "_key", "_its")
    one = assigned.groupBy(F.col("key").alias(its)).agg(F.min("shard").alias("shard"))
    keyed = docs.drop("shard").withColumn(own, F.xxhash64("doc_id", "text"))
    out = keyed.join(one, F.col(own) == F.col(its)).where(F.col("shard").isin(touched)).drop(own, its, "old")
    out.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.partitionBy("shard").parquet(path)
    stay = {r.shard for r in assigned.select("shard").distinct().collect()} - set(touched)
    return sorted(stay)
