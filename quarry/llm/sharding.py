"""Sharding by a minimax contiguous partition, with DataFrame expressions only.

Equal texts share a group, so they share a shard. Groups fall into BUCKETS hash buckets, the ordered atoms; their sizes (at most
BUCKETS rows, whatever the size of the table) are summed on the JVM and read by the driver. An atom above the mean share gets a
shard of its own; over the others the smallest feasible capacity is found by binary search, each guess checked greedily with one
bisection for each shard, and the shards are cut there. The law that holds is `bytes`.

Slots are numbered in blocks of a shard, and each block begins where those before it end, so no task ever holds a whole shard.

Defined results: null counts as the empty text for grouping, has no bytes and the crc32 of nothing; repeated rows get a slot
each; a null doc_id sorts first in its block; very long texts are hashed and measured whole on the JVM, and one above a share has a shard
of its own; an empty table gives no rows; with fewer groups than shards some shards stay
empty; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

BUCKETS = 1 << 16
#: Blocks of a shard in which slots are numbered.
BLOCKS = 512
OVERHEAD = 8


def feasible(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy cuts (first atoms of the shards after the first) if `shards` shards of that capacity hold all atoms."""
    cuts, at, n = [], 0, len(ends)
    while True:
        before = ends[at - 1] if at else 0
        to = bisect_right(ends, before + capacity)
        if to >= n:
            return cuts
        if to == at or len(cuts) + 1 == shards:
            return None
        cuts.append(to)
        at = to


def minimax(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which contiguous runs of `sizes` fit in `shards` shards, and the cuts."""
    if not sizes:
        return 0, []
    ends = list(accumulate(sizes))
    lo, hi = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        if feasible(ends, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo, feasible(ends, lo, shards)


def plan(atoms: list[tuple[int, int]], shards: int) -> tuple[list[int], list[int]]:
    """atoms: (bucket, size) in order. Returns the buckets with a shard of their own, and the first buckets of later shards."""
    own: list[int] = []
    rest, total, left = sorted(atoms, key=lambda a: -a[1]), sum(s for _, s in atoms), shards
    for bucket, size in rest:
        if left <= 1 or size * left <= total:
            break
        own.append(bucket)
        total, left = total - size, left - 1
    alone = set(own)
    ordered = [a for a in atoms if a[0] not in alone]
    _, cuts = minimax([s for _, s in ordered], left)
    return own, [ordered[c][0] for c in cuts]


def shard_of(bucket: Column, own: list[int], cuts: list[int]) -> Column:
    """The shard of a bucket: atoms of their own first, then the number of cuts at or before the bucket."""
    after = F.lit(len(own)).cast("int")
    if cuts:
        after = after + F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= bucket))
    if own:
        at = F.array_position(F.array(*map(F.lit, own)), bucket).cast("int")
        return F.when(at > 0, at - 1).otherwise(after)
    return after


def assign(docs: DataFrame, shards: int = 24, buckets: int = BUCKETS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int").alias("bucket"),
    )
    rows = common.materialise(rows, "shard-rows")
    atoms = [tuple(r) for r in rows.groupBy("bucket").agg(F.sum("size").alias("size")).orderBy("bucket").collect()]
    own, cuts = plan(atoms, shards)
    placed = rows.select("*", shard_of(F.col("bucket"), own, cuts).alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int").alias("block"))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("shard").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")))
    # At most shards * blocks rows: a bound that does not grow with the table.
    out = numbered.join(F.broadcast(first), (numbered.shard == F.col("s")) & (numbered.block == F.col("b")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
