"""Minimax contiguous partition of ordered atomic groups into shards.

The smallest capacity that lets a greedy pass fill at most n shards is found by binary search, and the shards are cut
there. The driver keeps block ends of the running total; a block is opened only if a probe falls into it, and each
opening names the least and the greatest end of every part, so that what stays hidden lies in a block 256 times narrower.

Inputs and edge cases: a null text has no bytes and goes with the empty ones; equal texts form a group and are never
parted, however many; a group larger than the mean shard sets the capacity alone; rows with the same doc_id are placed
one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.ordering import running_totals
from sluice.sources.scratch import Scratch

SHARDS = 16
#: Blocks of the first summary, and parts into which a block is opened.
BLOCKS, PARTS = 4096, 256


class Ends:
    """Ends of the groups' running total, known at block ends: (end of a block, unknown ends inside it).

    `look(spans, parts)` parts each span (a, b] into equal parts and gives, for each part that holds ends, the least of
    them, the greatest, and their number.
    """

    def __init__(self, look: Callable[[list[tuple[int, int]], int], list[tuple[int, int, int]]], total: int):
        self.look, self.total = look, total
        self.ends, self.inside = [0], [0]
        self._merge([(0, total)], BLOCKS)

    def _merge(self, spans: list[tuple[int, int]], parts: int) -> None:
        known = dict(zip(self.ends, self.inside, strict=True))
        for least, most, n in self.look(spans, parts):
            known[least] = 0  # none is hidden between a part's first end and the end before it
            if most > least:
                known[most] = n - 2
        self.ends = sorted(known)
        self.inside = [known[e] for e in self.ends]

    def open(self, starts: set[int]) -> None:
        """Parts the blocks that begin at `starts`, 32 a job; the driver gets at most 32 * PARTS rows at once."""
        before, starts = len(self.ends), sorted(starts)
        spans = [(a, self.ends[bisect_left(self.ends, a) + 1]) for a in starts]
        for at in range(0, len(spans), 32):
            self._merge(spans[at : at + 32], PARTS)
        if len(self.ends) == before:
            raise RuntimeError(f"the blocks at {starts[:3]} hide ends that opening them does not show")

    def reach(self, limit: int) -> tuple[int, int, int | None]:
        """The last end that is <= limit, as known at least and at most, and the start of the block that hides it."""
        i = bisect_left(self.ends, limit + 1) - 1
        if i + 1 == len(self.ends) or self.ends[i] == limit or not self.inside[i + 1]:
            return self.ends[i], self.ends[i], None
        return self.ends[i], min(limit, self.ends[i + 1] - 1), self.ends[i]

    def greedy(self, capacity: int, n: int, at_most: bool) -> tuple[list[int], set[int]]:
        cuts, hidden, at = [], set(), 0
        for _ in range(n):
            low, high, block = self.reach(at + capacity)
            if block is not None:
                hidden.add(block)
            at = high if at_most else low
            cuts.append(at)
        return cuts, hidden


def _look(groups: DataFrame):
    """What Ends asks for, of a table with bytes and before_bytes: one aggregation, with a row for each part."""
    end = groups.select((F.col("before_bytes") + F.col("bytes")).alias("end"))

    def look(spans: list[tuple[int, int]], parts: int) -> list[tuple[int, int, int]]:
        part = F.lit(None).cast("bigint")
        for k, (a, b) in enumerate(spans):
            step = -(-(b - a) // parts)
            part = F.when((F.col("end") > a) & (F.col("end") <= b), F.lit(k * parts) + F.floor((F.col("end") - a - 1) / F.lit(step))).otherwise(part)
        found = end.withColumn("part", part).where("part IS NOT NULL").groupBy("part").agg(F.min("end").alias("least"), F.max("end").alias("most"), F.count("*").alias("n"))
        return [(r.least, r.most, r.n) for r in found.collect()]

    return look


def minimax_cuts(ends: Ends, largest: int, n: int) -> list[int]:
    """Running totals at which the shards end, for the smallest capacity."""
    total = ends.total
    low, high = max(largest, -(-total // n)), largest + -(-total // n)
    while low < high:
        capacity = (low + high) // 2
        sure, hidden = ends.greedy(capacity, n, False)
        if sure[-1] >= total:
            high = capacity
            continue
        perhaps, more = ends.greedy(capacity, n, True)
        if perhaps[-1] < total:
            low = capacity + 1
        else:
            ends.open(hidden | more)
    while True:  # now the greedy pass itself, with every end that it stops at known
        cuts, hidden = ends.greedy(low, n, False)
        if not hidden:
            return cuts
        ends.open(hidden)


def shard_by_bytes(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless in a shard), group order: groups by their least doc_id."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.save(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("key"),
    ), "rows")
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = scratch.save(running_totals(groups, ["first", "key"], ["bytes", "n"], scratch), "groups")
    most = groups.agg(F.max(F.col("before_bytes") + F.col("bytes")).alias("total"), F.max("bytes").alias("largest")).first()
    cuts = minimax_cuts(Ends(_look(groups), most.total), most.largest, n) if most.total else []
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + (F.col("before_bytes") >= c).cast("int")
    groups = groups.withColumn("shard", shard)
    starts = groups.groupBy("shard").agg(F.min("before_n").alias("start"))  # n rows
    placed = rows.join(groups.select("key", "first", "shard"), "key").withColumn("one", F.lit(1))
    placed = running_totals(placed, ["first", "key", "doc_id"], ["one"], scratch)
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("before_one") - F.col("start")).alias("slot"))


def op7_minimax_shards(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_minimax_shards": op7_minimax_shards}
SQL: dict[str, str] = {}
