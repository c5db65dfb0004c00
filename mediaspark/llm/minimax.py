"""Sharding by a minimax contiguous partition of atomic groups.

Documents with equal texts form a group that no cut may split.  Groups stand in
the order of their smallest document id; the smallest shard capacity that lets
a greedy pass fill at most the wanted number of shards is found by binary
search, and the sequence is cut where that pass cuts.

Groups that alone exceed an even share of what is left (at most as many as
there are shards) stand first and get a shard each; the search runs over the
rest, so that one huge group doesn't let the other shards grow to its size.

The prefix sums stay distributed.  The driver sees a summary of bounded length:
the last group end in each of some thousand stretches.  A greedy pass over it
gives a capacity that is surely enough and one that is surely needed; where
they differ, only the stretches in which a cut can lie are summarised anew,
more finely, until both agree.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspark.llm.common import running, stored

ROW_BYTES = 16


class _Ends:
    """Known group ends in ascending order; ``exact[i]`` says that no other end
    lies between ``at[i]`` and ``at[i + 1]``."""

    def __init__(self, at: list[int], exact: list[bool]):
        self.at, self.exact = at, exact

    def walk(self, capacity: int, shards: int, sure: bool) -> list[int]:
        """Ends of greedy shards: where a cut surely can lie, or as far as one
        may lie at most."""
        out, here = [], 0
        for _ in range(shards):
            i = bisect_right(self.at, here + capacity) - 1
            last = i == len(self.at) - 1
            here = self.at[i] if sure or last or self.exact[i] else here + capacity
            out.append(here)
        return out

    def least(self, shards: int, sure: bool) -> int:
        low, high = 0, self.at[-1]
        while high - low > 1:
            middle = (low + high) // 2
            if self.walk(middle, shards, sure)[-1] >= self.at[-1]:
                high = middle
            else:
                low = middle
        return high


def _summary(ends: DataFrame, ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """(last end, number of ends) of each stretch of the ranges, ascending."""
    width = max(1, -(-sum(b - a for a, b in ranges) // length))
    stretch = F.lit(None).cast("long")
    for a, b in reversed(ranges):
        inside = (F.col("end") > a) & (F.col("end") <= b)
        stretch = F.when(inside, F.lit(a) + F.floor((F.col("end") - a - 1) / F.lit(width)).cast("long") * width).otherwise(stretch)
    rows = ends.withColumn("_s", stretch).where(F.col("_s").isNotNull()).groupBy("_s").agg(F.max("end").alias("e"), F.count("*").alias("n"))
    return sorted((r.e, r.n) for r in rows.select("e", "n").toLocalIterator())


def minimax_cuts(ends: DataFrame, total: int, shards: int, length: int = 16384) -> tuple[int, list[int]]:
    """The smallest capacity and the ends of the shards, for groups that end at
    ``end`` (distinct, the largest is ``total``).  ``length`` bounds the summary
    that the driver holds."""
    rows = _summary(ends, [(0, total)], length)
    known = _Ends([0] + [e for e, _ in rows], [n == 1 for _, n in rows])
    while True:
        enough, needed = known.least(shards, True), known.least(shards, False)
        low, high = known.walk(needed, shards, True), known.walk(enough, shards, False)
        ranges: list[tuple[int, int]] = []
        for a, b in zip(low, high, strict=True):
            i, j = bisect_right(known.at, a) - 1, bisect_right(known.at, b)
            gaps = [k for k in range(max(i, 0), min(j, len(known.at) - 1)) if not known.exact[k]]
            if gaps:
                new = (known.at[gaps[0]], known.at[gaps[-1] + 1])
                if ranges and new[0] < ranges[-1][1]:
                    ranges[-1] = (min(ranges[-1][0], new[0]), max(ranges[-1][1], new[1]))
                else:
                    ranges.append(new)
        if enough == needed and known.walk(enough, shards, True) == known.walk(enough, shards, False) or not ranges:
            return enough, known.walk(enough, shards, True)
        finer = _summary(ends, ranges, length)
        kept = [(e, x) for e, x in zip(known.at[1:], known.exact, strict=True) if not any(a < e <= b for a, b in ranges)]
        merged = sorted(kept + [(e, n == 1) for e, n in finer])
        known = _Ends([0] + [e for e, _ in merged], [x for _, x in merged])


def minimax_shards(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes plus 16.  A null text counts as empty, a
    null key stands first.  Repeated rows each get a slot; rows with equal texts
    share a shard.  An empty table gives no rows; with fewer groups than shards
    some shards stay empty.  Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = docs.select(F.col(key).alias("_id"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("_text"))
    sized = stored(sized, "sizes")
    groups = stored(sized.groupBy("_text").agg(F.min("_id").alias("_first"), F.sum("size").alias("_bytes")), "groups")
    largest = [(r["_text"], r["_bytes"]) for r in groups.orderBy(F.desc("_bytes"), "_first", "_text").limit(shards).collect()]
    left, alone = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"], []
    for name, size in largest:
        if len(alone) == shards - 1 or size * (shards - len(alone)) <= left:
            break
        alone.append(bytes(name))
        left -= size
    own = F.lit(None).cast("int")
    for i, name in enumerate(alone):
        own = F.when(F.col("_text") == F.lit(name), F.lit(i)).otherwise(own)
    # the left side may hold one text in a third of its rows: a sort-merge join of two stored tables, whose hot
    # partitions adaptive execution can split as no aggregate stands between exchange and join
    placed = sized.join(groups.select("_text", "_first").hint("merge"), "_text").withColumn("_own", own)
    rest = F.col("_own").isNull()
    sums = {"_end": F.when(rest, F.col("size")).otherwise(F.lit(0)).cast("long"), "_nth": F.when(rest, F.lit(1)).otherwise(F.lit(0)).cast("long"), "_row": F.lit(1).cast("long")}
    placed = stored(running(placed, ["_first", "_text", "_id"], sums, "ordered"), "placed")
    shard = F.col("_own")
    if left:
        ends = placed.where(rest).groupBy("_first", "_text").agg(F.max("_end").alias("end")).select("end")
        _, cuts = minimax_cuts(ends, left, shards - len(alone))
        inner = F.array(*[F.lit(c).cast("long") for c in cuts])
        shard = F.coalesce(shard, F.lit(len(alone)) + F.size(F.filter(inner, lambda c: c < F.col("_end"))))
    placed = placed.withColumn("shard", shard.cast("int")).withColumn("_at", F.when(F.col("_own").isNull(), F.col("_nth")).otherwise(F.col("_row")))
    first = {r.shard: r.at for r in placed.groupBy("shard").agg(F.min("_at").alias("at")).collect()}
    start = F.array(*[F.lit(first.get(i, 0)).cast("long") for i in range(shards)])
    return placed.select(F.col("_id").alias(key), "size", "text_crc32", "shard", (F.col("_at") - F.element_at(start, F.col("shard") + 1)).alias("slot"))
