"""Sharding: best-fit-decreasing bin packing of indivisible groups into shards of fixed capacity.

Groups are taken by size, largest first; each enters the bin with the least room that still fits it, found in a balanced tree
of remaining capacities; if none fits, a bin is opened.  The order among groups of one size doesn't change the packing,
so the tree runs over the *histogram* of sizes: a run of equal groups fills equal bins together.  The result is exactly that
of packing group by group.  The histogram streams through one task in the order of sizes, a row a distinct size; what the task holds is the tree,
which has at most as many rooms as the capacity has bytes, and nothing meets in the driver.  What it makes is a plan of (size, first place, end place, bin,
places a bin); executors place each group within its size and find its bin by a range join: plan and groups are cut into pieces of ``PIECE`` places,
they meet by size and piece, and the places decide.  So a hot size is many pieces.

Defined results: a null text or size weighs 0; groups of size 0 go to the first shard; a null group is a group of its own
together with all other null groups; a group larger than the capacity gets a shard of its own; among groups of one size,
place follows a hash of the group and then the group; repeated rows stay in one shard as they are in one group; empty input gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm import common as C

#: Production capacity of a shard, in bytes of text.
CAPACITY = 16 << 20
#: Places within a size that meet in one key of the range join.
PIECE = 4096


class RoomTree:
    """Remaining capacity -> ranges of bins, in a balanced order: sorted blocks that split when they grow (a B-tree of two levels)."""

    WIDTH = 512

    def __init__(self):
        self.blocks: list[list[int]] = []
        self.tops: list[int] = []
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, lo: int, hi: int) -> None:
        """Bins lo..hi-1 have this room."""
        if room in self.bins:
            self.bins[room].append((lo, hi))
            return
        self.bins[room] = [(lo, hi)]
        if not self.blocks:
            self.blocks, self.tops = [[room]], [room]
            return
        i = min(bisect_left(self.tops, room), len(self.blocks) - 1)
        insort(self.blocks[i], room)
        self.tops[i] = self.blocks[i][-1]
        if len(self.blocks[i]) > self.WIDTH:
            half = self.blocks[i][self.WIDTH // 2 :]
            del self.blocks[i][self.WIDTH // 2 :]
            self.blocks.insert(i + 1, half)
            self.tops[i : i + 1] = [self.blocks[i][-1], half[-1]]

    def tightest(self, size: int) -> int | None:
        """The least room that is at least ``size``."""
        i = bisect_left(self.tops, size)
        if i == len(self.tops):
            return None
        block = self.blocks[i]
        return block[bisect_left(block, size)]

    def take(self, room: int) -> tuple[int, int]:
        """Remove and return one range of bins with this room."""
        got = self.bins[room].pop(0)
        if not self.bins[room]:
            del self.bins[room]
            i = bisect_left(self.tops, room)
            block = self.blocks[i]
            del block[bisect_left(block, room)]
            if block:
                self.tops[i] = block[-1]
            else:
                del self.blocks[i], self.tops[i]
        return got


def plan(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """([(size, first place, end place, first bin, places a bin)], bins) of best-fit-decreasing over (size, count)."""
    out = list(planned(sorted(histogram, reverse=True), capacity))
    return out, max((first + -(-(end - place) // each) for _, place, end, first, each in out), default=0)


def planned(histogram: Iterable[tuple[int, int]], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The rows of a plan, from (size, count) in falling order of sizes."""
    if capacity < 1:
        raise ValueError("the capacity is at least 1")
    tree, bins = RoomTree(), 0
    for size, count in histogram:
        place = 0
        if size <= 0:
            yield size, 0, count, 0, count
            continue
        while place < count:
            left = count - place
            room = tree.tightest(size) if size <= capacity else None
            if room is None:
                each = max(1, capacity // size)
                lo, room = bins, capacity
                hi = bins + -(-left // each)
                bins = hi
            else:
                lo, hi = tree.take(room)
                each = room // size
            # a bin takes ``each`` groups before the next one of its class is touched: after one it is the tightest
            full = min(hi - lo, left // each)
            if full:
                yield size, place, place + full * each, lo, each
                place += full * each
                if room - each * size > 0:
                    tree.add(room - each * size, lo, lo + full)
                lo += full
            rest = count - place
            if lo < hi and rest and rest < each:
                yield size, place, count, lo, each
                place = count
                if room - rest * size > 0:
                    tree.add(room - rest * size, lo, lo + 1)
                lo += 1
            if lo < hi:
                tree.add(room, lo, hi)


def _plans(capacity: int):
    """Rows of the plan, a batch at a time; the input is one partition, sorted."""

    def run(batches):
        rows = planned(((s, n) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), capacity)
        while some := list(islice(rows, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=["ps", "lo", "hi", "first", "each"])

    return run


def pack(df: DataFrame, group: str, size: str, capacity: int = CAPACITY, rows_per_cell: int = 50_000) -> DataFrame:
    """(g, size, shard) of every distinct value of column ``group``; a group's size is the sum over its rows of column ``size``."""
    if capacity < 1:
        raise ValueError("the capacity is at least 1")
    rows = C.pick(df, g=group, s=size)
    groups = C.cut(rows.groupBy("g").agg(F.sum(F.greatest(F.coalesce(F.col("s"), F.lit(0)), F.lit(0))).cast("bigint").alias("size")), "groups")
    histogram = C.cut(groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # a row a distinct size: there are no more of them than the capacity, and of groups beyond it
    table = C.cut(histogram.coalesce(1).sortWithinPartitions(F.desc("size")).mapInArrow(C.lean(_plans(capacity)), "ps bigint, lo bigint, hi bigint, first bigint, each bigint"), "plan")
    # hot sizes are at most a group in ``rows_per_cell``
    hot = {r["size"]: r["n"] for r in histogram.where(F.col("n") > rows_per_cell).toLocalIterator()}
    ranked = C.spread_rank(groups, "size", ["g"], hot, rows_per_cell).withColumn("piece", F.floor(F.col("q_rank") / PIECE))
    pieces = table.withColumn("pp", F.explode(F.sequence(F.floor(F.col("lo") / PIECE), F.floor((F.col("hi") - 1) / PIECE))))
    joined = ranked.join(pieces, (F.col("size") == F.col("ps")) & (F.col("piece") == F.col("pp")) & (F.col("q_rank") >= F.col("lo")) & (F.col("q_rank") < F.col("hi")))
    return joined.select("g", "size", (F.col("first") + F.floor((F.col("q_rank") - F.col("lo")) / F.col("each"))).cast("bigint").alias("shard"))


def shard_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, size, group_size, shard) of every document; all copies of one text are one group and share a shard."""
    rows = C.pick(docs, k=id_column, t=text_column).select("k", F.md5(F.coalesce("t", F.lit("")).cast("binary")).alias("g"), F.octet_length(F.coalesce("t", F.lit(""))).cast("bigint").alias("size"))
    placed = pack(rows, "g", "size", capacity).select("g", F.col("size").alias("group_size"), "shard")
    return rows.join(placed, "g").select(F.col("k").alias(id_column), "size", "group_size", "shard")
