"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks of ``block_docs``.  Block *j* (from 0) of a source of weight *w* has the release time
``floor(j / w)`` and the deadline ``ceil((j + 1) / w)``; in every slot the released block of earliest deadline goes.  With weights that
add up to 1 every slot is filled, every deadline is met, and at any moment the blocks dealt from a source differ from its target
by less than one block.

Weights are exact: whole numbers of any size in their proportion, never rounded to ticks, so the bound holds however long the mix is.  The
slots are dealt with a heap in one task, one step a block (not a document), and joined to the documents by source and run of blocks.  When a source runs
out, the remaining sources go on at their weights in proportion (a new phase); the bound holds within each phase.  Every document
is placed, none is dropped or repeated.

Defined results: a null source is a source like any other; a source that has no positive target goes after all others, as one last phase
in proportion to size; a null text or id doesn't matter; repeated rows are placed each; ties between blocks of one deadline go to the source
of greater weight and then of lesser name; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm import common as C

BLOCK_DOCS = 16
RESOLUTION = 10_000
ALPHA = 0.7
#: Blocks of a source that share a row of the schedule.
PIECE = 1024
#: A deadline beyond all slots, of a block of almost no weight, is cut to this.
LATEST = (1 << 63) - 1


def tempered(counts: dict, alpha: float = ALPHA) -> dict:
    """Target weights in proportion to size ** alpha: large sources give way to small ones."""
    total = sum(n**alpha for n in counts.values())
    return {s: n**alpha / total for s, n in counts.items()} if total else {}


def exact(weights: dict) -> dict:
    """Whole numbers in exactly the proportion of the weights; a float counts as the decimal it is written as."""
    parts = {s: Fraction(str(w)) for s, w in weights.items()}
    common = lcm(*(p.denominator for p in parts.values()))
    ticks = {s: int(p * common) for s, p in parts.items()}
    divisor = gcd(*ticks.values())
    return {s: a // divisor for s, a in ticks.items()}


def dealt(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block, phase, slot, release, deadline) of every block in the order of slots; a phase ends when a source has run out.

    Earliest deadline first, in whole numbers of any size. Memory is that of the sources, however many the blocks.
    """
    live = {s: w for s, w in weights.items() if blocks.get(s, 0) > 0 and w > 0}
    rest = {s: n for s, n in blocks.items() if n > 0 and s not in live}
    done, start, phase = dict.fromkeys(blocks, 0), 0, 0
    while live or rest:
        if not live:
            live, rest = {s: n for s, n in rest.items()}, {}
        ticks = exact(live)
        h = sum(ticks.values())
        names = sorted(ticks, key=lambda s: (-ticks[s], s is None, str(s)))
        tick, first, left = [ticks[s] for s in names], [done[s] for s in names], [blocks[s] - done[s] for s in names]
        own = [0] * len(names)
        future = [(0, i) for i in range(len(names))]
        ready: list[tuple[int, int]] = []
        t = 0
        while True:
            while future and future[0][0] <= t:
                _, i = heapq.heappop(future)
                heapq.heappush(ready, (-(-(own[i] + 1) * h // tick[i]), i))
            due, i = heapq.heappop(ready)
            j, a = own[i], tick[i]
            yield names[i], first[i] + j, phase, start + t, start + j * h // a, min(start + due, LATEST)
            own[i] = j + 1
            t += 1
            if j + 1 == left[i]:
                break
            heapq.heappush(future, ((j + 1) * h // a, i))
        done.update({s: first[i] + own[i] for i, s in enumerate(names)})
        start, phase = start + t, phase + 1
        live = {s: w for s, w in live.items() if done[s] < blocks[s]}


def pieces(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, piece, phase, first block, slots, releases, deadlines) of the blocks of one phase whose number divided by ``PIECE`` is ``piece``."""
    open_: dict = {}
    now = 0
    for s, j, phase, *times in dealt(blocks, weights):
        if phase != now:
            yield from open_.values()
            open_, now = {}, phase
        if s in open_ and open_[s][1] != j // PIECE:
            yield open_.pop(s)
        row = open_.setdefault(s, (s, j // PIECE, phase, j, [], [], []))
        for column, x in zip(row[4:], times, strict=True):
            column.append(x)
    yield from open_.values()


SCHEMA = "src string, piece bigint, phase int, lo bigint, slots array<bigint>, releases array<bigint>, deadlines array<bigint>"


def schedule(spark: SparkSession, blocks: dict, weights: dict) -> DataFrame:
    """The pieces as a table, written once; they are dealt in one task, a batch at a time, and never meet in the driver."""
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3]
    names = ["src", "piece", "phase", "lo", "slots", "releases", "deadlines"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = pieces(blocks, weights)
                while some := list(islice(rows, 64)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    return C.cut(spark.range(0, 1, 1, 1).mapInArrow(C.lean(run), SCHEMA), "schedule")


def place(df: DataFrame, source_column: str, order: list[str], weights: dict | None = None, block_docs: int = BLOCK_DOCS, resolution: int = RESOLUTION, alpha: float = ALPHA) -> DataFrame:
    """``df`` with q_block, q_phase, q_position, q_release and q_deadline; ``source_column`` and ``order`` are columns of ``df``.

    ``weights``: target weight by source; None means sizes tempered by ``alpha``. ``resolution`` rounds nothing any more: calls that have it still work.
    """
    spark = df.sparkSession
    # sources are few (a mixture names them); their counts cover every document
    counts = {r[0]: r[1] for r in df.groupBy(source_column).count().toLocalIterator()}
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    table = schedule(spark, blocks, tempered(counts, alpha) if weights is None else weights)
    ranked = C.spread_rank(df, source_column, order, counts).withColumn("q_block", F.floor(F.col("q_rank") / block_docs).cast("bigint"))
    small = sum(blocks.values()) < 1_000_000
    j = F.col("q_block") - F.col("lo")
    hit = F.col(source_column).eqNullSafe(F.col("src")) & (F.floor(F.col("q_block") / PIECE).cast("bigint") == F.col("piece")) & (j >= 0) & (j < F.size("slots"))
    joined = ranked.join(F.broadcast(table) if small else table, hit)
    at = lambda name: F.element_at(name, (j + 1).cast("int"))
    return joined.select(*df.columns, "q_rank", "q_block", F.col("phase").alias("q_phase"), at("slots").alias("q_slot"), at("releases").alias("q_release"), at("deadlines").alias("q_deadline"))


def mix_documents(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", weights: dict | None = None, block_docs: int = BLOCK_DOCS, resolution: int = RESOLUTION, alpha: float = ALPHA) -> DataFrame:
    """(id, source, block, phase, slot, release, deadline) of every document."""
    rows = C.pick(docs, k=id_column, s=source_column)
    placed = place(rows, "s", ["k"], weights, block_docs, resolution, alpha)
    return placed.select(F.col("k").alias(id_column), F.col("s").alias(source_column), F.col("q_block").alias("block"), F.col("q_phase").alias("phase"), F.col("q_slot").alias("slot"), F.col("q_release").alias("release"), F.col("q_deadline").alias("deadline"))


def mixed(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", weights: dict | None = None, block_docs: int = BLOCK_DOCS, resolution: int = RESOLUTION, alpha: float = ALPHA) -> DataFrame:
    """The documents, all columns, in the order of the mix: sorted by slot, files in order."""
    rows = C.wrapped(docs, k=id_column, s=source_column)
    placed = place(rows, "s", ["k"], weights, block_docs, resolution, alpha)
    return C.unwrapped(placed.orderBy("q_slot", "q_rank"), docs)


def positioned(docs: DataFrame, name: str = "position") -> DataFrame:
    """``docs``, as read from the files of a mix, with the 0-based place of every row in it.

    Spark packs files into tasks by length, so reading doesn't keep their order; but partition *n* of a sorted table was written to the file of number *n*, and a
    row's index in its file stands in the file's metadata.  A table that doesn't come from files as it is, is written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = C.cut(docs, "mix")
    read = docs.select("*", F.col("_metadata.file_path").alias("q_file"), F.col("_metadata.row_index").alias("q_index"))
    files = {r[0]: r[1] for r in read.groupBy("q_file").agg(F.max("q_index") + 1).toLocalIterator()}

    def number(path: str) -> tuple:
        found = re.search(r"part-(\d+)-.*?(?:-c(\d+))?[.][^/]*$", path)
        return (int(found[1]), int(found[2] or 0), path) if found else (0, 0, path)

    starts, start = [], 0
    for path in sorted(files, key=number):
        starts.append((path, start))
        start += files[path]
    # files are few: their number is that of the tasks that wrote them
    table = C.local_table(docs.sparkSession, starts, "q_path string, q_start bigint")
    joined = read.join(F.broadcast(table), F.col("q_file") == F.col("q_path"))
    return joined.select(*[f"`{c}`" for c in docs.columns], (F.col("q_start") + F.col("q_index")).alias(name))
