"""Shared parts of the corpus operators: settings, vectorised text kernels, union-find, ranks.

The text kernels work on whole Arrow string buffers: a chunk of rows is one flat ``uint8`` array with row
offsets, so per-character work runs in numpy and never in a Python loop.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.functions.batches import lean, settle, trim  # noqa: F401 - the operators take them from here

#: Bytes of text that a kernel handles at once; numpy temporaries are about thirty times this.
CHUNK_BYTES = 1 << 18
U64 = np.uint64
MASK = (1 << 64) - 1


def local_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """A table of a few rows that the driver holds.

    They go to the JVM as Arrow. As plain rows they are pickled and pass a Python function of an RDD, for which every executor starts a second daemon with workers of
    its own; these stay beside the workers of the operators (84 MB with two cores). Types whose Arrow form isn't that of their rows go the plain way.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not all(isinstance(f.dataType, (T.StringType, T.IntegralType, T.BooleanType)) for f in kind):
        return spark.createDataFrame(rows, kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)
    columns = zip(*rows, strict=True) if rows else [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), kind)


_SCOPES: list[list[str]] = []


@contextmanager
def scope():
    """Tables that ``cut`` writes inside are deleted at the end, but for those it is told to keep: for steps whose result has been written by then."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.pop()
        spark = SparkSession.active()
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Cut lineage in a way that outlives executors: write to the shared checkpoint folder and read again.

    The folder is the one of ``spark.checkpoint.dir``.  In local mode, as in tests, one beside the session's warehouse stands in where none is set.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def wrapped(df: DataFrame, **keys) -> DataFrame:
    """The row as one struct ``q_row`` beside named key columns: no column of the caller can clash with ours."""
    names = [f"c{i}" for i in range(len(df.columns))]
    flat = df.toDF(*names)
    picked = {}
    for alias, column in keys.items():
        i = position(df, column)
        picked[alias] = None if i is None else F.col(names[i])
    return flat.select(F.struct(*names).alias("q_row"), *[(F.lit(None) if c is None else c).alias(a) for a, c in picked.items()])


def unwrapped(df: DataFrame, like: DataFrame) -> DataFrame:
    """The caller's own columns again, in their order and under their names."""
    names = [f"c{i}" for i in range(len(like.columns))]
    return df.select(*[F.col("q_row").getField(n).alias(n) for n in names]).toDF(*like.columns)


def position(df: DataFrame, column: str) -> int | None:
    """Index of a column: the exact name first, else ignoring case."""
    if column in df.columns:
        return df.columns.index(column)
    lowered = [c.lower() for c in df.columns]
    return lowered.index(column.lower()) if column.lower() in lowered else None


def pick(df: DataFrame, **keys: str) -> DataFrame:
    """Only the named columns under our own aliases; resolves by position, so clashing extra names don't matter."""
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = []
    for alias, column in keys.items():
        i = position(df, column)
        if i is None:
            raise ValueError(f"no column {column!r} among {df.columns}")
        out.append(F.col(f"c{i}").alias(alias))
    return flat.select(*out)


# ------------------------------------------------------------------------------------------------ text kernels


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        return buffer_of(column)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer row comes alone."""
    raw, off = buffer_of(column)
    rows, start = len(off) - 1, 0
    while start < rows:
        end = int(np.searchsorted(off, off[start] + most, side="right")) - 1
        end = min(rows, max(end, start + 1))
        yield start, end, raw[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_POWERS: dict[str, np.ndarray] = {}
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", BASE), ("i", INVERSE)):
            table = np.full(size, base, U64)
            table[0] = 1
            _POWERS[key] = np.multiply.accumulate(table)
    return _POWERS["p"], _POWERS["i"]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of one flat text; equal bytes have equal hashes."""
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * power[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


#: ASCII letters to lower case; everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters, digits and all that is not ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented Latin-1 letters of UTF-8 (C3 80 to C3 9E)."""
    out = LOWER[raw]
    after = np.flatnonzero(raw[:-1] == 0xC3) + 1
    if len(after):
        b = raw[after]
        out[after] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 0x20, b)
    return out


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the words of every row; a word doesn't cross rows."""
    is_word = WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = is_word[1:] != is_word[:-1]
    edge[off] = True
    edge[0] = edge[len(raw)] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = is_word[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return np.searchsorted(off, starts, side="right") - 1, starts, ends


# ------------------------------------------------------------------------------------------------ ranks


def spread_rank(df: DataFrame, key: str, order: list[str], counts: dict, rows_per_cell: int = 50_000) -> DataFrame:
    """``df`` with ``q_rank``: the 0-based place of each row within its key, by a hash of ``order`` and then ``order``.

    ``counts`` has the rows of every key of more than ``rows_per_cell``; others may be in it.  A hot key never meets one task: it is cut into cells, which are
    ranges of the hash, and a row's place is the rows of the cells before plus its place in its own cell.  ``df`` is shuffled
    once, by key and cell; the tables of hot keys and their cells are broadcast while they are small.  Rows that agree in everything get different places.
    """
    from pyspark.sql import Window as W

    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    cells = [(k, -(-n // rows_per_cell)) for k, n in counts.items() if n > rows_per_cell]
    small = sum(c for _, c in cells) < 1_000_000
    hint = F.broadcast if small else (lambda x: x)
    sized = local_table(spark, cells, f"qk {kind}, q_cells bigint")
    celled = df.join(hint(sized), F.col(key).eqNullSafe(F.col("qk")), "left").drop("qk").withColumn("q_salt", F.shiftrightunsigned(F.xxhash64(*order), 33))
    celled = celled.withColumn("q_cell", F.floor(F.col("q_salt") * F.coalesce("q_cells", F.lit(1)) / F.lit(float(1 << 31))))
    inside = celled.where("q_cells is not null").groupBy(key, "q_cell").agg(F.count(F.lit(1)).alias("q_in"))
    before = F.coalesce(F.sum("q_in").over(W.partitionBy(key).orderBy("q_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = inside.select(F.col(key).alias("qk"), F.col("q_cell").alias("qc"), before.alias("q_before"))
    placed = celled.drop("q_cells").withColumn("q_place", F.row_number().over(W.partitionBy(key, "q_cell").orderBy("q_salt", *order)))
    placed = placed.join(hint(inside), F.col(key).eqNullSafe(F.col("qk")) & (F.col("q_cell") == F.col("qc")), "left")
    return placed.withColumn("q_rank", (F.col("q_place") - 1 + F.coalesce("q_before", F.lit(0))).cast("long")).drop("q_salt", "q_cell", "q_place", "q_before", "qc", "qk")


# ------------------------------------------------------------------------------------------------ union-find


#: Nodes of one cell that a task holds at once.
CELL_NODES = 1 << 20


def _cells(cell: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """(bucket, node) of the cells of two nodes and more; all rows of a cell are there."""
    order = np.lexsort((node, cell))
    cell, node = cell[order], node[order]
    new = np.ones(len(cell), bool)
    new[1:] = (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])
    cell, node = cell[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(cell)))
    many = size > 1
    if not many.any():
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(0, np.int64)), pa.array(np.zeros(0, np.int64))], names=["bucket", "node"])
    # a name that depends on the members only, so that equal cells are one bucket
    total = np.add.reduceat(mix(node.view(np.uint64)), first)
    keep = np.repeat(many, size)
    name = np.repeat(mix(total + size.astype(np.uint64)).view(np.int64), size)[keep]
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(node[keep])], names=["bucket", "node"])


def shared_cells(batches):
    """(bucket, node) of the cells that hold more than one node; cells of equal members are one bucket, but for those beyond ``CELL_NODES``.

    Rows come sorted by cell, all of a cell in one partition.  What is held is a batch and the cell that may go on; a cell that grows beyond ``CELL_NODES``
    is passed on as it comes, under its own name.
    """
    cell, node, passing = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def own(node: np.ndarray) -> pa.RecordBatch:
        name = mix(np.array([passing], np.int64).view(np.uint64) ^ U64(0x5851F42D4C957F2D)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(name, len(node))), pa.array(node)], names=["bucket", "node"])

    for batch in batches:
        more, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if passing is not None:
            stop = int(np.searchsorted(more, passing, side="right"))
            if stop:
                yield own(nodes[:stop])
            more, nodes = more[stop:], nodes[stop:]
            if not len(more):
                continue
            passing = None
        cell, node = np.concatenate([cell, more]), np.concatenate([node, nodes])
        if not len(cell):
            continue
        tail = int(np.searchsorted(cell, cell[-1]))
        if tail:
            yield _cells(cell[:tail], node[:tail])
            cell, node = cell[tail:], node[tail:]
        if len(cell) > CELL_NODES:
            passing = int(cell[-1])
            yield own(node)
            cell, node = cell[:0], node[:0]
    if len(cell):
        yield _cells(cell, node)


#: Members of a bucket that are compared in one task.
BLOCK_MEMBERS = 8_000


def blocked(members: DataFrame, most: int = BLOCK_MEMBERS) -> DataFrame:
    """``members`` (bucket, h), its buckets of more than ``most`` members replaced by one bucket for every two of their blocks.

    Any two members of a bucket meet in some block pair, so no link is lost, and no task holds more than two blocks.
    """
    # buckets that are so large are few: one in ``most`` members at the most
    hot = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("bucket", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    some = hot.limit(100_001).collect()
    if not some:
        return members.select("bucket", "h")
    if len(some) <= 100_000:
        hot = F.broadcast(local_table(members.sparkSession, some, hot.schema))
    marked = members.join(hot, "bucket", "left").withColumn("i", F.pmod(F.xxhash64("h", F.lit(17)), F.coalesce("blocks", F.lit(1)).cast("bigint")).cast("int"))
    # block i meets every block: (i, j) and (j, i) are one pair; with two blocks and more, pairs of different blocks cover what is inside them
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("i"))
    pair = lambda j: F.xxhash64("bucket", F.least(F.col("i"), j), F.greatest(F.col("i"), j))
    cells = F.when(F.coalesce("blocks", F.lit(1)) < 2, F.array("bucket")).otherwise(F.transform(others, pair))
    return marked.select(F.explode(cells).alias("bucket"), "h")


#: Bits of a filter of hashes, and rows of it.
FILTER_BITS, FILTER_ROW = 27, 15


class Filter:
    """A set of 64-bit hashes as one bit each by their first 27 bits: it may let others pass, and never holds one back. 16 MB, however many there are."""

    def __init__(self, hashes: DataFrame, column: str = "h"):
        spark = hashes.sparkSession
        place = F.shiftrightunsigned(column, 64 - FILTER_BITS)
        rows = hashes.select(F.shiftright(place, FILTER_ROW).alias("row"), (place.bitwiseAND((1 << FILTER_ROW) - 1) + 1).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        width = 1 << FILTER_ROW - 3
        bits = np.zeros((1 << FILTER_BITS - FILTER_ROW, width), np.uint8)
        # 4096 rows of 4 KB at most
        for r in rows.toLocalIterator():
            bits[r["row"]] = np.frombuffer(r["bits"], np.uint8)
        self.shared = spark.sparkContext.broadcast(bits.tobytes())

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Whether a hash (uint64) may be in the set."""
        bits = np.frombuffer(self.shared.value, np.uint8)
        place = (h >> U64(64 - FILTER_BITS)).astype(np.int64)
        return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


# ------------------------------------------------------------------------------------------------ components


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge, root being the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes (Kiveris et al., 2014): O(log² n) rounds, each a
    shuffle of the edges that are left, with lineage cut through the shared folder.  Columns of ``edges``: a, b.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, last = cut(both, name), None
    for _ in range(rounds):
        # large star: every greater neighbour of a node is tied to the least of the node and its neighbours
        ways = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = F.least(F.min("v").over(_by("u")), F.col("u"))
        large = ways.select("u", "v", least.alias("m")).where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lesser neighbours are tied to the least of them
        least = F.min("b").over(_by("a"))
        starred = large.select("a", "b", least.alias("m"))
        small = starred.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(starred.select("a", F.col("m").alias("b"))).distinct()
        following = cut(small, name)
        state = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(current)
        current = following
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("the components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _by(column: str):
    from pyspark.sql import Window as W

    return W.partitionBy(column)


class UnionFind:
    """Roots of small local sets, least index first."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True
