"""SimHash near-dedup by segment popcounts: grid range-join under Manhattan distance, exact verification, and an exact join for what the grid can't see.

**Fingerprints.**  A document is the set of its distinct lower-case words.  Its *full* fingerprint is the 128-bit SimHash of that set; two
documents are near-duplicates when their full fingerprints differ in at most ``DISTANCE`` bits.  No grid is selective at such a radius, so
every document also has ``VIEWS`` *view* fingerprints of 64 bits: SimHashes of the same words under weights that fall off geometrically in the order of a
view's own hash, so that a few words, others in each view, decide.  A few edits leave most views within one bit.

**Embedding.**  A view is cut into 16 segments of 4 bits and mapped to the vector of their bit counts.  A bit flip moves one count by one, so the
Manhattan distance of two vectors is a lower bound of the Hamming distance of the views.  Pairs within distance 1 are found by a grid join: every
document enters its own cell, and those of even total count also the 32 cells around (vectors at distance 1 differ in parity, so one side is enough).  Cells hold
about 2^32 typical vectors, so candidates beyond true ones stay few at any size.  The grid joins distinct vectors, and the documents of vectors that meet come in only then, so
many near copies don't enter the cells around them many times.

**Verification.**  Within a cell, full fingerprints are compared exactly, by a breadth-first search that compares every member to those it isn't yet
connected to.  A cell has no cap: a large one is cut into blocks, and every two blocks meet in a task of their own.  Verified pairs go through distributed union-find, and of each
component the document of least id stays.  Documents of equal word sets are one node from the start, so exact copies cost nothing however many.

**The rest.**  The grid is complete for the views: no pair with a view within one bit is lost.  That a pair within ``DISTANCE`` of the full fingerprint has such a view is likely, not
certain.  So the full fingerprints of all nodes are joined once more, without a miss: they are dealt into blocks, and every two blocks meet in a task.  There the 128 bits are cut into parts
with a radius each, radii plus one adding up to ``DISTANCE`` plus one; a pair within ``DISTANCE`` is within the radius of at least one part, so only rows whose parts are that near are compared.  Pairs that
the grid has tied already aren't passed on; the others tie components of the first union-find in a second one.  Every link counts: groups are the components of all pairs within ``DISTANCE``, as a comparison
of all texts would give them.  The work of this join grows as the square of the number of distinct texts, with a factor that falls as blocks grow.

Defined results: a null text counts as empty; texts without words are near-duplicates of each other only if they are equal; a null id comes after
all others, by a hash of the text; of rows that agree in id and text one stays, and rows of one id with different texts are different documents; an empty table
gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmere.llm import common as C
from quillmere.llm.linededup import keyed

VIEWS, TOP, DECAY, DISTANCE = 12, 16, 0.6, 26
SEGMENTS = 16
#: Nodes that one block takes; beyond them there are ``BLOCKS``, and more once a block would pass ``BLOCK_MOST``. Blocks of fewer than ``DENSE`` nodes are compared outright.
BLOCK_LEAST, BLOCKS, BLOCK_MOST, DENSE = 1 << 14, 8, 1 << 19, 8_000
SEEDS = C.mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FALL = DECAY ** np.arange(TOP)
#: Byte -> its bits, one in each byte of a word of 64: eight counters are added at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
_NIBBLE = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def distinct_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct words of every row, sorted by row; hashes have 40 bits."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = C.lowered(raw)
    rows, starts, ends = C.words(low, off)
    key = (rows.astype(np.uint64) << np.uint64(40)) | (C.span_hashes(low, starts, ends) >> np.uint64(24))
    key = np.unique(key)
    return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)


def full_prints(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, 2) 128-bit SimHashes with equal weights."""
    out = np.zeros((n, 2), np.uint64)
    if not len(rows):
        return out
    # runs of at most 255 words, so that counters of a byte don't overflow
    start = np.searchsorted(rows, rows, side="left")
    turn = np.arange(len(rows)) - start
    runs = np.flatnonzero(turn % 255 == 0)
    owner = rows[runs]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    size = np.bincount(rows, minlength=n)[owner[first]]
    for j in range(2):
        bits = C.mix(h ^ SEEDS[60 + j]).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(_SPREAD[bits], runs, axis=0).view(np.uint8).reshape(len(runs), 64).astype(np.int32)
        ones = np.add.reduceat(ones, first, axis=0)
        out[owner[first], j] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def view_print(rows: np.ndarray, h: np.ndarray, n: int, view: int) -> np.ndarray:
    """(n,) 64-bit SimHashes of the ``TOP`` words that come first in the order of this view, weights falling by ``DECAY``."""
    out = np.zeros(n, np.uint64)
    if not len(rows):
        return out
    count = np.bincount(rows, minlength=n)
    u = C.mix(h ^ SEEDS[view])
    # far more than TOP words pass this bound; the documents where fewer do are taken whole
    share = np.minimum(48.0 / np.maximum(count, 1), 1.0)
    bound = np.where(share < 1, share * 2.0**63, 2.0**63).astype(np.uint64) * np.uint64(2) - np.uint64(1)
    near = u <= bound[rows]
    short = np.bincount(rows[near], minlength=n) < np.minimum(count, TOP)
    if short.any():
        near |= short[rows]
    r, hh, uu = rows[near], h[near], u[near]
    order = np.argsort((r.astype(np.uint64) << np.uint64(40)) | (uu >> np.uint64(24)), kind="stable")
    r, hh = r[order], hh[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
    top = rank < TOP
    r, hh, rank = r[top], hh[top], rank[top]
    bits = np.unpackbits(C.mix(hh ^ SEEDS[32 + view]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    votes = (bits - np.float32(0.5)) * _FALL[rank].astype(np.float32)[:, None]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    out[r[first]] = np.packbits(np.add.reduceat(votes, first, axis=0) > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """((rows, 2) full, (rows, VIEWS) view fingerprints) of a string column; texts without words get a hash of the text in both."""
    full, views = np.zeros((len(column), 2), np.uint64), np.zeros((len(column), VIEWS), np.uint64)
    for a, b, raw, off in C.chunks(column):
        rows, h = distinct_words(raw, off)
        full[a:b] = full_prints(rows, h, b - a)
        for v in range(VIEWS):
            views[a:b, v] = view_print(rows, h, b - a, v)
        bare = np.flatnonzero(np.bincount(rows, minlength=b - a) == 0)
        if len(bare):
            own = C.span_hashes(raw, off[:-1][bare], off[1:][bare]) if len(raw) else np.full(len(bare), 1, np.uint64)
            for j in range(2):
                full[a + bare, j] = C.mix(own ^ SEEDS[50 + j])
            views[a + bare] = C.mix(own ^ SEEDS[52])[:, None]
    return full, views


def counts_of(view: np.ndarray) -> np.ndarray:
    """(n, SEGMENTS) bit counts of the 4-bit segments."""
    b = view.view(np.uint8).reshape(-1, 8)
    return np.stack([_NIBBLE[b & 15], _NIBBLE[b >> 4]], axis=2).reshape(len(view), SEGMENTS)


_PLACE = (np.uint64(1) << (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(4)))


def codes(view: np.ndarray) -> np.ndarray:
    """(n,) vectors of bit counts, 4 bits a count."""
    return (counts_of(view).astype(np.uint64) * _PLACE).sum(1, dtype=np.uint64)


def around(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, index) of the own vectors and, for even totals, of the vectors at Manhattan distance 1."""
    counts = (code[:, None] >> (np.arange(SEGMENTS, dtype=np.uint64) * np.uint64(4)) & np.uint64(15)).astype(np.uint8)
    even = np.flatnonzero(counts.sum(1) % 2 == 0)
    found, index = [code], [np.arange(len(code))]
    for s in range(SEGMENTS):
        up, down = even[counts[even, s] < 4], even[counts[even, s] > 0]
        found += [code[up] + _PLACE[s], code[down] - _PLACE[s]]
        index += [up, down]
    return np.concatenate(found), np.concatenate(index)


def cells(view: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index) of the cells that fingerprints of a view enter. A cell is its vector, hashed with the view's number."""
    found, index = around(codes(view))
    return C.mix(found ^ SEEDS[number]), index


def _sketch(batches):
    for batch in batches:
        full, views = sketches(batch.column(2))
        node = full[:, 0].copy()
        for x in (full[:, 1], *views.T):
            node = C.mix(node * np.uint64(0x9E3779B97F4A7C15) + x)
        packed = np.ascontiguousarray(views)
        flat = pa.Array.from_buffers(pa.binary(8 * VIEWS), len(packed), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(full[:, 0].view(np.int64)), pa.array(full[:, 1].view(np.int64)), flat], names=["k", "v", "node", "f0", "f1", "views"])


def _points(batches):
    """(vec, code, view, h): the vector of every view of a node; ``vec`` is its own cell."""
    for batch in batches:
        node = batch.column(0)
        if not len(node):
            continue
        views = C.buffer_of(batch.column(1))[0].view(np.uint64).reshape(-1, VIEWS)
        for v in range(VIEWS):
            code = codes(np.ascontiguousarray(views[:, v]))
            vec = C.mix(code ^ SEEDS[v])
            yield pa.RecordBatch.from_arrays([pa.array(vec.view(np.int64)), pa.array(code.view(np.int64)), pa.array(np.full(len(code), v, np.int32)), node], names=["vec", "code", "view", "h"])


def _cells(batches):
    """(cell, vector number) of the cells of vectors."""
    for batch in batches:
        number, code, view = (batch.column(i).to_numpy() for i in range(3))
        for a in range(0, len(number), 4096):
            part = slice(a, a + 4096)
            cell, index = around(code[part].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(C.mix(cell ^ SEEDS[view[part]][index]).view(np.int64)), pa.array(number[part][index])], names=["cell", "node"])


def linked(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges that connect all rows of (n, 2) fingerprints within ``most`` bits."""
    rest, edges = np.arange(len(prints)), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            hit = np.bitwise_count(prints[rest] ^ prints[p]).sum(1) <= most
            if hit.any():
                found = rest[hit].tolist()
                edges += [(p, q) for q in found]
                queue += found
                rest = rest[~hit]
    return edges


def _verify(most: int):
    def run(batches):
        kept = None
        for batch in batches:
            part = [batch.column(i).to_numpy() for i in range(4)]
            if kept is not None:
                part = [np.concatenate([a, b]) for a, b in zip(kept, part, strict=True)]
            if not len(part[0]):
                continue
            # the last bucket of a batch may go on in the next
            tail = int(np.searchsorted(part[0], part[0][-1]))
            kept = [x[tail:] for x in part]
            yield edges_of([x[:tail] for x in part])
        if kept is not None:
            yield edges_of(kept)

    def edges_of(part):
        bucket, node, f0, f1 = part
        left, right = [], []
        if len(bucket):
            prints = np.stack([f0, f1], 1).view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            size = np.diff(cuts)
            two = cuts[:-1][size == 2]  # most buckets are pairs: all at once
            near = two[np.bitwise_count(prints[two] ^ prints[two + 1]).sum(1) <= most]
            left.append(node[near])
            right.append(node[near + 1])
            for s, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                found = np.array(linked(prints[s : s + n], most), np.int64).reshape(-1, 2)
                left.append(node[s + found[:, 0]])
                right.append(node[s + found[:, 1]])
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def parts_of(width: int, most: int) -> list[tuple[int, int, int, int]]:
    """(word, shift, width, radius) of parts of at most ``width`` bits: whoever is within ``most`` of 128 bits is within the radius of a part."""
    count = -(-64 // width)
    sizes = [64 // count + (i < 64 % count) for i in range(count)]
    places = sorted(((-w, word, sum(sizes[:i])) for word in (0, 1) for i, w in enumerate(sizes)))
    # beyond the radius in every part is at least the sum of (radius + 1) = most + 1 bits; wide parts take the greater radii
    base, more = divmod(most + 1, len(places))
    radii = [base - (n >= more) for n in range(len(places))]
    return [(word, shift, -w, r) for (w, word, shift), r in zip(places, radii, strict=True) if r >= 0]


def flips(width: int, most: int) -> np.ndarray:
    """Numbers of ``width`` bits of which at most ``most`` are set."""
    return np.array([sum(1 << i for i in c) for r in range(min(width, most) + 1) for c in combinations(range(width), r)], np.int64)


def _compared(a: np.ndarray, b: np.ndarray, most: int):
    for i in range(0, len(a), 256):
        for j in range(0, len(b), 4096):
            d = np.bitwise_count(a[i : i + 256, None, 0] ^ b[None, j : j + 4096, 0])
            d += np.bitwise_count(a[i : i + 256, None, 1] ^ b[None, j : j + 4096, 1])
            at = np.flatnonzero(d.ravel() <= most)
            if len(at):
                yield at // d.shape[1] + i, at % d.shape[1] + j


def within(a: np.ndarray, b: np.ndarray, most: int):
    """Runs of (row of ``a``, row of ``b``), together all pairs of (n, 2) fingerprints within ``most`` bits, some of them more than once."""
    least = min(len(a), len(b))
    if least < DENSE:
        yield from _compared(a, b, most)
        return
    for word, shift, width, radius in parts_of(min(16, int(np.log2(least / 24))), most):
        mask = np.uint64((1 << width) - 1)
        own, other = ((x[:, word] >> np.uint64(shift) & mask).astype(np.int64) for x in (a, b))
        rows, order = np.argsort(own, kind="stable"), np.argsort(other, kind="stable")
        there, size = b[order], np.bincount(other, minlength=1 << width)
        start, near = np.cumsum(size) - size, flips(width, radius)
        cuts = np.append(np.flatnonzero(np.diff(own[rows], prepend=-1)), len(rows)).tolist()
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            mine = rows[s:e]
            cell = near ^ own[mine[0]]
            cell = cell[size[cell] > 0]
            n = size[cell]
            at = np.repeat(start[cell] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            for x, y in _compared(a[mine], there[at], most):
                yield mine[x], order[at[y]]


def _ties(most: int):
    """(a, b) roots that a pair within ``most`` bits ties. Rows come as (pair, side, root, f0, f1), sorted by pair; a pair of a block with itself has one side."""

    def run(batches):
        pair, held = None, []
        for batch in batches:
            part = [batch.column(i).to_numpy() for i in range(5)]
            if not len(part[0]):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(part[0][1:] != part[0][:-1]) + 1, [len(part[0])]]).tolist()
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if pair is not None and part[0][s] != pair:
                    yield from ties_of(held)
                    held = []
                pair = part[0][s]
                held.append([x[s:e].copy() for x in part[1:]])
        if held:
            yield from ties_of(held)

    def ties_of(held):
        side, root, f0, f1 = (np.concatenate(x) for x in zip(*held, strict=True))
        prints, second = np.stack([f0, f1], 1).view(np.uint64), side == 1
        left, right = (root, root) if not second.any() else (root[~second], root[second])
        sides = (prints, prints) if not second.any() else (prints[~second], prints[second])
        found, many = [], 0
        for x, y in within(*sides, most):
            a, b = left[x], right[y]
            new = a != b
            if new.any():
                a, b = a[new], b[new]
                found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
                many += len(found[-1])
                if many > 1 << 20:  # ties repeat: what is held is the distinct ones, and a full load of them goes out
                    found = [np.unique(np.concatenate(found), axis=0)]
                    many = len(found[0])
                    if many > 1 << 19:
                        yield batch_of(found[0])
                        found, many = [], 0
        if found:
            yield batch_of(np.unique(np.concatenate(found), axis=0))

    def batch_of(ties):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ties[:, 0])), pa.array(np.ascontiguousarray(ties[:, 1]))], names=["a", "b"])

    return run


def ties(known: DataFrame, most: int) -> DataFrame:
    """(a, b) of roots that some pair of nodes within ``most`` bits ties. ``known``: h, root, f0, f1."""
    n = known.count()
    blocks = 1 if n <= BLOCK_LEAST else max(BLOCKS, -(-n // BLOCK_MOST))
    own = known.withColumn("i", F.pmod(F.xxhash64("h", F.lit(29)), F.lit(blocks)).cast("int"))
    # block i meets every block, itself too; the lesser of two is side 0
    placed = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = placed.select((F.least("i", "j") * F.lit(blocks).cast("bigint") + F.greatest("i", "j")).alias("pair"), (F.col("i") > F.col("j")).cast("int").alias("side"), "root", "f0", "f1")
    dealt = met.repartition(blocks * (blocks + 1) // 2, "pair").sortWithinPartitions("pair")
    return dealt.mapInArrow(C.lean(_ties(most)), "a bigint, b bigint")


def groups(rows: DataFrame, most: int = DISTANCE) -> DataFrame:
    """(k, v, group_k, group_v) of every document: the key of the kept document of its group. ``rows``: columns k, v, t."""
    C.settle(rows.sparkSession)
    made = C.cut(rows.select("k", "v", "t").mapInArrow(C.lean(_sketch), "k bigint, v bigint, node bigint, f0 bigint, f1 bigint, views binary"), "sketches")
    one = made.groupBy("node").agg(F.min("f0").alias("f0"), F.min("f1").alias("f1"), F.first("views").alias("views"))
    # small numbers take half the room of hashes in a shuffle
    nodes = C.cut(one.withColumn("h", F.monotonically_increasing_id()), "simhash-nodes")
    points = nodes.select("h", "views").mapInArrow(C.lean(_points), "vec bigint, code bigint, view int, h bigint")
    # the grid joins distinct vectors: nodes of one vector enter the cells around it once
    vectors = C.cut(points.groupBy("vec").agg(F.first("code").alias("code"), F.first("view").alias("view"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "simhash-vectors")
    celled = vectors.select("id", "code", "view").mapInArrow(C.lean(_cells), "cell bigint, node bigint")
    shared = celled.repartition("cell").sortWithinPartitions("cell").mapInArrow(C.lean(C.shared_cells), "bucket bigint, node bigint").distinct()
    met = shared.join(vectors.select(F.col("id").alias("node"), "vec"), "node").select("vec", "bucket")
    same = vectors.where("n > 1").select("vec", F.xxhash64("vec", F.lit("same")).alias("bucket"))
    buckets = C.cut(points.select("vec", "h").join(met.union(same), "vec").select("bucket", "h").distinct(), "simhash-buckets")
    C.discard(vectors)
    members = C.blocked(buckets).join(nodes.select("h", "f0", "f1"), "h").select("bucket", "h", "f0", "f1").repartition("bucket").sortWithinPartitions("bucket", "h")
    roots = C.components(members.mapInArrow(C.lean(_verify(most)), "a bigint, b bigint"), "simhash-cc")
    C.discard(buckets)
    # a node of no component is its own root
    known = C.cut(nodes.join(roots.withColumnRenamed("node", "h"), "h", "left").select("node", "h", F.coalesce("root", "h").alias("root"), "f0", "f1"), "simhash-known")
    C.discard(nodes)
    last = C.components(ties(known.select("h", "root", "f0", "f1"), most), "simhash-rest").select(F.col("node").alias("root"), F.col("root").alias("last"))
    rooted = known.select("node", "root").join(last, "root", "left").select("node", F.coalesce("last", "root").alias("g"))
    tied = made.select("k", "v", "node").join(rooted, "node").select("k", "v", "g")
    kept = tied.groupBy("g").agg(F.min(F.struct("k", "v")).alias("kept"), F.count(F.lit(1)).alias("n"))
    return tied.join(kept, "g").select("k", "v", F.col("kept.k").alias("group_k"), F.col("kept.v").alias("group_v"), F.col("n").alias("group_size"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = DISTANCE) -> DataFrame:
    """(id, group, group_size, keep) of every row: group is the key of the kept document (its id, where ids are whole numbers)."""
    rows = keyed(docs, id_column, text_column)
    placed = groups(rows, most)
    at = C.position(docs, id_column)
    ids = rows.select("k", F.col("q_row").getField(f"c{at}").alias("id"))
    turn = F.row_number().over(W.partitionBy("k", "v").orderBy("group_k"))
    null_ids = docs.schema[docs.columns[at]].dataType.typeName() not in ("long", "integer", "short", "byte")
    marked = placed.withColumn("turn", turn).select("k", "v", "group_k", "group_size", ((F.col("k") == F.col("group_k")) & (F.col("v") == F.col("group_v")) & (F.col("turn") == 1)).alias("keep"))
    if null_ids:  # ids of another type stand beside their key
        names = ids.select(F.col("k").alias("k2"), "id").distinct()
        return marked.join(names, F.col("k") == F.col("k2")).select(F.col("id").alias(id_column), F.col("group_k").alias("group"), "group_size", "keep")
    kind = docs.schema[docs.columns[at]].dataType
    # the keys of null ids are hashes beyond 2^62; a real id as great as that is told from them by the table
    great = C.pick(docs, k2=id_column, t=text_column).where(F.col("k2") >= F.lit(1 << 62)).select(F.col("k2").cast("bigint").alias("k2"), F.xxhash64("t").alias("v2")).distinct()
    marked = marked.join(great, (F.col("k") == F.col("k2")) & (F.col("v") == F.col("v2")), "left")
    own = F.when((F.col("k") < F.lit(1 << 62)) | F.col("k2").isNotNull(), F.col("k").cast(kind))
    return marked.select(own.alias(id_column), F.col("group_k").alias("group"), "group_size", "keep")


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = DISTANCE) -> DataFrame:
    """One document of each group, with all its columns."""
    rows = keyed(docs, id_column, text_column)
    kept = groups(rows, most).select(F.col("group_k").alias("k"), F.col("group_v").alias("v")).distinct()
    found = rows.select("q_row", "k", "v").join(kept, ["k", "v"], "left_semi")
    one = found.withColumn("turn", F.row_number().over(W.partitionBy("k", "v").orderBy(F.lit(1)))).where("turn = 1")
    return C.unwrapped(one.select("q_row"), docs)
