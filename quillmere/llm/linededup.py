"""Fuzzy line dedup by MinHash: signatures, banding, exact Jaccard verification, union-find, one line a component.

1. Every document is cut into lines.  Equal lines are one *line* with its first place (least document, then line number) and a count.  A
   line's signature is the minimum of 32 hash functions over its shingles of 8 characters; 8 bands of 4 minima give 8 bucket keys.
   Two lines of Jaccard similarity 0.8 share a bucket with probability 0.985.
2. Buckets of two or more lines are candidates.  Within a bucket, texts are compared by exact Jaccard of their shingle sets, by
   a breadth-first search that compares every line to those it isn't yet connected to.  Buckets with the same members are handled once.  There
   is no cap on a bucket: a large one is cut into blocks, and every two blocks meet in a task of their own.
3. Verified pairs go through distributed union-find; of each component the line with the first place stays, and every other
   occurrence of any of its lines is deleted.

All that moves between executors is hashes and places, except for the texts of candidate lines and, at the end, one join of documents with
their deleted line numbers.

Defined results: lines of white space only are left alone and never deleted; a line shorter than a shingle is its only shingle, so it
matches equal lines only; a null text stays null; a null id is placed after all ids, by a hash of the text; rows that agree in id and
text are one document, so a line that stays in it stays in each of these rows; rows of one id and different texts are different documents, the one of lesser text
hash first; an empty table gives an empty result; columns besides id and text are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm import common as C

SHINGLE, ROWS, BANDS, JACCARD = 8, 4, 8, 0.8
_rng = np.random.default_rng(20240229)
MULTIPLIERS = (_rng.integers(0, 1 << 31, size=ROWS * 64, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def lines_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, start, end) of all lines that aren't white space only; lines end at \\n and count from 0."""
    breaks = np.flatnonzero(raw == 10)
    filled = np.diff(off) > 0
    count = np.diff(np.searchsorted(breaks, off)) + filled
    starts = np.sort(np.concatenate([off[:-1][filled], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, off[1:][filled]]))
    row = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
    solid = np.concatenate([[0], np.cumsum(~SPACES[raw])])
    keep = solid[ends] > solid[starts]
    return row[keep], number[keep], starts[keep], ends[keep]


def shingle_hashes(texts: bytes | np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles line after line, first index of each line): windows of ``size`` code points, or the line if shorter."""
    raw = np.frombuffer(texts, np.uint8) if isinstance(texts, bytes) else texts
    # code points: bytes that don't continue a character
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    a, b = at[starts], at[ends]
    windows = np.maximum(b - a - size + 1, 1)
    first = np.concatenate([[0], np.cumsum(windows)])
    place = np.arange(first[-1]) - np.repeat(first[:-1] - a, windows)
    power, inverse = C._powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=total[1:])
    # the windows of the whole text stand side by side; those of the lines are taken from them, and lines that are shorter come in between
    out = np.zeros(first[-1], np.uint64)
    if len(points) >= size:
        whole = (total[size:] - total[:-size]) * inverse[: len(points) - size + 1] ^ np.uint64(size)
        out = whole[np.minimum(place, len(whole) - 1)]
    short = np.flatnonzero(b - a < size)
    a, b = a[short], b[short]
    out[first[short]] = (total[b] - total[a]) * inverse[a] ^ (b - a).astype(np.uint64)
    return C.mix(out), first[:-1]


def band_keys(hashes: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(lines, bands) 64-bit bucket keys."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(first), b + 1, np.uint64)
        for r in range(rows):
            least = np.minimum.reduceat(low * MULTIPLIERS[b * rows + r], first)
            key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, b] = key
    return out


def _scan(bands: int, rows: int):
    """Rows of (line hash, document key, text hash, line number, count, band keys): lines of a batch, equal ones once."""

    def run(batches):
        for batch in batches:
            keys, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, raw, off in C.chunks(batch.column(2)):
                row, number, starts, ends = lines_of(raw, off)
                if not len(row):
                    continue
                h = C.span_hashes(raw, starts, ends)
                # keys of a batch aren't sorted: first place by key, then number
                own, mark = keys[a:b][row], marks[a:b][row]
                order = np.lexsort((number, mark, own, h))
                new = np.ones(len(order), bool)
                new[1:] = h[order][1:] != h[order][:-1]
                one = order[new]
                count = np.diff(np.append(np.flatnonzero(new), len(order)))
                by_place = np.argsort(starts[one], kind="stable")
                one, count = one[by_place], count[by_place]
                hashes, first = shingle_hashes(raw, starts[one], ends[one])
                packed = band_keys(hashes, first, bands, rows)
                flat = pa.Array.from_buffers(pa.binary(8 * bands), len(one), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(own[one]), pa.array(mark[one]), pa.array(number[one].astype(np.int32)), pa.array(count.astype(np.int64)), flat], names=["h", "k", "v", "ln", "n", "bands"])

    return run


def _explode(batches):
    """(bucket, line hash) of packed band keys."""
    for batch in batches:
        h = batch.column(0).to_numpy()
        raw, _ = C.buffer_of(batch.column(1))
        keys = raw.view(np.int64)
        if len(h):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(h, len(keys) // len(h)))], names=["cell", "node"])


def _places(wanted: C.Filter):
    """(line hash, document key, text hash, line number) of every line that may be wanted."""

    def run(batches):
        for batch in batches:
            keys, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, raw, off in C.chunks(batch.column(2)):
                row, number, starts, ends = lines_of(raw, off)
                h = C.span_hashes(raw, starts, ends)
                hit = np.flatnonzero(wanted(h))
                if len(hit):
                    row = row[hit]
                    yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array(keys[a:b][row]), pa.array(marks[a:b][row]), pa.array(number[hit].astype(np.int32))], names=["h", "k", "v", "ln"])

    return run


def _texts(wanted: C.Filter):
    """(line hash, text) of the lines of a batch that may be wanted, equal ones once."""

    def run(batches):
        for batch in batches:
            for _, _, raw, off in C.chunks(batch.column(0)):
                _, _, starts, ends = lines_of(raw, off)
                h = C.span_hashes(raw, starts, ends)
                hit = np.flatnonzero(wanted(h))
                if not len(hit):
                    continue
                _, one = np.unique(h[hit], return_index=True)
                one = np.sort(hit[one])
                sizes = ends[one] - starts[one]
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                spot = np.arange(offsets[-1]) + np.repeat(starts[one] - offsets[:-1], sizes)
                text = pa.Array.from_buffers(pa.string(), len(one), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw[spot].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), text], names=["h", "line"])

    return run


def linked(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges that connect all lines of Jaccard similarity of at least ``least``: sorted distinct shingles of each line in, pairs of indices out."""
    n = len(sets)
    if n == 2:
        a, b = sets
        both = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if both >= least * (len(a) + len(b) - both) else []
    size = np.array([len(s) for s in sets])
    rest = np.arange(n)
    edges: list[tuple[int, int]] = []
    flat, owner, there = np.concatenate(sets), np.repeat(np.arange(n), size), n
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            own = sets[p]
            spot = np.searchsorted(own, flat)
            same = own[np.minimum(spot, len(own) - 1)] == flat
            both = np.bincount(owner[same], minlength=n)[rest]
            hit = both >= least * (size[rest] + size[p] - both)
            if hit.any():
                found = rest[hit].tolist()
                edges += [(p, q) for q in found]
                queue += found
                rest = rest[~hit]
                if 2 * len(rest) < there:
                    left = np.zeros(n, bool)
                    left[rest] = True
                    stay = left[owner]
                    flat, owner, there = flat[stay], owner[stay], len(rest)
    return edges


def _verify(least: float):
    """Edges (a, b) of line hashes within each bucket; input sorted by bucket: (bucket, h, line)."""

    def edges_of(bucket: np.ndarray, h: np.ndarray, lines: pa.Array) -> pa.RecordBatch:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(bucket):
            raw, off = C.buffer_of(lines)
            hashes, first = shingle_hashes(raw, off[:-1], off[1:])
            # a line's number and 40 bits of the shingle's hash in one key: one plain sort makes every line's set
            low = np.uint64((1 << 40) - 1)
            owner = np.repeat(np.arange(len(h), dtype=np.uint64), np.diff(np.append(first, len(hashes))))
            keys = np.sort((owner << np.uint64(40)) | (hashes >> np.uint64(24)))
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
            owner, hashes = (keys >> np.uint64(40)).astype(np.int64), keys & low
            size = np.bincount(owner, minlength=len(h))
            start = np.concatenate([[0], np.cumsum(size)])
            cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            members = np.diff(cuts)
            # most buckets are pairs: one more sort finds what the two lines of every pair share
            two = cuts[:-1][members == 2]
            pair = np.full(len(h), -1)
            pair[two] = pair[two + 1] = np.arange(len(two))
            mine = pair[owner] >= 0
            keys = np.sort((pair[owner[mine]].astype(np.uint64) << np.uint64(40)) | hashes[mine])
            again = keys[1:][keys[1:] == keys[:-1]]
            both = np.bincount((again >> np.uint64(40)).astype(np.int64), minlength=len(two))
            near = two[both >= least * (size[two] + size[two + 1] - both)]
            left.append(h[near])
            right.append(h[near + 1])
            for s, n in zip(cuts[:-1][members > 2].tolist(), members[members > 2].tolist(), strict=True):
                found = np.array(linked([hashes[start[i] : start[i + 1]] for i in range(s, s + n)], least), np.int64).reshape(-1, 2)
                left.append(h[s + found[:, 0]])
                right.append(h[s + found[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    def pieces(table: pa.Table):
        """Edges of runs of whole buckets of about ``C.CHUNK_BYTES`` of text; a larger bucket comes alone."""
        bucket, h, lines = table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).combine_chunks()
        off = C.buffer_of(lines)[1]
        starts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        at = 0
        while at < len(starts) - 1:
            end = max(at + 1, int(np.searchsorted(off[starts], off[starts[at]] + C.CHUNK_BYTES, side="right")) - 1)
            a, b = starts[at], starts[end]
            yield edges_of(bucket[a:b], h[a:b], lines.slice(a, b - a))
            at = end

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(0).to_numpy()
            # the last bucket of a batch may go on in the next
            tail = int(np.searchsorted(keys, keys[-1]))
            if tail == 0 and (not kept or kept[0].column(0)[0].as_py() == keys[-1]):
                kept.append(batch)
                continue
            table = pa.Table.from_batches([*kept, batch.slice(0, tail)]).combine_chunks()
            if len(table):
                yield from pieces(table)
            kept = [batch.slice(tail)]
        if kept:
            table = pa.Table.from_batches(kept).combine_chunks()
            yield from pieces(table)

    return run


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(q_row, k, v, t): the row, its place key, a hash of its text, and the text.

    The key is the id where it is a whole number; null ids, and ids of other types, get a hash beyond 2^62, which is after all ids but those as great as that.
    """
    rows = C.wrapped(docs, k=id_column, t=text_column)
    mark = F.xxhash64("t")
    hashed = F.shiftrightunsigned(F.xxhash64(F.col("k").cast("string"), "t"), 2) + F.lit(1 << 62)
    whole = rows.schema["k"].dataType.typeName() in ("long", "integer", "short", "byte")
    return rows.select("q_row", (F.coalesce(F.col("k").cast("bigint"), hashed) if whole else hashed).alias("k"), mark.alias("v"), "t")


def duplicates(rows: DataFrame, least: float = JACCARD, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """(h, keep_k, keep_v, keep_ln) of every line that occurs more than once or has a fuzzy copy: where its component's kept line stands.

    ``rows``: columns k (bigint), v (bigint) and t.  Texts of lines are read again for candidates only: a filter of fixed size holds back nearly all others where they are,
    and the join with the buckets all of them.
    """
    C.settle(rows.sparkSession)
    scanned = rows.select("k", "v", "t").mapInArrow(C.lean(_scan(bands, band_rows), pieces=True), "h bigint, k bigint, v bigint, ln int, n bigint, bands binary")
    lines = C.cut(scanned.groupBy("h").agg(F.min(F.struct("k", "v", "ln")).alias("first"), F.sum("n").alias("n"), F.first("bands").alias("bands")), "lines")
    keys = lines.select("h", "bands").mapInArrow(C.lean(_explode), "cell bigint, node bigint").repartition("cell").sortWithinPartitions("cell")
    # buckets with the same members are one
    members = C.cut(keys.mapInArrow(C.lean(C.shared_cells), "bucket bigint, node bigint").distinct().select("bucket", F.col("node").alias("h")), "buckets")
    texts = rows.select("t").mapInArrow(C.lean(_texts(C.Filter(members)), pieces=True), "h bigint, line string").groupBy("h").agg(F.first("line").alias("line"))
    grouped = C.blocked(members).join(texts, "h").select("bucket", "h", "line").repartition("bucket").sortWithinPartitions("bucket", "h")
    edges = grouped.mapInArrow(C.lean(_verify(least), pieces=True), "a bigint, b bigint")
    roots = C.components(edges, "lines-cc")
    # lines that are alone keep themselves and need no entry
    tied = lines.select("h", "first", "n").join(roots, F.col("h") == F.col("node"), "left").where("n > 1 or root is not null").select("h", "first", F.coalesce("root", "h").alias("root"))
    kept = tied.groupBy("root").agg(F.min("first").alias("keep"))
    out = C.cut(tied.join(kept, "root").select("h", F.col("keep.k").alias("keep_k"), F.col("keep.v").alias("keep_v"), F.col("keep.ln").alias("keep_ln")), "line-decisions")
    C.discard(lines)
    C.discard(members)
    return out


def deletions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(k, v, gone): line numbers to delete of every document that loses lines."""
    places = rows.select("k", "v", "t").mapInArrow(C.lean(_places(C.Filter(decisions)), pieces=True), "h bigint, k bigint, v bigint, ln int")
    hit = places.join(decisions, "h").where("not (k = keep_k and v = keep_v and ln = keep_ln)")
    return hit.groupBy("k", "v").agg(F.collect_set("ln").alias("gone"))


def _cleaned(docs: DataFrame, id_column: str, text_column: str, least: float) -> tuple[DataFrame, str]:
    """((q_row, gone, q_lines) of every document, field of the text in q_row)."""
    rows = keyed(docs, id_column, text_column)
    gone = deletions(rows, duplicates(rows, least))
    # the text crosses once, inside the row
    return rows.select("q_row", "k", "v").join(gone, ["k", "v"], "left"), f"c{C.position(docs, text_column)}"


def _left(text, gone):
    lines = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(lines, "\n"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = JACCARD) -> DataFrame:
    """(id, text, n_removed) of every document, its text without the deleted lines."""
    joined, field = _cleaned(docs, id_column, text_column, least)
    text, own = F.col("q_row").getField(field), F.col("q_row").getField(f"c{C.position(docs, id_column)}")
    return joined.select(own.alias(id_column), _left(text, F.col("gone")).alias(text_column), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))


def without_duplicate_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = JACCARD, length_column: str | None = "n_chars") -> DataFrame:
    """The documents, all columns, without the deleted lines; those of which only white space is left go, and the length column follows the text."""
    joined, field = _cleaned(docs, id_column, text_column, least)
    joined = joined.withColumn("left", _left(F.col("q_row").getField(field), F.col("gone"))).where("gone is null or trim(BOTH ' \n\t\r' FROM left) <> ''")
    row = F.col("q_row").withField(field, F.col("left"))
    at = C.position(docs, length_column) if length_column else None
    if at is not None:
        kind = docs.schema[docs.columns[at]].dataType
        row = row.withField(f"c{at}", F.when(F.col("gone").isNull(), F.col("q_row").getField(f"c{at}")).otherwise(F.length("left").cast(kind)))
    return C.unwrapped(joined.select(row.alias("q_row")), docs)
