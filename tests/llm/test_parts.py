"""Parts that keep hot groups out of one task, against plain versions: cells, blocks of buckets, filters, ranks, and tables in between."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillmere.llm import common as C


@pytest.mark.parametrize("size", [1, 3, 17, 1000])
@pytest.mark.parametrize("most", [5, 1 << 20])
def test_cells_in_any_batches(monkeypatch, size, most):
    monkeypatch.setattr(C, "CELL_NODES", most)
    rng = random.Random(size)
    rows = sorted((rng.choice([0, 0, 0, rng.randrange(-40, 40)]), rng.randrange(60)) for _ in range(400))
    cell, node = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    batches = [pa.RecordBatch.from_arrays([pa.array(cell[i : i + size]), pa.array(node[i : i + size])], names=["cell", "node"]) for i in range(0, len(rows), size)]
    got = defaultdict(set)
    for b in C.shared_cells(iter(batches)):
        for bucket, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got[bucket].add(n)
    want = defaultdict(set)
    for c, n in rows:
        want[c].add(n)
    # cells of equal members are one bucket, but for those that are passed on as they come
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_every_two_members_of_a_bucket_meet_in_a_small_one(spark):
    sizes = {1: 2, 2: 9, 3: 40, 4: 100}
    rows = [(b, b * 1000 + i) for b, n in sizes.items() for i in range(n)]
    out = C.blocked(spark.createDataFrame(rows, "bucket bigint, h bigint"), most=10).collect()
    met, members = set(), defaultdict(list)
    for r in out:
        members[r["bucket"]].append(r["h"])
    for hs in members.values():
        met |= {(a, b) for a in hs for b in hs}
    assert all((b * 1000 + i, b * 1000 + j) in met for b, n in sizes.items() for i in range(n) for j in range(n))
    assert {1, 2} <= members.keys() and not {3, 4} & members.keys()
    assert max(map(len, members.values())) < 60  # two blocks of ten or so, not a hundred


def test_a_filter_holds_none_back(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    keep = C.Filter(spark.createDataFrame([(int(x),) for x in h], "h bigint"))
    assert keep(h.view(np.uint64)).all()
    assert keep(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 0.01
    assert not C.Filter(spark.createDataFrame([], "h bigint"))(h.view(np.uint64)).any() and C.Filter(spark.createDataFrame([(1,)], "h bigint"))(np.zeros(0, np.uint64)).shape == (0,)


@pytest.mark.parametrize("rows_per_cell", [7, 50_000])
def test_ranks_are_dense_within_every_key(spark, rows_per_cell):
    rows = [("a", i) for i in range(100)] + [("b", i % 3) for i in range(40)] + [(None, i) for i in range(20)] + [("c", 1)]
    df = spark.createDataFrame(rows, "s string, k bigint")
    out = defaultdict(list)
    for r in C.spread_rank(df, "s", ["k"], {"a": 100, "b": 40, None: 20, "c": 1}, rows_per_cell).collect():
        out[r["s"]].append(r["q_rank"])
    assert {s: sorted(x) for s, x in out.items()} == {"a": list(range(100)), "b": list(range(40)), None: list(range(20)), "c": [0]}


def test_tables_in_between_go_at_the_end_of_a_scope(spark):
    with C.scope():
        gone = C.cut(spark.range(3).toDF("x"), "scoped")
        kept = C.cut(gone.selectExpr("x + 1 AS x"), "kept", keep=True)
    assert sorted(r["x"] for r in kept.collect()) == [1, 2, 3]
    fs = spark._jvm.org.apache.hadoop.fs.Path(kept.inputFiles()[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    assert not any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f)) for f in gone.inputFiles())
    C.discard(kept)


# ------------------------------------------------------------------------------------------------ near-dedup


def near_prints(rng, n, most):
    """(a, b) random fingerprints; of every third row of ``a`` a copy with up to ``most`` + 3 bits flipped is in ``b``."""
    a, b = rng.integers(0, 1 << 64, (n, 2), dtype=np.uint64), rng.integers(0, 1 << 64, (n, 2), dtype=np.uint64)
    for i in range(0, n, 3):
        bits = np.zeros(128, np.uint8)
        bits[rng.choice(128, rng.integers(0, most + 4), replace=False)] = 1
        b[n - 1 - i] = a[i] ^ np.packbits(bits, bitorder="little").view(np.uint64)
    return a, b


@pytest.mark.parametrize("most", [0, 1, 5, 11, 26])
def test_parts_lose_no_pair(monkeypatch, most):
    from quillmere.llm import simhash

    for width in range(3, 17):
        parts = simhash.parts_of(width, most)
        assert sum(r + 1 for *_, r in parts) == most + 1 and all(0 < w <= width for _, _, w, _ in parts)
        assert len({(word, bit) for word, shift, w, _ in parts for bit in range(shift, shift + w)}) == sum(w for _, _, w, _ in parts)
    monkeypatch.setattr(simhash, "DENSE", 100)
    a, b = near_prints(np.random.default_rng(most), 1500, most)
    want = {(x, y) for x, y in zip(*(v.tolist() for v in np.nonzero(np.bitwise_count(a[:, None] ^ b[None]).sum(2) <= most)), strict=True)}
    got = {p for x, y in simhash.within(a, b, most) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert want and got == want


def test_ties_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    from quillmere.llm import simhash

    monkeypatch.setattr(simhash, "BLOCK_LEAST", 100)
    a, b = near_prints(np.random.default_rng(4), 400, 26)
    prints = np.concatenate([a, b])
    root = [i // 2 for i in range(len(prints))]  # a tie within a root is none
    known = spark.createDataFrame([(i, root[i], *p) for i, p in enumerate(prints.view(np.int64).tolist())], "h bigint, root bigint, f0 bigint, f1 bigint")
    want = {(min(root[x], root[y]), max(root[x], root[y])) for x, y in zip(*(v.tolist() for v in np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]).sum(2) <= 26)), strict=True) if root[x] != root[y]}
    assert want and {(r["a"], r["b"]) for r in simhash.ties(known, 26).collect()} == want


def test_near_duplicates_without_a_near_view_are_found(spark):
    from quillmere.llm import simhash

    rng, texts, lost = np.random.default_rng(8), [], []
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]
    while len(lost) < 5:  # copies with a fifth of their words replaced that are near, though no view is
        own = [vocabulary[i] for i in rng.integers(0, 3000, rng.integers(80, 400))]
        copy = [vocabulary[rng.integers(0, 3000)] if rng.random() < 0.2 else w for w in own]
        full, views = simhash.sketches(pa.array([" ".join(own), " ".join(copy)]))
        if np.bitwise_count(full[0] ^ full[1]).sum() > simhash.DISTANCE:
            continue
        cells = [[set(simhash.cells(views[i : i + 1, v].copy(), v)[0].tolist()) for v in range(simhash.VIEWS)] for i in (0, 1)]
        if all(x.isdisjoint(y) for x, y in zip(*cells, strict=True)):
            lost.append((len(texts), len(texts) + 1))
            texts += [" ".join(own), " ".join(copy)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    group = {r["doc_id"]: r["group"] for r in simhash.near_duplicates(rows).collect()}
    assert all(group[x] == group[y] for x, y in lost)
    assert len(set(group.values())) == len(lost)
