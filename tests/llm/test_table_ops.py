"""Mixing, packing, page differencing, surrogates, media and the pipeline against brute force, and their edge cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillmere.llm import common as C
from quillmere.llm import media, mixing, packing, pagediff, surrogates


# ------------------------------------------------------------------------------------------------ mixing


def test_mix_keeps_within_a_block_of_the_target(spark):
    rows = [(i, s) for s, n in (("a", 900), ("b", 300), (None, 120), ("c", 30)) for i in range(n)]
    docs = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows)], "doc_id bigint, source string")
    weights = {"a": 0.5, "b": 0.3, None: 0.15, "c": 0.05}
    out = mixing.mix_documents(docs, weights=weights, block_docs=2, resolution=100).collect()
    assert len(out) == len(rows) and len({r["doc_id"] for r in out}) == len(rows)
    slots = sorted({(r["slot"], r["source"], r["block"]) for r in out}, key=lambda x: x[0])
    assert [s[0] for s in slots] == list(range(len(slots)))  # every slot holds one block
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    seen = Counter()
    first = [r for r in out if r["phase"] == 0]
    last = max(r["slot"] for r in first)
    for t, s, _ in slots:
        if t > last:
            break
        seen[s] += 1
        assert all(abs(seen[x] - w * (t + 1)) < 1 for x, w in weights.items())


def within_a_block(rows, weights):
    """Dealt blocks of every source against its exact target, after every slot of the first phase. rows: (phase, slot, source)."""
    from fractions import Fraction

    total = sum(Fraction(w) for w in weights.values())
    target = {s: Fraction(w) / total for s, w in weights.items()}
    seen = Counter()
    first = sorted((r for r in rows if r[0] == 0), key=lambda r: r[1])
    for t, (_, slot, s) in enumerate(first):
        assert slot == t
        seen[s] += 1
        # the one just dealt is furthest ahead, all others are checked now and then
        assert seen[s] - target[s] * (t + 1) < 1
        if t % 997 == 0 or t + 1 == len(first):
            assert all(abs(seen[x] - w * (t + 1)) < 1 for x, w in target.items())
    return len(first)


def test_weights_are_not_rounded():
    # twenty sources, one hot; the first phase has hundreds of thousands of slots
    counts = {"hot": 2_000_000} | {f"s{i:02}": 200_000 + 7_477 * i for i in range(19)}
    weights = mixing.tempered(counts)
    blocks = {s: -(-n // 16) for s, n in counts.items()}
    rows = [(phase, slot, s) for s, _, phase, slot, release, deadline in mixing.dealt(blocks, weights) if release <= slot < deadline]
    assert len(rows) == sum(blocks.values())
    assert within_a_block(rows, weights) > 300_000
    # weights far under a tick of 1/10,000
    tiny = {"a": 1, "b": 1e-7, "c": 3e-7}
    rows = [(phase, slot, s) for s, _, phase, slot, _, _ in mixing.dealt({"a": 50_000, "b": 900, "c": 900}, tiny)]
    assert within_a_block(rows, tiny) >= 50_000


def test_mix_of_weights_that_are_no_multiples(spark):
    sizes = {"a": 24_000, "b": 9_000, None: 5_000}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id bigint, source string")
    weights = {"a": 2 / 3, "b": 1 / 4 + 1e-3 / 7, None: 1 / 12 - 1e-3 / 7}
    out = mixing.mix_documents(docs, weights=weights, block_docs=1, resolution=100).collect()
    assert len(out) == sum(sizes.values()) and sorted(r["slot"] for r in out) == list(range(len(out)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    assert within_a_block([(r["phase"], r["slot"], r["source"]) for r in out], weights) > 30_000


def test_mix_edges(spark):
    assert mixing.mix_documents(spark.createDataFrame([], "doc_id bigint, source string")).count() == 0
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "b", "y"), (3, "zero", "z")], "doc_id bigint, source string, q_rank string")
    assert mixing.mix_documents(docs).count() == 4
    out = mixing.mix_documents(docs, weights={"b": 1.0}, block_docs=1).collect()
    assert [r["source"] for r in sorted(out, key=lambda r: r["slot"])][0] == "b" and len(out) == 4
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == 4


# ------------------------------------------------------------------------------------------------ packing


def best_fit_decreasing(sizes, capacity):
    """Group by group: the packing that the operator must have."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if s == 0:
            room = room or [capacity]
        elif fits and s <= capacity:
            room[min(fits)[1]] -= s
        else:
            room.append(max(capacity - s, 0))
    return room


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_group_by_group(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    sizes = [rng.randrange(1, rng.choice([5, 40, 130])) for _ in range(rng.randrange(1, 300))]
    runs, bins = packing.plan(list(Counter(sizes).items()), capacity)
    load, placed = Counter(), Counter()
    for size, lo, hi, first, each in runs:
        for p in range(lo, hi):
            load[first + (p - lo) // each] += size
            placed[size] += 1
    assert placed == Counter(sizes)
    assert all(x <= capacity or x in sizes for x in load.values())
    assert sorted(max(capacity - load[b], 0) for b in range(bins)) == sorted(best_fit_decreasing(sizes, capacity))


def test_packing_edges(spark):
    assert packing.shard_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a" * 60, 1), (2, "a" * 60, 1), (3, "b" * 50, 1), (4, None, 1), (5, "", 1), (None, "c" * 30, 1), (7, "d" * 500, 1)], "doc_id bigint, text string, size int")
    out = {r["doc_id"]: r for r in packing.shard_documents(docs, capacity=150).collect()}
    assert out[1]["shard"] == out[2]["shard"] and out[1]["group_size"] == 120
    assert out[None]["shard"] == out[1]["shard"]  # 30 is the tightest fit into what 120 leaves
    assert [r for r in out.values() if r["shard"] == out[7]["shard"]] == [out[7]] or out[7]["shard"] == 0
    assert out[4]["shard"] == out[5]["shard"] == 0


# ------------------------------------------------------------------------------------------------ page differencing


def brute_pages(rows):
    """Nearest path of the host by longest shared prefix (of equals the one before), LCS by the textbook table."""
    import re
    from urllib.parse import urlsplit

    def place(url):
        if url is None or "://" not in url:
            return None
        u = urlsplit(url)
        return u.netloc.lower(), re.sub(r"(/|/index\.html?|\.html?)+$", "", u.path)

    version = {}
    for k, url, html in rows:
        if place(url):
            version[place(url)] = min(version.get(place(url), (k, html)), (k, html))
    out = {}
    for k, url, html in rows:
        lines = pagediff.lines_of(html) if html else []
        own, best = place(url), None
        if own:
            others = sorted(p for h, p in version if h == own[0] and p != own[1])
            if others:
                most = max(pagediff.prefix(own[1], p) for p in others)
                near = [p for p in others if pagediff.prefix(own[1], p) == most]
                before = [p for p in near if p < own[1]]
                best = before[-1] if before else near[0]
        other = pagediff.lines_of(version[own[0], best][1] or "") if best is not None else []
        n, m = len(lines), len(other)
        table = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m):
                table[i + 1, j + 1] = table[i, j] + 1 if lines[i] == other[j] else max(table[i, j + 1], table[i + 1, j])
        out[k] = (version[own[0], best][0] if best is not None else None, n, int(table[n, m]), lines, other)
    return out


def is_subsequence(a, b):
    it = iter(b)
    return all(x in it for x in a)


def test_pages_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    want = brute_pages(rows)
    got = {r["page_id"]: r for r in pagediff.extract(pages).collect()}
    assert got.keys() == want.keys()
    for k, (partner, n, shared, lines, other) in want.items():
        assert (got[k]["partner"], got[k]["n_lines"], got[k]["n_shared"]) == (partner, n, shared)
        left = got[k]["text"].split("\n") if got[k]["text"] else []
        assert is_subsequence(left, lines) and len(left) == n - shared
        assert is_subsequence(list((Counter(lines) - Counter(left)).elements()), sorted(lines)) and Counter(lines) - Counter(left) <= Counter(other)


def test_page_edges(spark):
    page = "<html><body><div>menu</div><p>{}</p><script>no</script></body></html>"
    rows = [(1, "http://h/a/1", page.format("one"), "x"), (2, "http://h/a/2.html", page.format("two"), "x"), (2, "http://h/a/2.html", page.format("two"), "x"), (3, None, page.format("x"), "x"), (4, "http://alone/", page.format("y"), "x"), (None, "http://h/a/3", None, "x"), (6, "not a url", "", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = defaultdict(list)
    for r in pagediff.extract(df).collect():
        got[r["page_id"]].append(r)
    assert got[1][0]["text"] == "one" and [r["text"] for r in got[2]] == ["two", "two"]
    assert got[3][0]["text"] == "menu\nx" and got[4][0]["partner"] is None and got[None][0]["n_lines"] == 0 and got[6][0]["n_lines"] == 0
    assert pagediff.extract(df.limit(0)).count() == 0


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(25))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        # rows that are made again give the very same lines
        assert pagediff.shared(a, b, 1) == pagediff.shared(a, b, 40) == pagediff.shared(a, b)
        for bits in (1, 1 << 28):
            hit = pagediff.shared(a, b, bits)
            assert len(hit) == table[-1][-1] and hit == sorted(set(hit)) and is_subsequence([a[i] for i in hit], b)


# ------------------------------------------------------------------------------------------------ surrogates


def replaced(spark, texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: (r["text"], r["n_entities"]) for r in surrogates.replace(rows, **more).collect()}


def test_surrogates_keep_form_and_coreference(spark):
    texts = [
        "Write to Anna.Lee@mail.example.com or anna.lee@mail.example.com, card 4539 1488 0343 6467, ip 10.20.30.40.",
        "Mrs Anna Lee met Mr Lee. Госпожа Анна Иванова. ssn 123-45-6789, +49 170 1234567",
        "IBAN DE89 3704 0044 0532 0130 00 and key=ABCDEFGHIJKLMNOP1234",
        None,
        "",
    ]
    got = replaced(spark, texts)
    import re

    mails = re.findall(r"\S+@\S+\.com", got[0][0])
    assert mails[0].lower() == mails[1].lower() and mails[0] != mails[1] and "anna" not in got[0][0].lower()
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4})", got[0][0]).group(1)
    assert card != "4539 1488 0343 6467" and surrogates.luhn(card.replace(" ", ""))
    family = re.search(r"Mrs \w+ (\w+) met Mr (\w+)\.", got[1][0])
    assert family.group(1) == family.group(2) != "Lee"
    assert re.search("Госпожа [А-Яа-яё]+ [А-Яа-яё]+", got[1][0]) and "Анна" not in got[1][0]
    iban = re.search(r"IBAN (DE[0-9 ]+\d)", got[2][0]).group(1)
    assert iban != "DE89 3704 0044 0532 0130 00" and surrogates.mod97(iban.replace(" ", "")) == 1
    assert "ABCDEFGHIJKLMNOP1234" not in got[2][0] and got[3][0] is None and got[4] == ("", 0)
    assert replaced(spark, texts) == got and replaced(spark, texts, key=b"another")[0] != got[0]
    assert replaced(spark, texts, broadcast_rows=-1) == got  # the way without a broadcast


def test_surrogates_are_distinct_and_not_real(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in surrogates.replace(docs).collect()}
    real = defaultdict(set)
    image: dict = {}
    for d, t in before.items():
        old = surrogates.scan(t)[0]
        if not old:
            assert after[d] == t
            continue
        for _, _, values, _ in old:
            for k, v in values:
                real[k].add(v)
    odd = {(r["kind"], r["value"]): (r["attempt"], r["gender"]) for r in surrogates.exceptions(docs.selectExpr("text AS t"), surrogates.KEY).collect()}
    f = surrogates.Feistel(surrogates.KEY)
    for k, vs in real.items():
        for v in vs:
            s = surrogates.surrogate(f, k, v, *odd.get((k, v), (0, "u")))
            assert s not in vs and image.setdefault((k, s), v) == v
    assert sum(map(len, real.values())) > 0
    assert not any(v in after[d] for d, t in before.items() for _, _, values, _ in surrogates.scan(t)[0] for k, v in values if k in ("ssn", "card", "secret") and len(v) > 8)


def test_permutation_of_small_domains():
    f = surrogates.Feistel(b"k")
    for bound in (1, 2, 10, 97):
        assert sorted(f.permute(x, bound, "t") for x in range(bound)) == list(range(bound))


# ------------------------------------------------------------------------------------------------ media


def test_thumbnails_are_block_means():
    rng = np.random.default_rng(0)
    pictures = [rng.integers(0, 256, (h, w)).astype(np.uint8) for h, w in ((8, 8), (40, 24), (17, 9), (64, 128))]
    for p, data, row in zip(pictures, media.encode_grey(pictures), media.decode_all(media.encode_grey(pictures)), strict=True):
        assert row[:4] == ("ok", p.shape[1], p.shape[0], 1)
        frame = media.parse(data)
        sizes = np.array([lane.blocks for lane in frame.lanes])
        padded = np.pad(p, ((0, -p.shape[0] % 8), (0, -p.shape[1] % 8)), mode="edge").astype(float)
        means = padded.reshape(padded.shape[0] // 8, 8, -1, 8).mean((1, 3))
        got, bad = media.decode_lanes(frame.lanes, sizes)
        assert row[4:6] == (means.shape[1], means.shape[0])
        dc = np.concatenate([np.asarray(x) for x in got])
        seen = media.thumbnail(frame, dc)
        assert np.abs(seen.astype(float) - means).max() <= 40 / 16 + 1.5  # half a quantiser step of the DC coefficient, and rounding


def test_media_statuses(spark):
    good = media.encode_grey([np.full((16, 16), 99, np.uint8)])[0]
    rows = [(1, bytearray(good)), (1, bytearray(good)), (2, None), (3, bytearray()), (4, bytearray(b"GIF89a")), (5, bytearray(good[: len(good) // 2])), (None, bytearray(good.replace(b"\xff\xc0", b"\xff\xc2", 1)))]
    out = [(r["id"], r["status"]) for r in media.read_images(spark.createDataFrame(rows, "id bigint, image binary"), "id").collect()]
    assert Counter(out) == Counter([(1, "ok"), (1, "ok"), (2, "null"), (3, "empty"), (4, "not_jpeg"), (5, "truncated"), (None, "unsupported")])


def test_page_media(spark, sf):
    out = media.page_media(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert out and {r["status"] for r in out} == {"ok"}
    empty = spark.createDataFrame([(1, None), (2, "")], "page_id bigint, html string")
    assert {r["page_id"]: r["status"] for r in media.page_media(empty).collect()} == {1: "null", 2: "ok"}
    assert media.page_media(empty.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------ shared parts and the pipeline


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    tree = C.UnionFind(1100)
    for a, b in edges:
        tree.join(a, b)
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: tree.find(n) for e in edges if e[0] != e[1] for n in e}


def test_pipeline(spark, sf):
    import corpus_pipeline as P
    import pandas as pd

    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "tokens"]
    start = spark.read.parquet(f"{sf}/documents.parquet")
    docs, counts = start, []
    for _, stage in P.STAGES[:-1]:
        docs = C.cut(stage(spark, docs, sf), "test-stage")
        assert docs.dtypes == start.dtypes
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    out = P.run(spark, sf).toPandas()
    assert len(out) == counts[-1] and out.round_trip.all()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    good = set(labels[labels.quality == 1].doc_id)
    after = {r["doc_id"] for r in P.STAGES[0][1](spark, start, sf).select("doc_id").collect()}
    assert len(good & after) >= 0.97 * len(good)


def test_pipeline_keeps_the_mix(spark, sf):
    import corpus_pipeline as P

    out = P.run(spark, sf).select("doc_id", "position").collect()
    assert sorted(r["position"] for r in out) == list(range(len(out)))
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()}
    got = [source[r["doc_id"]] for r in sorted(out, key=lambda r: r["position"])]
    kept = spark.createDataFrame([(r["doc_id"], source[r["doc_id"]]) for r in out], "doc_id bigint, source string")
    want = sorted((r["slot"], str(r["source"])) for r in mixing.mix_documents(kept).collect())
    assert len(set(got)) > 1 and [str(s) for s in got] == [s for _, s in want]


def test_positions_survive_the_reread(spark):
    # the later a file, the longer it is: reading takes the longest first
    rows = spark.range(0, 4000, numPartitions=1).selectExpr("id", "repeat(cast(rand(1) as string), cast(id / 40 as int)) text")
    docs = C.cut(rows.repartitionByRange(8, "id").sortWithinPartitions("id"), "test-mix")
    out = mixing.positioned(docs)
    assert out.columns == ["id", "text", "position"]
    assert all(r["id"] == r["position"] for r in out.select("id", "position").collect())
    again = mixing.positioned(spark.range(50).sort("id", ascending=False))
    assert all(r["id"] + r["position"] == 49 for r in again.collect())
    assert mixing.positioned(docs.limit(0)).count() == 0


def test_small_tables_start_no_workers_of_their_own(spark):
    """Plain rows of the driver become an RDD of a Python function, which has a daemon and workers beside those of the operators."""
    docs = spark.createDataFrame(pa.table({"doc_id": [1, 2, 3], "source": ["a", "a", None], "text": ["x", "y", "z"]}))
    mix = mixing.mixed(docs)
    for df in (mix, mixing.positioned(C.cut(mix, "mix")), C.spread_rank(docs, "source", ["doc_id"], {"a": 2}, rows_per_cell=1)):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString() and df.count() == 3
    members = spark.createDataFrame(pa.table({"bucket": [7] * 9, "h": list(range(9))}))
    blocks = C.blocked(members, most=3)
    assert "ExistingRDD" not in blocks._jdf.queryExecution().toString() and blocks.select("h").distinct().count() == 9
    for rows, schema in (([("a", 1), (None, 2)], "k string, n bigint"), ([], "k string, n bigint"), ([(True, 3)], "k boolean, n int"), ([(1.5, 3)], "k double, n int")):
        out = C.local_table(spark, rows, schema)
        assert out.schema == spark.createDataFrame([], schema).schema and sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
