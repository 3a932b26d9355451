"""Nulls, empty tables, repeated rows, clashing names and hot groups of the operators, and plain versions of those that SQL can't express."""

import random
import re
import sys
from bisect import insort
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_text_ops import brute_lines  # noqa: E402

from quillmere.llm import linededup, mixing, packing, quality, simhash, surrogates

CLASH = "doc_id bigint, text string, source string, k string, t string, v string, s string, q_row string, TEXT string"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "k", None, "v", "s", "q", "T") for r in rows], CLASH)


# ------------------------------------------------------------------------------------------------ line dedup and near-dedup


def test_a_line_stays_in_one_of_two_texts_of_one_id(spark):
    rows = spark.createDataFrame([(1, "the same line of both texts\nfoo"), (1, "the same line of both texts\nbar"), (1, "the same line of both texts\nbar")], "doc_id bigint, text string")
    out = [(r["text"], r["n_removed"]) for r in linededup.dedup_lines(rows).collect()]
    # equal rows are one document: both keep it or both lose it
    assert len(out) == 3 and len({x for x in out if "bar" in x[0]}) == 1 and sum(n for _, n in out) in (1, 2)
    assert {("the same line" in t) for t, _ in out if "foo" in t} != {("the same line" in t) for t, _ in out if "bar" in t}


def test_line_dedup_of_nothing(spark):
    empty = clashing(spark, []).limit(0)
    assert linededup.without_duplicate_lines(empty).count() == 0 and linededup.without_duplicate_lines(empty).columns == empty.columns


def test_simhash_tells_texts_of_one_id_apart(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b = words(80), words(80)
    rows = clashing(spark, [(1, a, "x"), (1, b, "x"), (2, a, "y"), (None, b, None), ((1 << 62) + 5, words(50), "z")])
    out = simhash.near_duplicates(rows).collect()
    assert sorted((r["group_size"], r["keep"]) for r in out) == [(1, True), (2, False), (2, False), (2, True), (2, True)]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == [(False, 1), (False, 1), (False, 2), (False, (1 << 62) + 5), (True, 0)]
    assert simhash.without_near_duplicates(rows).count() == 3


def test_simhash_finds_copies_with_many_words_changed():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts, planted = [], []
    for share in (0.05, 0.08, 0.1, 0.15):
        for _ in range(60):
            own = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 400))]
            copy = [rng.choice(vocabulary) if rng.random() < share else w for w in own]
            planted.append((share, len(texts), len(texts) + 1))
            texts += [" ".join(own), " ".join(copy)]
    full, views = simhash.sketches(pa.array(texts))
    found = [set() for _ in texts]
    for v in range(simhash.VIEWS):
        for c, i in zip(*(x.tolist() for x in simhash.cells(np.ascontiguousarray(views[:, v]), v)), strict=True):
            found[i].add(c)
    within = [(s, not found[a].isdisjoint(found[b])) for s, a, b in planted if np.bitwise_count(full[a] ^ full[b]).sum() <= simhash.DISTANCE]
    assert len(within) > 150
    for share in (0.05, 0.08, 0.1, 0.15):
        mine = [hit for s, hit in within if s == share]
        assert not mine or sum(mine) >= 0.9 * len(mine)


# ------------------------------------------------------------------------------------------------ mixing


def test_mixing_edges(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, None, None), (2, "", "y"), (3, "long " * 100_000, None)]
    docs = clashing(spark, rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 1, 2, 3]


def brute_mix(counts, weights, size):
    """(source, block) in the order of slots: of all blocks released by a slot, the one of earliest deadline; by fractions."""
    from fractions import Fraction

    blocks = {s: -(-n // size) for s, n in counts.items()}
    done, out = dict.fromkeys(blocks, 0), []
    live = {s for s in blocks if blocks[s] and weights.get(s, 0) > 0}
    while live:
        total = sum(Fraction(str(weights[s])) for s in live)
        w = {s: Fraction(str(weights[s])) / total for s in live}
        own, t = dict.fromkeys(live, 0), 0
        while all(done[s] < blocks[s] for s in live):
            ready = [s for s in live if own[s] / w[s] // 1 <= t]
            s = min(ready, key=lambda s: (-(-(own[s] + 1) // w[s]), -w[s], str(s)))
            out.append((s, done[s]))
            own[s], done[s], t = own[s] + 1, done[s] + 1, t + 1
        live = {s for s in live if done[s] < blocks[s]}
    return out


@pytest.mark.parametrize("weights", [{"a": 1 / 3, "b": 0.41421356, "c": 0.2}, {"a": 0.00003, "b": 0.7, "c": 0.29997}])
def test_mix_against_plain_scheduling(spark, weights):
    counts = {"a": 300, "b": 170, "c": 90}
    rows = [(i, s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string")
    out = mixing.mix_documents(docs, weights=weights, block_docs=4).collect()
    slots = sorted({(r["slot"], r["source"], r["block"]) for r in out})
    assert [(s, b) for _, s, b in slots] == brute_mix(counts, weights, 4)
    assert all(n <= 4 for n in Counter(r["slot"] for r in out).values())


# ------------------------------------------------------------------------------------------------ packing


def best_fit(sizes, capacity):
    """Sizes of the groups of every bin, group by group."""
    rooms, bins = [], []
    for s in sorted((s for s in sizes if s > 0), reverse=True):
        at = next((i for i, (room, _) in enumerate(rooms) if room >= s), None) if s <= capacity else None
        if at is None:
            bins.append([s])
            room, b = max(capacity - s, 0), len(bins) - 1
        else:
            room, b = rooms.pop(at)
            bins[b].append(s)
            room -= s
        if room:
            insort(rooms, (room, b))
    return bins


@pytest.mark.parametrize("rows_per_cell", [10, 50_000])
def test_packing_against_group_by_group(spark, rows_per_cell):
    rng = random.Random(rows_per_cell)
    # a third of all groups has one size, some are beyond the capacity
    groups = {f"g{i}": rng.choice([17, rng.randrange(1, 120), rng.randrange(1, 120)]) for i in range(900)} | {"big": 400, "none": 0}
    rows = [(g, s - s // 2) for g, s in groups.items()] + [(g, s // 2) for g, s in groups.items()] + [("none", None), (None, 30), (None, 31)]
    df = spark.createDataFrame(rows, "g string, s int")
    out = packing.pack(df, "g", "s", 150, rows_per_cell).collect()
    assert {r["g"]: r["size"] for r in out} == groups | {None: 61} and len(out) == len(groups) + 1
    bins = defaultdict(list)
    for r in out:
        if r["size"]:
            bins[r["shard"]].append(r["size"])
    want = best_fit([*groups.values(), 61], 150)
    # bins of equal room are interchangeable, so what they are filled to is what must agree
    assert sorted(map(sum, bins.values())) == sorted(map(sum, want))
    assert max(bins) == len(want) - 1 and all(sum(b) <= 150 or len(b) == 1 for b in bins.values())


def test_packing_edges(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, None, None), (2, "", "y"), (3, "b" * 300_000, None)]
    out = packing.shard_documents(clashing(spark, rows), capacity=1000).collect()
    assert sorted((r["doc_id"] or 0, r["group_size"]) for r in out) == [(0, 0), (1, 2), (1, 2), (2, 0), (3, 300_000)]
    with pytest.raises(ValueError):
        packing.shard_documents(clashing(spark, rows), capacity=0)


# ------------------------------------------------------------------------------------------------ quality


def test_fit_is_the_least_logistic_loss():
    rng = np.random.default_rng(4)
    good, bad = rng.normal(0.7, 1, (60, 4)), rng.normal(0, 1, (50, 4))
    model = quality.fit(good, bad, pairs=3000, ridge=1e-2, seed=3)
    # plain gradient descent over the same pairs
    both = np.concatenate([good, bad])
    scaled = lambda x: np.clip((x - both.mean(0)) / both.std(0), -8, 8)
    draw = np.random.default_rng(3)
    d = scaled(good)[draw.integers(0, 60, 3000)] - scaled(bad)[draw.integers(0, 50, 3000)]
    w = np.zeros(4)
    for _ in range(20_000):
        w += 0.5 * ((1 / (1 + np.exp(d @ w)))[:, None] * d).mean(0) - 0.5 * 1e-2 * w
    assert np.allclose(model.weights, w, atol=1e-3)


def test_threshold_is_the_quantile_of_the_good(spark):
    docs = clashing(spark, [(i, " ".join(["word", "others"][: 1 + i % 2] * (i + 1)) + "!" * (i % 7), "s") for i in range(120)] + [(None, "x", None), (7, None, None)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 120)], "doc_id bigint, quality int, toxic int")
    out = quality.score_documents(docs, labels, quantile=0.25).collect()
    good = sorted(r["score"] for r in out if r["doc_id"] is not None and r["doc_id"] % 3 > 0)
    limit = out[0]["threshold"]
    assert abs(sum(s < limit for s in good) - 0.25 * len(good)) <= 1 and limit in good
    assert all(r["keep"] == (r["score"] >= limit) for r in out) and len(out) == 122
    kept = quality.keep_quality(docs, labels, quantile=0.25)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in out if r["keep"])
    assert kept.columns == docs.columns and quality.keep_quality(docs.limit(0), labels).count() == 0


# ------------------------------------------------------------------------------------------------ surrogates


def test_one_person_one_surrogate(spark):
    texts = ["Mrs Anna Lee. Dr Anna Lee. Anna Lee. ANNA and Lee.", "Prof. Anna Schmidt", "Mr Karl Lee and my name is Karl Lee", "Anna Lee without any word that tells a name", "Mrs Sam Fox", "Mr Sam Fox, Sam said", "Dear Ivo Roth, from Ivo"]
    got = [r["text"] for r in surrogates.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    m = re.fullmatch(r"Mrs (\w+) (\w+)\. Dr (\w+) (\w+)\. (\w+) (\w+)\. (\w+) and (\w+)\.", got[0])
    given, family = m[1], m[2]
    assert m.groups() == (given, family, given, family, given, family, "ANNA", family)
    assert re.fullmatch(rf"Prof\. {given} (?!{family})\w+", got[1])  # a given name is the same in every document
    assert given.endswith(tuple(surrogates.ENDINGS["latin", "given", "f"]))
    k = re.fullmatch(rf"Mr (\w+) {family} and my name is (\w+) {family}", got[2])
    assert k[1] == k[2] and k[1].endswith(tuple(surrogates.ENDINGS["latin", "given", "m"]))
    assert got[3] == texts[3]
    s = re.fullmatch(r"Mr (\w+) (\w+), (\w+) said", got[5])
    assert got[4] == f"Mrs {s[1]} {s[2]}" and s[3] == s[1] and s[1].endswith(tuple(surrogates.ENDINGS["latin", "given", "u"]))
    assert re.fullmatch(r"Dear (\w+) \w+, from \1", got[6])


def test_surrogates_of_many_names_are_distinct_and_no_real_names(spark):
    rng = random.Random(8)
    made = lambda: "".join(rng.choice(surrogates.SYLLABLES["latin"]) for _ in range(2))
    # given and family names that look like surrogates, so that many collide
    given = sorted({(made() + rng.choice(["na", "n", "ri"])).capitalize() for _ in range(1500)})
    family = sorted({(made() + rng.choice(["ler", "na", "ton"])).capitalize() for _ in range(1500)})
    rows = [(i, f"{rng.choice(['Mr', 'Mrs', 'Dr'])} {given[i % len(given)]} {family[i % len(family)]}") for i in range(1500)]
    out = {r["doc_id"]: r["text"].split(" ") for r in surrogates.replace(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    image, owner = {}, {}
    for i, t in rows:
        for a, b in zip(t.split(" ")[1:], out[i][1:], strict=True):
            image.setdefault(a, set()).add(b)
            assert owner.setdefault(b, a) == a  # no two names share one
    assert sum(len(x) > 2 for x in image.values()) == 0  # a name as a given and as a family name
    assert not set(owner) & set(image)


def brute_replace(texts, key):
    """Every text rewritten with attempts found one entity after the other, in plain Python."""
    f = surrogates.Feistel(key)
    found, gender = set(), defaultdict(set)
    for t in texts:
        for kind, value, g in surrogates._found(t or ""):
            found.add((kind, value))
            if g != "u":
                gender[kind, value].add(g)
    told = {e: next(iter(gender[e])) if len(gender[e]) == 1 else "u" for e in found}
    space = lambda kind: "name" if kind.startswith(("given", "family")) else kind
    real = {(space(k), v) for k, v in found}
    attempt = dict.fromkeys(found, 0)
    while True:
        owner = {}
        for k, v in sorted(found, key=lambda e: (e[1], e[0])):
            owner.setdefault((space(k), surrogates.surrogate(f, k, v, attempt[k, v], told[k, v])), (v, k))
        again = [(k, v) for k, v in found for s in [surrogates.surrogate(f, k, v, attempt[k, v], told[k, v])] if owner[space(k), s] != (v, k) or (space(k), s) in real]
        if not again:
            break
        for e in again:
            attempt[e] += 1
    return [None if t is None else surrogates.rewrite(t, f, {e: (attempt[e], told[e]) for e in found}) for t in texts]


def test_surrogates_against_plain_python(spark):
    rng = random.Random(6)
    names = ["Ba", "Bebo", "Coda", "Anna", "Elna", "Dobery", "Fago", "Gaha"]
    piece = [lambda: f"{rng.choice(['Mr', 'Mrs', 'Dr'])} {rng.choice(names)} {rng.choice(names)}", lambda: f"{rng.choice('abc')}@{rng.choice('xyz')}.org", lambda: f"10.0.0.{rng.randrange(4)}", lambda: f"{rng.choice(names)} alone", lambda: f"{rng.randrange(100, 103)}-{rng.randrange(10, 12)}-1234"]
    texts = [" and ".join(rng.choice(piece)() for _ in range(rng.randrange(6))) for _ in range(150)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for more in ({}, {"broadcast_rows": -1}):
        got = {r["doc_id"]: (r["text"], r["n_entities"]) for r in surrogates.replace(rows, **more).collect()}
        assert [got[i] for i in range(len(texts))] == [x or (None, 0) for x in brute_replace(texts, surrogates.KEY)]


def test_long_numbers_are_cards_by_their_check_digit():
    rng, f = random.Random(1), surrogates.Feistel(b"k")
    for _ in range(200):
        n = "".join(rng.choice("0123456789") for _ in range(16))
        text, count = surrogates.rewrite(f"no {n} here", f, {})
        assert count == surrogates.luhn(n) and (text == f"no {n} here") == (not count)
        assert not count or surrogates.luhn(text.split(" ")[1])


def test_surrogate_edges(spark):
    long = "no entity here " * 50_000 + "Mrs Anna Lee, 10.20.30.40"
    docs = clashing(spark, [(None, "Mr Lee", "s"), (1, long, "s"), (1, long, "s"), (2, None, None), (3, "", "s")])
    out = surrogates.replace(docs).collect()
    assert len(out) == 5 and len({r["text"] for r in out if r["doc_id"] == 1}) == 1
    assert all(len(r["text"]) > 700_000 and "Anna" not in r["text"] and r["n_entities"] == 2 for r in out if r["doc_id"] == 1)
    assert [r["n_entities"] for r in out if r["doc_id"] is None] == [1]
    assert surrogates.replace(docs.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------ the pipeline


def stages(spark, docs, folder):
    import corpus_pipeline as P

    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = out
    return P.STAGES[-1][1](spark, docs, folder)


def test_pipeline_on_an_empty_table_and_on_odd_rows(spark, sf):
    start = spark.read.parquet(f"{sf}/documents.parquet")
    assert stages(spark, start.limit(0), sf).count() == 0
    more = start.selectExpr("*", "nullif('k', '') AS k", "nullif('t', '') AS t", "CAST(NULL AS string) AS q_row", "nullif('S', '') AS slot")
    odd = spark.createDataFrame([(None, "a text of some words without an id, as long as it needs to be kept", "en", None, 67, "k", "t", None, "S"), (1 << 40, None, None, "x", None, None, None, None, None), (1 << 41, "", "en", "x", 0, None, None, None, None)], more.schema)
    out = stages(spark, more.limit(30).unionByName(odd).unionByName(odd), sf).collect()
    assert out and all(r["round_trip"] in (True, None) for r in out)
    assert sorted(r["position"] for r in out) == list(range(len(out)))


def test_pipeline_against_plain_python(spark, sf, tmp_path):
    """Scores by numpy, lines by all pairs, near copies by all fingerprints, slots by fractions, tokens by a public library."""
    import tiktoken

    import corpus_pipeline as P
    from quillmere.llm import bpe
    from quillmere.llm.common import UnionFind

    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    source = {r["doc_id"]: r["source"] for r in rows}
    rng, fresh = random.Random(2), max(texts) + 1
    for d in sorted(texts)[:12]:  # near copies whose lines are too different for line dedup, in one line
        words = texts[d].replace("\n", " ").split(" ")
        if len(words) > 60:
            texts[fresh], source[fresh] = " ".join(w + "x" if rng.random() < 0.08 else w for w in words), "copies"
            fresh += 1
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(d, t, "en", source[d], len(t)) for d, t in texts.items()], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(d, int(i % 4 > 0), 0) for i, d in enumerate(sorted(texts))], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    # quality
    x = {d: quality.features(pa.array([t]))[0] for d, t in texts.items()}
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    both = [(label[d], x[d]) for d in texts]
    feats, ys = np.array([f for _, f in both]), np.array([y for y, _ in both])
    order = np.lexsort((*feats.T[:8], ys))
    feats, ys = feats[order], ys[order]
    model = quality.fit(feats[ys > 0], feats[ys <= 0])
    score = {d: float(model.score(x[d][None])[0]) for d in texts}
    good = sorted(score[d] for d in texts if label[d])
    kept = {d: t for d, t in texts.items() if score[d] >= good[0]}
    # lines: all pairs by exact Jaccard
    lines, first, pairs = brute_lines(kept)
    tree = UnionFind(len(lines))
    for a, b in pairs:
        tree.join(a, b)
    at = {line: i for i, line in enumerate(lines)}
    best = {}
    for i, line in enumerate(lines):
        r = tree.find(i)
        best[r] = min(best.get(r, first[line]), first[line])
    left = {}
    for d, t in kept.items():
        out = [line for n, line in enumerate(t.split("\n")) if line not in at or best[tree.find(at[line])] == (d, n)]
        if "\n".join(out) == t or "".join(out).strip(" \n\t\r"):
            left[d] = "\n".join(out)
    # near copies: all fingerprints
    ids = sorted(left)
    full, _ = simhash.sketches(pa.array([left[d] for d in ids]))
    tree = UnionFind(len(ids))
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if np.bitwise_count(full[a] ^ full[b]).sum() <= simhash.DISTANCE:
                tree.join(a, b)
    one = [d for i, d in enumerate(ids) if tree.find(i) == i]
    assert len(texts) > len(kept) - 1 and len(one) < len(ids)
    assert set(got) == set(one)
    # the mix: sources in the order of slots
    counts = Counter(source[d] for d in one)
    sequence = [s for s, j in brute_mix(counts, mixing.tempered(counts), mixing.BLOCK_DOCS) for _ in range(min(mixing.BLOCK_DOCS, counts[s] - j * mixing.BLOCK_DOCS))]
    assert [source[d] for d in sorted(got, key=lambda d: got[d]["position"])] == sequence
    # tokens
    plain = tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})
    assert all(list(got[d]["tokens"]) == plain.encode_ordinary(left[d]) for d in one)
