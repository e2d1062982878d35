import random

import numpy as np
import pytest
import xxhash

from docloom.llm import simhash
from docloom.llm.components import components
from docloom.llm.trie import link_within


def brute_fingerprint(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, codes, budget):
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, x in zip(ids, codes):
        for b, y in zip(ids, codes):
            if (x ^ y).bit_count() <= budget:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in ids}


def near(r, code, n):
    for k in r.sample(range(64), n):
        code ^= 1 << k
    return code


def test_trie_against_all_pairs():
    r = random.Random(1)
    codes = [r.getrandbits(64) for _ in range(60)]
    codes = sorted({near(r, r.choice(codes), r.randrange(0, 5)) for _ in range(500)})
    label = link_within(np.zeros(len(codes), np.int64), np.array(codes, np.uint64), 3)
    want = brute_components(range(len(codes)), codes, 3)
    groups = {}
    for k, v in enumerate(label.tolist()):
        assert groups.setdefault(v, want[k]) == want[k]
    assert len(groups) == len(set(want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 150)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if v == 0} == {k: 0 for k in range(1, 51)}
    assert all(got[k] == 100 for k in range(101, 150)) and got[201] == 200


def texts():
    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(12)]
    out = []
    for k in range(150):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w).upper() if k % 5 == 0 else " ".join(w))
    return [*out, None, "", " \n\t", "one", "One two", "é É x", "a " * 20_000]


@pytest.mark.parametrize("slice_rows", [4000, 7])
def test_near_duplicates(spark, slice_rows):
    rows = [(1000 - k, t, "x") for k, t in enumerate(texts())] + [(None, "one", "x"), (1000, texts()[0], "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string"), slice_rows=slice_rows).collect()
    assert len(got) == len(rows)
    known = {k: brute_fingerprint(t) for k, t, _ in rows if k is not None}
    want = brute_components(list(known), list(known.values()), 3)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.fingerprint == f"{brute_fingerprint('one'):016x}"
        else:
            assert (r.fingerprint, r.component_id) == (f"{known[r.doc_id]:016x}", want[r.doc_id])
    assert len(set(want.values())) < len(want) - 50


def test_hot_tries_are_dealt_finer(spark):
    """Nodes that share two blocks but are far from each other: only finer tries keep the number of tiles down."""
    r = random.Random(9)
    low = (1 << 26) - 1
    codes = [(r.getrandbits(38) << 26) | 12345 for _ in range(400)]
    codes = sorted({c for c in codes} | {near(r, c, 2) & ~low | 12345 for c in codes[:60]} | {near(r, c, 3) for c in codes[60:120]})
    nodes = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c, k) for k, c in enumerate(codes)], "fp long, rep long")
    f = simhash.F
    keyed = nodes.select("fp", "rep", f.lit(None).cast("binary").alias("sketch"), f.explode(simhash._block_keys(f.col("fp"), 3, 5)).alias("key"))
    want = brute_components(range(len(codes)), codes, 3)
    for finer in (simhash._finer_keys(f.col("fp"), 3, 5), None):
        roots = {x.node: x.root for x in components(simhash.links(keyed, 3, 20, finer=finer)).collect()}
        assert {k: roots.get(k, k) for k in want} == want
    assert len(set(want.values())) < len(codes) - 60


@pytest.mark.parametrize("slice_rows", [4000, 9])
def test_one_of_each(spark, slice_rows):
    r = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    rows, group = [], {}
    for k in range(30):
        base = [r.choice(words) for _ in range(200)]
        for c in range(1 if k % 2 else r.randrange(2, 25)):
            w = list(base)
            for _ in range(r.randrange(0, 3) if c else 0):
                w[r.randrange(200)] = r.choice(words)
            rows.append((len(rows), " ".join(w), "s"))
            group[len(rows) - 1] = k
    rows += [(5000, None, "s"), (5001, " ", "s"), (None, rows[0][1], "s"), (0, rows[0][1], "s"), (5002, "short text", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    kept = simhash.one_of_each(docs, slice_rows=slice_rows)
    assert kept.columns == docs.columns
    ids = sorted(x.doc_id for x in kept.collect())
    assert ids == sorted([min(d for d, g in group.items() if g == k) for k in range(30)] + [5000, 5002])


@pytest.mark.parametrize("slice_rows", [4000, 7])
def test_one_of_each_is_exact(spark, slice_rows):
    r = random.Random(8)
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, sets, sides = [], [], [0, 0]
    for _ in range(60):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.choice([150, 300, 600]))]
        for changes in (0, r.randrange(len(base) // 80, len(base) // 25)):
            w = list(base)
            for at in r.sample(range(0, len(w), 5), changes):
                w[at] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
            sets.append(shingles(w))
    kept = set(range(len(rows)))
    for k in range(0, len(rows), 2):
        j = len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1])
        sides[0] += 0.7 <= j < 0.8
        sides[1] += 0.8 <= j < 0.9
        if j >= 0.8:
            kept.remove(k + 1)
    assert min(sides) >= 10
    # 32 and 31 of 40 shingles
    line = [f"y{k}" for k in range(44)]
    rows += [(1000, " ".join(line)), (1001, " ".join(line[:36])), (1002, " ".join([f"v{k}" for k in range(44)])), (1003, " ".join([f"v{k}" for k in range(35)]))]
    kept |= {1000, 1002, 1003}
    got = {x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), slice_rows=slice_rows).collect()}
    assert got == kept


def test_equal_codes_are_compared():
    code = np.array([5, 5, 5, 9], np.uint64)
    label = link_within(np.zeros(4, np.int64), code, 0, lambda i, j: (i == 0) & (j == 2))
    assert label[0] == label[2] != label[1]


def test_empty_table(spark):
    none = spark.createDataFrame([(1, "x")], "doc_id long, text string").limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
