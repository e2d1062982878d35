import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from docloom.llm import periodicity, queries
from hypothesis import given, settings
from hypothesis import strategies as st


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(a == b for a, b in zip(w, w[q:])))


def brute(w):
    """Each stretch for each period, and the smallest period of what stands in it."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        k = 0
        while k < n - q:
            if w[k] != w[k + q]:
                k += 1
                continue
            start = k
            while k < n - q and w[k] == w[k + q]:
                k += 1
            length = k - start + q
            if length >= max(24, 3 * q) and smallest_period(w[start : start + length]) == q:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(w):
    return [tuple(r) for r in periodicity.runs(np.array(w, np.int32)).tolist()] if len(w) else []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.lists(st.integers(0, 1), min_size=1, max_size=9), st.integers(1, 30), st.lists(st.integers(0, 2), max_size=40))
def test_runs_against_brute_force(head, period, times, tail):
    w = head + period * times + tail + period * 5
    assert found(w) == brute(w)


def test_extensions():
    r = random.Random(3)
    for n in (1, 2, 3, 50, 200):
        for k in (1, 2, 9):
            w = np.array([r.randrange(k) for _ in range(n)], np.int32)
            e = periodicity.Extensions(w)
            i, j = (np.array([r.randrange(n + 1) for _ in range(300)]) for _ in range(2))
            i, j = i[i != j], j[i != j]
            want = [next((d for d in range(n) if max(a, b) + d >= n or w[a + d] != w[b + d]), n) for a, b in zip(i.tolist(), j.tolist())]
            assert e.longest(i, j).tolist() == want


def test_blocks_of_the_grid(monkeypatch):
    r = random.Random(4)
    w = [r.randrange(3) for _ in range(70)] + [1, 2, 0, 0] * 20 + [r.randrange(3) for _ in range(50)] + list(range(40)) * 3 + [7] * 30
    want = brute(w)
    assert len(want) > 2
    for block in (1, 60, 1000):
        monkeypatch.setattr(periodicity, "BLOCK", block)
        assert found(w) == want


def row(doc_id, text, plant):
    """The contract in plain Python."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    rs = brute(w)
    best = max(rs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, length, q in rs for k in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(rs), *shown, sha("".join(f"{s},{length},{q}\n" for s, length, q in rs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


@pytest.mark.parametrize("plant", [False, True])
def test_rows_against_brute_force(spark, plant):
    r = random.Random(6)
    some = lambda n, k: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    texts = [None, "", " \t\n", "a", "a " * 23, "a " * 24, " x " * 30, "A a " * 20, "x\x1cy z " * 25, "é\r\nf\x0bg " * 9, some(300, 4), some(300, 40) + " " + "u v w " * 8, "a b " * 13 + some(20, 9) + " c d e" * 9]
    texts += [some(r.randrange(1, 400), 50) for _ in range(60)]
    docs = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "b c " * 30, "x"), (3, "a", "x"), (3, "a", "x"), (-7, some(90, 3), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, start string")
    got = periodicity.periodic_runs(df, plant=plant).collect()
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got), key=key) == sorted((row(d, t, plant) for d, t, _ in docs), key=key)
    assert any(x.n_runs > 1 for x in got) and periodicity.periodic_runs(df.limit(0)).count() == 0


def test_very_long_texts():
    r = random.Random(8)
    w = [b"%d" % r.randrange(5000) for _ in range(100_000)]
    text = w + w[:30_000] * 4 + [b"z"] * 50_000
    n, start, length, period, exponent, *_ = periodicity.digest(text)
    assert n == 2 and (start, length, period, exponent) == (220_000, 50_000, 1, 50_000_000)
    assert len(periodicity.collapsed(text, periodicity.runs(periodicity.word_ids(text)))) == 130_001


def test_query_plants_periods(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the supplied tables aren't here")
    got = queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000").collect()
    by_id = {x.doc_id: tuple(x) for x in got}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(by_id[d.doc_id] == row(d.doc_id, d.text, True) for d in docs)
    assert sum(x.n_runs > 0 for x in got) > 5
