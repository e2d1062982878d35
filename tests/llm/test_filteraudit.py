import math
import os
import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from docloom.llm import filteraudit, queries

DOCS = "doc_id long, text string, source string, mask string"
LABELS = "doc_id long, quality int, toxic int, source string"


def brute(docs, labels):
    """The contract, document by document and order by order."""
    rows = []
    for doc_id, text, source, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in docs),
        }
        mine = [x for x in labels if x[0] is not None and x[0] == doc_id]
        rows.append((source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                shapley[f] += len(gone)
                redundant = sum(r[1][f] and any(r[1][g] for g in order[: step - 1]) for r in own)
                left = [r for r in left if not r[1][f]]
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                out[part, order, step] = [len(left), len(gone), redundant, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def made(n=60):
    r = random.Random(5)
    long = lambda k: " ".join(f"w{r.randrange(k)}" for _ in range(60))
    docs = [
        (None, long(400), "a", "x"), (None, "same", None, "x"), (1, "same", "", "x"), (1, "same", "", "x"), (1, "same", "b", "x"), (2, "same", "a", "x"),
        (3, None, "a", "x"), (4, "", "b", "x"), (4, None, "b", "x"), (5, " \t\n\x0b", "b", "x"), (6, "Ünï çödé #1", "ü", "x"), (7, "SHOUT " * 70, "b", "x"), (-3, "SHOUT " * 70, "b", "x"),
        (8, " ".join(f"x{k}" for k in range(50)), "a", "x"), (9, "\x0c" + " ".join(f"x{k}" for k in range(49)), "a", "x"), (10, "A" + "b" * 19, "a", "x"), (11, "AA" + "b" * 30, "a", "x"),
    ]
    docs += [(20 + k, r.choice([long(400), long(30), long(400) + " $", long(30).upper(), "few words", "few words |"]), r.choice(["a", "b", None]), "x") for k in range(n)]
    labels = [(d[0], r.choice([0, 1, None]), r.choice([0, 0, 1]), "y") for d in docs[::2]] + [(2, 0, 1, "y"), (2, 1, 0, "y"), (None, 1, 1, "y"), (999, 1, 1, "y")]
    return docs, labels


def test_every_order_is_visited_once_by_swaps_of_neighbours():
    for n in range(7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filteraudit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) == len(list(filteraudit.swaps(n))) + 1


def test_against_brute_force(spark):
    docs, labels = made()
    got = filteraudit.audited(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    want = brute(docs, labels)
    assert len(got) == len(want) == 600 * 4
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want


def test_walk_agrees_with_counting_each_step():
    cells = np.random.default_rng(1).integers(0, 50, (3, filteraudit.CELLS, 3))
    orders, found = filteraudit.audit(cells)
    assert len(set(orders)) == 120
    masks = np.arange(filteraudit.CELLS)
    for at, order in enumerate(orders):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << filteraudit.FILTERS.index(f)
            assert (found["removed"][at, k] == cells[:, (masks & bit > 0) & (masks & before == 0), 0].sum(axis=1)).all()
            before |= bit
            assert (found["kept"][at, k] == cells[:, masks & before == 0, 0].sum(axis=1)).all()
    assert (found["removed"].sum(axis=(0, 1)) == 120 * cells[:, 1:, 0].sum(axis=1)).all()  # the Shapley sums share out all that goes


def test_empty_tables(spark):
    docs, labels = (spark.createDataFrame([], s) for s in (DOCS, LABELS))
    assert filteraudit.audited(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, "x")], DOCS)
    got = filteraudit.audited(one, labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and sum(r.good_lost + r.toxic_lost for r in got) == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the supplied tables aren't here")
def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.oracle_sql()["op13_filter_audit"])
    names = [d[0] for d in want.description]
    want = sorted(map(str, want.fetchall()))
    got = queries.op13_filter_audit(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == want
