from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.llm import urlfilter as uf

DAY = [datetime(2024, 1, d) for d in range(1, 32)]
ENTRIES = [
    ("Bad.example.com", "add", DAY[4]), ("bad.example.com", "remove", DAY[10]), ("bad.example.com", "add", DAY[20]), ("bad.example.com", "add", DAY[22]),
    ("example.org/a/b/", "add", DAY[0]), ("com", "add", DAY[25]), ("x.org", "add", DAY[3]), ("x.org", "remove", DAY[3]), ("y.org", "remove", DAY[3]),
    (None, "add", DAY[0]), ("z.org", "add", None), ("z.org", "ban", DAY[0]),
]


def brute(url, t):
    rest = (url or "").strip().split("://", 1)
    if len(rest) < 2 or t is None:
        return []
    rest = rest[1].split("?")[0].split("#")[0]
    place, _, path = rest.partition("/")
    host = place.split("@")[-1].split(":")[0].lower().rstrip(".")
    path = path.strip("/")
    found = []
    for p, start, end in [("bad.example.com", DAY[4], DAY[10]), ("bad.example.com", DAY[20], None), ("example.org/a/b", DAY[0], None), ("com", DAY[25], None)]:
        h, _, s = p.partition("/")
        covers = (host == h and (path == s or path.startswith(s + "/"))) if s else (host == h or host.endswith("." + h))
        if covers and start <= t and (end is None or t < end):
            found.append((p, start))
    return found


@pytest.mark.parametrize("most", [10**6, 0])
def test_as_of_join(spark, most):
    urls = ["http://bad.example.com/", "https://u:p@WWW.bad.example.com:8080/x?y#z", "http://notbad.example.com", "http://example.org/a/b", "http://example.org/a/bc", "http://example.org//a/b/c/", "http://sub.example.org/a/b", "http://x.org/", "http://y.org", "http://z.org", "no url", "", None, "ftp://bad.example.com./f"]
    rows = [(k, u, d, "h") for d in (DAY[3], DAY[4], DAY[9], DAY[10], DAY[20], DAY[28], None) for k, u in enumerate(urls)]
    rows += rows[:1]
    pages = spark.createDataFrame(rows, "page_id long, url string, t timestamp, host string")
    entries = spark.createDataFrame(ENTRIES, "pattern string, action string, at timestamp")
    got = uf.filtered(pages, entries, F.col("t"), max_broadcast=most).collect()
    assert len(got) == len(rows)
    want = []
    for k, u, t, _ in rows:
        found = brute(u, t)
        best = max(found, key=lambda x: len(x[0])) if found else (None, None)
        want.append((k, str(t), bool(found), str(best[0]), str(best[1]), len(found)))
    assert sorted((r.page_id, str(r.fetched_at), r.blocked, str(r.pattern), str(r.listed_at), r.n_patterns) for r in got) == sorted(want)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com", DAY[0])], "page_id long, url string, t timestamp")
    entries = spark.createDataFrame([("a.com", "add", DAY[0])], "pattern string, action string, at timestamp")
    assert uf.filtered(pages, entries, F.col("t")).first().blocked
    assert not uf.filtered(pages, entries.limit(0), F.col("t")).first().blocked
    assert uf.filtered(pages.limit(0), entries, F.col("t")).count() == 0


def test_very_long_urls(spark):
    """A megabyte of segments, labels, slashes or blanks takes no longer than its list's patterns are deep."""
    import time

    long = ["http://example.org/a/b/" + "x/" * 500_000, "http://" + "y." * 500_000 + "bad.example.com/", "http://example.org/" + "/" * 10**6 + "a", "http://example.org/a/b" + "/" * 10**6, "http://x" + " " * 10**5]
    pages = spark.createDataFrame([(k, u, DAY[28]) for k, u in enumerate(long)], "page_id long, url string, t timestamp")
    entries = spark.createDataFrame(ENTRIES, "pattern string, action string, at timestamp")
    uf.filtered(pages.where("page_id < 0"), entries, F.col("t")).collect()
    began = time.time()
    got = {r.page_id: (r.pattern, r.n_patterns) for r in uf.filtered(pages, entries, F.col("t")).collect()}
    assert time.time() - began < 10
    assert got == {0: ("example.org/a/b", 1), 1: ("bad.example.com", 2), 2: (None, 0), 3: ("example.org/a/b", 1), 4: (None, 0)}


def test_past_the_broadcast_only_keys_of_the_list_are_shuffled(spark):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".site.example.com/p/q")).alias("url"), F.lit(DAY[28]).alias("t"))
    entries = spark.createDataFrame([(f"h{k}.site.example.com", "add", DAY[0]) for k in range(50)] + [("other.org/a/b/c", "add", DAY[0])], "pattern string, action string, at timestamp")
    seen = []
    real = uf._may_hit
    try:
        uf._may_hit = lambda keys, seeds: seen.append(real(keys, seeds)) or seen[-1]
        got = uf.filtered(pages, entries, F.col("t"), max_broadcast=0)
        assert got.where("blocked").count() == 50 and got.count() == 2000
        assert seen[0].count() < 60  # of 14,000 keys
    finally:
        uf._may_hit = real
