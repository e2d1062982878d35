import random

from docloom.llm import linededup


def rising(pairs):
    """Quadratic: of the longest rising sequences the one that ends lowest, and so on backwards."""
    best = []
    for k, (_, e) in enumerate(pairs):
        before = [(best[j][0], -pairs[j][1], j) for j in range(k) if pairs[j][1] < e]
        n, _, j = max(before, default=(0, 0, None))
        best.append((n + 1, j))
    out, k = [], max(range(len(pairs)), key=lambda k: (best[k][0], -pairs[k][1])) if pairs else None
    while k is not None:
        out.append(pairs[k])
        k = best[k][1]
    return out[::-1]


def aligned(a, b):
    """A recursive patience diff of lists of (position, line) without blank lines."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *aligned(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*aligned(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    mine, other = [x for _, x in a], [x for _, x in b]
    pairs = [(i, other.index(x)) for i, x in enumerate(mine) if mine.count(x) == other.count(x) == 1]
    if not pairs:
        places = lambda some, x: [k for k, y in enumerate(some) if y == x]
        pairs = sorted((i, j) for x in set(mine) for i, j in zip(places(mine, x), places(other, x)))
    out, i, j = [], 0, 0
    for i2, j2 in [*rising(pairs), (len(a), len(b))]:
        if pairs:
            out += aligned(a[i:i2], b[j:j2])
        if i2 < len(a):
            out.append((a[i2][0], b[j2][0]))
        i, j = i2 + 1, j2 + 1
    return out


def windows(lines, min_words):
    """(first, end) of the shortest stretches of lines with enough words that start, or end, at each line with words."""
    size = lambda i, j: sum(len(x.split()) for x in lines[i:j])
    n, out = len(lines), set()
    for i in range(n):
        if lines[i]:
            ends = [j for j in range(i + 1, n + 1) if size(i, j) >= min_words]
            starts = [k for k in range(i + 1) if size(k, i + 1) >= min_words]
            out |= ({(i, ends[0])} if ends else set()) | ({(starts[-1], i + 1)} if starts else set())
    return out


def brute(rows, min_words, moved_words):
    docs = sorted({(k if k is not None else linededup.NO_ID, t or "") for k, t, *_ in rows})
    every = [[" ".join(x.split()) for x in t.split("\n")] for _, t in docs]
    held = [{tuple(lines[i:j]): i for i, j in sorted(windows(lines, min_words), reverse=True)} for lines in every]
    out = {}
    for n, (k, t) in enumerate(docs):
        lines, drop, anchors = every[n], set(), {}
        for i, j in windows(lines, min_words):
            e = next(m for m in range(len(docs)) if tuple(lines[i:j]) in held[m])
            if e < n:
                anchors.setdefault(e, []).append((i, held[e][tuple(lines[i:j])], j - i))
        for e, some in anchors.items():
            pairs = aligned([x for x in enumerate(lines) if x[1]], [x for x in enumerate(every[e]) if x[1]])
            went = {i for i, _ in pairs}
            for shift in {i - j for i, j, _ in some}:
                covered = {i + m for i, j, size in some if i - j == shift for m in range(size)}
                for i in sorted(covered):
                    if i - 1 not in covered:
                        end = next(x for x in range(i, len(lines) + 1) if x not in covered)
                        if sum(len(x.split()) for x in lines[i:end]) >= moved_words and any(lines[x] and x not in {i for i, _ in pairs} for x in range(i, end)):
                            went |= set(range(i, end))
            for i in sorted(went):  # blank lines between
                after = next((x for x in range(i + 1, len(lines)) if lines[x]), None)
                drop |= {i} | (set(range(i, after)) if after in went else set())
        out[k, t] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop), len(drop)
    return out


def test_against_brute_force(spark):
    r = random.Random(6)
    pool = [" ".join(f"w{r.randrange(200)}" for _ in range(r.choice([1, 2, 3, 5, 8]))) for _ in range(25)] + [""]
    passage = [pool[3], pool[4], pool[5], pool[6]]
    rows = []
    for k in range(60):
        t = [r.choice(pool) for _ in range(r.randrange(0, 12))]
        if k % 3 == 0:
            at = r.randrange(len(t) + 1)
            t[at:at] = passage
        if k % 7 == 0:
            t += passage
        rows.append((k, "\n".join(t), k, "z"))
    rows += [(70, None, 0, "z"), (71, "", 0, "z"), (None, rows[9][1], 0, "z"), (9, rows[9][1], 9, "z"), (72, rows[12][1], 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines_removed int, hash string")
    got = linededup.deduplicated(docs, min_words=8, moved_words=16).collect()
    want = brute(rows, 8, 16)
    assert len(got) == len(rows)
    texts = {}
    for k, t, *_ in rows:
        texts.setdefault(k, set()).add(t)
    assert sum(r.lines_removed > 0 for r in got) > 15
    for g in got:
        (t,) = texts[g.doc_id]
        new, n = want[g.doc_id if g.doc_id is not None else linededup.NO_ID, t or ""]
        assert (g.text, g.lines_removed, g.hash) == (None if t is None else new, n, "z"), (g.doc_id, t)


def test_patience_is_a_patience_diff():
    r = random.Random(5)
    for _ in range(600):
        a, b = ([r.randrange(r.choice((3, 12))) for _ in range(r.randrange(14))] for _ in range(2))
        got = linededup.patience(a, b)
        assert got == aligned([x for x in enumerate(a) if x[1]], [x for x in enumerate(b) if x[1]])
        assert all(a[i] == b[j] and a[i] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    assert len(linededup.patience([7] * 50_000, [7] * 60_000)) == 50_000
    assert len(linededup.patience(list(range(1, 30_001)), list(range(30_000, 0, -1)))) == 1


def test_the_alignment_decides(spark):
    """Of two passages in the other order one crosses the alignment; it goes only if it is long."""
    line = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    first = [line("a", 30), "x", line("b", 30), "tail"]
    crossed = [line("b", 30), "y", line("a", 30)]
    long = [line("c", 60), "z", line("d", 60)]
    turned = [line("d", 60), "u", line("c", 60)]
    docs = spark.createDataFrame([(k, "\n".join(t)) for k, t in enumerate([first, crossed, long, turned])], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in linededup.deduplicated(docs).collect()}
    assert got[0] == first and got[2] == long and got[3] == ["u"]
    assert len(got[1]) == 2 and "y" in got[1]  # all common runs would leave y alone


def test_hot_keys_are_dealt_out(spark):
    from pyspark.sql import functions as F

    from docloom.llm.common import skew_join

    left = spark.range(2000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = skew_join(left, right, ["k"], F.xxhash64("id"), hot_rows=100)
    assert got.count() == 2000 and got.where("top = 1499").count() == 1500 and got.columns == ["k", "id", "top"]
    assert skew_join(left.limit(0), right.limit(0), ["k"], F.xxhash64("id")).count() == 0


def test_long_text_and_empty_table(spark):
    line = " ".join(f"x{k}" for k in range(30))
    long = "\n".join([f"{line} {k}" for k in range(20_000)])
    docs = spark.createDataFrame([(1, long), (2, "head\n" + long), (3, "word " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.deduplicated(docs).collect()}
    assert got[1].text == long and got[2].text == "head" and got[2].lines_removed == 20_000
    assert linededup.deduplicated(docs.limit(0)).count() == 0


def test_short_lines_of_aligned_copies_go(spark):
    long = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    first = ["short one", long[0], "short two", "old", "short three", long[1], "tail line", "last"]
    later = ["mine", "short one", long[0], "short two", "new", "", "short three", long[1], "other", "tail line"]
    docs = spark.createDataFrame([(1, "\n".join(first)), (2, "\n".join(later)), (3, "short one\nshort two")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()}
    assert got == {1: "\n".join(first), 2: "mine\nnew\n\nother", 3: "short one\nshort two"}


def test_tasks_get_small_batches_and_keep_no_tables_of_others(spark, monkeypatch):
    import public_tokenizers

    from docloom.llm import bpe, common

    key, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, name: seen.append(int(spark.conf.get(key))) or write(df, name))
    docs = spark.createDataFrame([(1, "a b c\nd e f"), (2, "a b c\nx")], "doc_id long, text string")
    before = spark.conf.get(key)
    assert linededup.deduplicated(docs, min_words=3).count() == 2
    assert seen and max(seen) <= 1000 and spark.conf.get(key) == before

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        bpe.codec(f.read())
    assert bpe.codec.cache_info().currsize == 1
    common.tables_dropped()
    assert bpe.codec.cache_info().currsize == 0
