"""Each stage on a small table, against plain Python; and the whole run against the stages one after the other."""

import random

import public_tokenizers
import pytest
from test_linededup import brute as deduplicated
from test_quality import plain_score, plain_statistics
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import quality

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so", "ti", "va") for b in ("n", "lar", "mes", "tor", "dip", "fen", "gul", "sam", "bek", "r")]


def prose(r, n, per_line=12):
    w = [r.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(w[k : k + per_line]) + "." for k in range(0, n, per_line))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [(k, " ".join(r.choice(WORDS) for _ in range(30))) for k in range(5)]
    rows, labels = [], []
    for k in range(120):
        good = k % 3 != 0
        text = prose(r, r.randrange(60, 200)) if good else "!!! $$$ 7777 ### " * r.randrange(5, 40)
        rows.append((k, text, "x", k, "s"))
        labels.append((k, int(good), 0))
    copies = [x for x in rows if x[0] % 3][:12]
    for n, (k, text, *_) in enumerate(copies):
        words = text.split(" ")
        if n % 2:
            words[len(words) // 2] = "changed"
        rows.append((200 + n, " ".join(words), "x", k, "s"))
    rows += [(300 + n, prose(r, 40) + "\n" + t + "\n" + prose(r, 40), "x", n, "s") for n, t in items]
    rows += [(400, None, "x", 0, "s"), (401, "", "x", 0, "s"), (None, prose(r, 50), "x", 0, "s"), rows[1], (402, prose(r, 30) + " word" * 20_000, "x", 0, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lines_removed string, lead long, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def near_copies_gone(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    sets, group = [shingles(x[1]) for x in rows], list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for n, a in enumerate(order):
        for b in order[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    first = {}
    for k in order:
        first.setdefault(find(k), k)
    return [rows[k] for k in first.values()]


def leaks(text, items):
    words = lambda t: (t or "").lower().split()
    w = words(text)
    for _, t in items:
        b = words(t)
        for i in range(len(w) - 14):
            for j in range(len(b) - 14):
                if sum(x == y for x, y in zip(w[i : i + 15], b[j : j + 15])) >= 12:
                    return True
    return False


def test_stages_against_brute_force(spark, tables):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = stages["quality"](spark, docs, tables)
    assert kept.columns == docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"), ~quality.is_held_out(quality.F.col("doc_id"), 5))
    want = [tuple(x) for x in docs.collect() if plain_score(model, plain_statistics(x.text or "")) >= 0.3]
    rows = [tuple(x) for x in kept.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert {x[0] for x in rows} >= {k for k in range(120) if k % 3} and not any(k is not None and k < 120 and k % 3 == 0 for k, *_ in rows)

    cut = stages["line dedup"](spark, spark.createDataFrame(rows, docs.schema), tables)
    assert cut.columns == docs.columns
    texts = deduplicated([(k, t) for k, t, *_ in rows], 25, 50)
    no_id = (1 << 63) - 1
    want = [(k, t if t is None else texts[k if k is not None else no_id, t][0], *x) for k, t, *x in rows]
    rows = [tuple(x) for x in cut.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)

    once = stages["near-duplicates"](spark, spark.createDataFrame(rows, docs.schema), tables)
    want = near_copies_gone(rows)
    rows = [tuple(x) for x in once.collect()]
    assert once.columns == docs.columns and sorted(rows, key=str) == sorted(want, key=str)

    clean = stages["decontamination"](spark, spark.createDataFrame(rows, docs.schema), tables)
    items = [tuple(x) for x in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    want = [x for x in rows if not leaks(x[1], items)]
    assert len(want) == len(rows) - 5
    rows = [tuple(x) for x in clean.collect()]
    assert clean.columns == docs.columns and sorted(rows, key=str) == sorted(want, key=str)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoded = stages["bpe"](spark, spark.createDataFrame(rows, docs.schema), tables).collect()
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, ids, library.decode(ids, skip_special_tokens=False), len(ids)))
    assert sorted(map(tuple, encoded), key=str) == sorted(want, key=str)

    whole = corpus_pipeline.run(spark, tables)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_folder_of_one_machine_on_a_cluster():
    class Session:
        def __init__(self, **conf):
            self.conf = conf

    from docloom.llm.common import scratch

    assert scratch(Session(**{"spark.checkpoint.dir": "hdfs://a/b/", "spark.master": "yarn"}), "x").startswith("hdfs://a/b/docloom/x-")
    with pytest.raises(ValueError):
        scratch(Session(**{"spark.master": "k8s://x", "spark.sql.warehouse.dir": "file:/root/spark-warehouse"}), "x")
