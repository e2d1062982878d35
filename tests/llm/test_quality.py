import math
import random

import pytest
import regex
from docloom.llm import quality
from pyspark.sql import functions as F

TREE = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=15
  If (feature 0 <= 2.5)
   If (feature 1 <= 1.0)
    Predict: 0.0
   Else (feature 1 > 1.0)
    If (feature 0 <= 1.5)
     Predict: 1.0
    Else (feature 0 > 1.5)
     Predict: 0.0
  Else (feature 0 > 2.5)
   Predict: 1.0
"""


def test_paths():
    a, b = quality.STATISTICS[:2]
    assert quality.paths(TREE) == [
        ((a, "<=", 2.5),),
        ((a, "<=", 2.5), (b, "<=", 1.0)),
        ((a, "<=", 2.5), (b, ">", 1.0)),
        ((a, "<=", 1.5), (b, ">", 1.0)),
        ((a, "<=", 2.5), (a, ">", 1.5), (b, ">", 1.0)),
        ((a, ">", 2.5),),
    ]


def plain_statistics(text):
    """The statistics in plain Python, without the shortcut over what is left of a text."""
    words = [w for w in regex.split(r"[ \t\n\x0b\f\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    ratio = lambda a, b: a / b if b else 0.0
    share = lambda chars: ratio(len(regex.findall(f"[{chars}]", text)), len(text))
    return {
        "log_chars": math.log1p(len(text)),
        "log_words": math.log1p(len(words)),
        "word_length": ratio(sum(map(len, words)), len(words)),
        "longest_word": math.log1p(max(map(len, words), default=0)),
        "fresh_words": ratio(len(set(words)), len(words)),
        "doubled_words": ratio(sum(a == b for a, b in zip(words, words[1:])), len(words)),
        "fresh_lines": ratio(len(set(lines)), len(lines)),
        "line_words": ratio(len(words), len(lines)),
        "upper": share(r"\p{Lu}"),
        "digit": share(r"\p{N}"),
        "symbol": share(r"#$%&*@^~<>{}\[\]\\/=+_"),
        "mark": share("!?"),
        "stop": share(".,;:"),
        "bar": share("|"),
        "control": share(r"\p{C}\p{So}"),
    }


def plain_score(model, statistics):
    """The rules one by one."""
    total = model.bias
    for rule, weight in model.rules:
        if all(statistics[name] <= bound if side == "<=" else statistics[name] > bound for name, side, bound in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def tables(spark):
    r = random.Random(5)
    words = ["the", "house", "river", "of", "stone", "and", "light"]
    docs, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        w = [r.choice(words) for _ in range(r.randrange(4, 60))]
        docs.append((k, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w), "s"))
        labels.append((k, int(good)))
    docs += [(500, None, "s"), (501, "", "s"), (None, "the river", "s"), (3, docs[3][1], "s"), (502, "x" * 100_000, "s")]
    labels += [(3, 0), (3, 0), (900, 1), (None, 1), (7, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = tables(spark)
    got = quality.scores(docs, labels, trees=4, lasso=0.002).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    known = {r.doc_id: r for r in got}
    out = [k for k in range(400) if known[k].held_out]
    assert len(out) > 40
    assert sum(known[k].predicted == int(k % 3 > 0) for k in out) >= 0.97 * len(out)
    kept = quality.accepted(docs, labels, trees=4, lasso=0.002)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_held_out_labels_are_not_used(spark):
    docs, labels = tables(spark)
    out = quality.is_held_out(F.col("doc_id"), 5)
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((str(r.doc_id), r.score) for r in quality.scores(docs, x, trees=2).collect()) for x in (labels, turned))
    assert a == b


def test_too_few_labels(spark):
    docs, labels = tables(spark)
    (one,) = {r.score for r in quality.scores(docs, labels.where("quality = 1")).collect()}
    assert one > 0.9
    (none,) = {r.score for r in quality.scores(docs, labels.limit(0)).collect()}
    assert none == 0.5
    assert quality.scores(docs.limit(0), labels).count() == 0


def test_statistics_and_rules_against_plain_python(spark):
    docs, labels = tables(spark)
    odd = ["", " ", "\n\n", "a a a b", "A|B! é\u0301 ﬀ ǅ 中文 🙂\x07\x00", "  x\t\ty  \n \n z", "1² ½ $%&*", "word " * 30_000, "q" * 100_000, "x=y[0]{}<>\\/~^@_+"]
    rows = [(1000 + k, t, "s") for k, t in enumerate(odd)] + [tuple(x) for x in docs.collect()]
    every = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = quality.with_statistics(every, [F.col("doc_id"), F.col("text").alias("t")], F.coalesce("text", F.lit(""))).collect()
    assert len(got) == len(rows)
    for x in got:
        want = plain_statistics(x.kept.t or "")
        assert set(want) == set(quality.STATISTICS)
        for name, value in want.items():
            assert x[name] == pytest.approx(value, abs=1e-9), (x.kept.doc_id, name)
    model = quality.fit(every, labels, ~quality.is_held_out(F.col("doc_id"), 5), trees=4)
    assert model.rules
    for x in quality.scores(every, labels, trees=4).join(every.select("doc_id", "text").distinct(), "doc_id").collect():
        assert x["score"] == pytest.approx(plain_score(model, plain_statistics(x.text or "")), abs=1e-9)


def test_training_rows(spark):
    docs, labels = tables(spark)
    got = sorted(tuple(x)[:2] for x in quality.training_rows(docs, labels, F.lit(True), 10**6, "doc_id", "text", "quality").select("label", "log_chars").collect())
    texts = {k: t for k, t, _ in map(tuple, docs.collect())}
    want = []
    marks = {}
    for k, q in map(tuple, labels.collect()):
        if k is not None and q is not None:
            marks.setdefault(k, []).append(q)
    for k, t, _ in map(tuple, docs.collect()):
        if k in marks:
            want.append((1.0 if 2 * sum(marks[k]) >= len(marks[k]) else 0.0, math.log1p(len(t or ""))))
    assert [x[0] for x in got] == [x[0] for x in sorted(want)] and [x[1] for x in got] == pytest.approx([x[1] for x in sorted(want)])
    assert 900 not in texts and quality.training_rows(docs, labels, F.lit(True), 7, "doc_id", "text", "quality").count() <= 8
