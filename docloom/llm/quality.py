"""Quality classifier: a sparse ensemble of rules over statistics of the text.

A forest is grown on a bounded sample of labelled texts. The path to each of its nodes is a rule, a conjunction
of bounds on statistics. A logistic regression with the lasso weighs the rules and drops most of them. What is
left is compiled into one column expression, so all texts are scored where they are read, without Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import text_of, written

#: Names of the statistics, in the order of the feature vector.
STATISTICS = ("log_chars", "log_words", "word_length", "longest_word", "fresh_words", "doubled_words", "fresh_lines", "line_words", "upper", "digit", "symbol", "mark", "stop", "bar", "control")

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", bound), all of which hold


def _statistics() -> dict[str, Column]:
    """The statistics from the columns text, words, lines and rest; of an empty text all are 0."""
    n = F.length("text")
    share = lambda chars: F.length(F.regexp_replace("rest", f"[^{chars}]+", ""))
    words = F.size("words")
    ratio = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(words.cast("double")),
        "word_length": ratio(F.length(F.regexp_replace("text", r"\s+", "")), words),
        "longest_word": F.log1p(F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).cast("double")),
        "fresh_words": ratio(F.size(F.array_distinct("words")), words),
        "doubled_words": ratio(F.size(F.filter(F.zip_with("words", F.slice("words", 2, F.greatest(words, F.lit(1))), lambda a, b: a == b), lambda same: same)), words),
        "fresh_lines": ratio(F.size(F.array_distinct("lines")), F.size("lines")),
        "line_words": ratio(words, F.size("lines")),
        "upper": ratio(share(r"\p{Lu}"), n),
        "digit": ratio(share(r"\p{N}"), n),
        "symbol": ratio(share(r"#$%&*@^~<>{}\[\]\\/=+_"), n),
        "mark": ratio(share("!?"), n),
        "stop": ratio(share(".,;:"), n),
        "bar": ratio(share("|"), n),
        "control": ratio(share(r"\p{C}\p{So}"), n),
    }


def with_statistics(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """`keep`, named, and the statistics of the text as further columns."""
    rows = docs.select(F.struct(*keep).alias("kept"), text.alias("text"))
    rows = rows.withColumns({
        "words": F.filter(F.split("text", r"\s+"), lambda w: w != ""),
        "lines": F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""),
        # what is left without small letters and blanks is short, so the counts below are cheap
        "rest": F.regexp_replace("text", r"[\p{Ll}\p{Lo}\p{Lm}\p{M} ]+", ""),
    })
    return rows.select("kept", *(c.alias(k) for k, c in _statistics().items()))


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, of=F.col) -> Column:
        """The probability of label 1; `of` gives the column of a statistic."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, of), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _holds(rule: Rule, of=F.col) -> Column:
    holds = F.lit(True)
    for name, side, bound in rule:
        holds = holds & (of(name) <= bound if side == "<=" else of(name) > bound)
    return holds


def paths(tree: str) -> list[Rule]:
    """The path to each node below the root of a printed decision tree, simplified to the tightest bounds."""
    found, path = [], []
    for line in tree.splitlines():
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            del path[(len(m[1]) - 2) // 1 :]  # each level is indented by one more blank
            path.append((STATISTICS[int(m[3])], m[4], float(m[5])))
            tight: dict[tuple[str, str], float] = {}
            for name, side, bound in path:
                old = tight.get((name, side), bound)
                tight[name, side] = min(old, bound) if side == "<=" else max(old, bound)
            found.append(tuple(sorted((n, s, b) for (n, s), b in tight.items())))
    return found


def training_rows(docs: DataFrame, labels: DataFrame, trained_on: Column, max_labelled: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(kept.label, statistics): at most `max_labelled` labelled texts, those with the least hashes of their ids.

    The sample is drawn from the labels, so only its texts are looked up, by a broadcast of at most that many ids.
    Several labels of one id are averaged, and an average of 0.5 counts as 1; rows without an id or label are left out.
    """
    marks = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull() & trained_on)
    marks = marks.groupBy(labels[id_col].cast("long").alias("label_id")).agg(F.when(F.avg(label_col) >= 0.5, 1.0).otherwise(0.0).alias("label"))
    marks = marks.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    rows = rows.join(F.broadcast(marks), rows.doc_id == marks.label_id)
    return with_statistics(rows, [F.col("label")], F.col("text")).select(F.col("kept.label").alias("label"), *STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, trees: int = 12, depth: int = 4, lasso: float = 0.001, seed: int = 7) -> RuleModel:
    """A model from the labels where `trained_on` (a condition on `labels`) holds.

    Without both labels among them the model is the smoothed share of label 1.
    """
    rows = written(training_rows(docs, labels, trained_on, max_labelled, id_col, text_col, label_col), "labelled").coalesce(4)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        p = (ones + 0.5) / (n + 1)
        return RuleModel(float(-math.log(1 / p - 1)), [])
    inputs = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, subsamplingRate=0.8, minInstancesPerNode=max(2, int(n) // 2000)).fit(inputs)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString)})
    flags = F.array(*(_holds(r).cast("double") for r in rules))
    inputs = written(rows.select("label", flags.alias("flags")), "rules").coalesce(4)
    inputs = inputs.select("label", array_to_vector("flags").alias("features")).persist()
    fitted = LogisticRegression(regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(inputs)
    inputs.unpersist()
    weights = fitted.coefficients.toArray().tolist()
    return RuleModel(float(fitted.intercept), [(r, w) for r, w in zip(rules, weights) if w])


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, fold: int = 5, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs.

    Rows whose crc32(id as text) mod `fold` is 0 are held out of training. Null texts are empty; empty texts are
    scored by the same rules. A null id counts as empty text in the hash. Repeated rows are all returned; an
    empty table gives an empty result. Other columns are no input of a score.
    """
    model = fit(docs, labels, ~is_held_out(labels[id_col], fold), id_col, text_col, label_col, **fitting)
    keep = [docs[id_col].cast("long").alias("doc_id"), is_held_out(docs[id_col], fold).alias("held_out")]
    scored = with_statistics(docs, keep, text_of(docs, text_col)).select("kept.*", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, fold: int = 5, **fitting) -> DataFrame:
    """The rows of docs, with all their columns, that score `threshold` or more.

    Null texts are scored as empty and keep their null; rows without an id and repeated rows are judged like any
    other. Without labels every row scores 0.5 and stays. An empty table gives an empty result. Columns of docs
    may have the names of statistics or of anything else.
    """
    model = fit(docs, labels, ~is_held_out(labels[id_col], fold), id_col, text_col, label_col, **fitting)
    keep = [docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]
    scored = with_statistics(docs, keep, text_of(docs, text_col)).where(model.score() >= threshold)
    return scored.select(*(F.col(f"kept.c{k}").alias(c) for k, c in enumerate(docs.columns)))


def is_held_out(doc_id: Column, fold: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % fold == 0
