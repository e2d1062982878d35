"""Filter interaction audit: what each of five filters takes in every order in which they can be applied.

Spark reduces the documents to mask cells: for each part (a value of `source`), how many documents fail exactly which
filters, and how many of those are labelled good or toxic. 32 cells a part say all that any order does. All orders
are then visited by adjacent transpositions (each differs from the one before by a swap of neighbours). A swap changes
the steps of the two filters only: the first of them is counted anew from the cells, and the second gets what is left
of the pair's sum. What a filter removes is added up along the walk, over all orders: its Shapley sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import text_of

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
_KINDS = ("n", "good", "toxic")
DDL = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_SCHEMA = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))])


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (1, 2, 4, 8); A-D depend on the text alone."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \t-\r]+"))
    # the words are an argument, so that they are split once
    few = lambda w: F.when(F.size(w) < 50, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)).cast("long") < 65 * F.size(w).cast("long"), 2).otherwise(0)
    by_words = F.get(F.transform(F.array(words), few), F.lit(0))
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long")
    return by_words + F.when(loud, 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of a mask.

    A text leaves the scan as a digest of 32 bytes and four bits. Rows are added up before each shuffle, so a part,
    a text or an id that holds a third of all rows is a few rows there.
    """
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).cast("int").alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("id"))
    marks = marks.agg(*(F.coalesce(F.max((labels[c] == 1).cast("int")), F.lit(0)).alias(k) for k, c in (("good", good_col), ("toxic", toxic_col)))).where("good + toxic > 0")
    flag = lambda k: F.coalesce(k, F.lit(0)).alias(k)
    rows = rows.join(marks, "id", "left").select("id", "part", "digest", "mask", "n", flag("good"), flag("toxic"))
    # rows of one text differ in part and labels only; within them an id stands once
    alike = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unknown"), F.min_by("n", "id").alias("n_least"))
    first = F.expr("min(least) over (partition by digest)")
    alike = alike.withColumn("passes", F.coalesce(F.when(F.col("least") == first, F.col("n_least")), F.lit(0)) + F.col("unknown"))
    cell = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("n"))))
    each = alike.select("part", "good", "toxic", cell.alias("cell")).where("cell.n > 0")
    n = F.col("cell.n")
    return each.groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def swaps(n: int) -> Iterator[int]:
    """Places k, such that swapping the things at k and k + 1, one after the other, visits every order of n things once."""
    if n < 2:
        return
    shorter, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)  # the last thing passes through all the others
        k = next(shorter, None)
        if k is None:
            return
        yield k + 1 if down else k  # it stands before them now, or after them
        down = not down


def audit(cells: np.ndarray) -> tuple[list[str], dict[str, np.ndarray]]:
    """The orders as visited, and for each figure an array [order, step, part]; cells: [part, mask, kind]."""
    cells = np.ascontiguousarray(cells.transpose(1, 2, 0))  # [mask, kind, part]
    masks = np.arange(CELLS)
    fails = [(masks >> f) & 1 == 1 for f in range(len(FILTERS))]
    failing = np.stack([cells[m, 0].sum(axis=0) for m in fails])
    alone = np.stack([cells[1 << f, 0] for f in range(len(FILTERS))])
    steps = len(FILTERS)

    def taken(f: int, before: int) -> np.ndarray:
        """[kind, part]: what filter f removes after those whose bits are in `before`."""
        return cells[fails[f] & (masks & before == 0)].sum(axis=0)

    order = list(range(steps))
    lost, before = np.zeros((steps, *cells.shape[1:]), np.int64), 0
    for k, f in enumerate(order):
        lost[k] = taken(f, before)
        before |= 1 << f
    kept = cells[:, 0].sum(axis=0) - np.cumsum(lost[:, 0], axis=0)
    orders, out, shapley = [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}, np.zeros_like(failing)

    def visit() -> None:
        orders.append("".join(FILTERS[f] for f in order))
        removed = lost[:, 0]
        shapley[order] += removed
        for key, value in (("kept", kept), ("removed", removed), ("redundant", failing[order] - removed), ("unique_fails", alone[order]), ("good_lost", lost[:, 1]), ("toxic_lost", lost[:, 2])):
            out[key].append(value.copy())

    visit()
    for k in swaps(steps):
        order[k], order[k + 1] = order[k + 1], order[k]
        both = lost[k] + lost[k + 1]
        lost[k] = taken(order[k], sum(1 << f for f in order[:k]))
        lost[k + 1] = both - lost[k]
        kept[k] = kept[k + 1] + lost[k + 1, 0]
        visit()
    found = {k: np.stack(v) for k, v in out.items()}
    found["shapley"] = np.stack([shapley[[FILTERS.index(f) for f in o]] for o in orders])
    return orders, found


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Filters fail a text of under 50 words (A), of under 65 distinct words in 100 (B), of over 5 capitals A-Z in 100
    code points (C), with one of #$%&*| (D), or identical to the text of a smaller doc_id in any part (E). Null texts
    are empty, and so identical to each other; a null part is the part ''. A null doc_id is smaller than none and
    none is smaller than it, so E passes it. Repeated rows count each, and as they have one doc_id, alike. A document
    is good or toxic if any of its labels says so; one without an id has no label. An empty table gives no rows.
    Other columns, of any name, aren't read.
    """
    cells = mask_cells(docs, labels, id_col, text_col, part_col, good_col, toxic_col)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *_KINDS)).alias("cells"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                names, n = part.column(0), part.num_rows
                lists = part.column(1)
                flat, owner = lists.flatten(), np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                masks, *values = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                array = np.zeros((n, CELLS, 3), np.int64)
                array[owner, masks] = np.stack(values, axis=1)
                orders, found = audit(array)
                size = len(orders) * len(FILTERS)
                lined = lambda a: pa.array(np.ascontiguousarray(a.reshape(size, n).T).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(np.repeat(np.arange(n), size))),
                        pa.array(np.tile(np.repeat(np.array(orders, object), len(FILTERS)), n), pa.string()),
                        pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders) * n)),
                        *(lined(found[f.name]) for f in list(_SCHEMA)[3:]),
                    ],
                    schema=_SCHEMA,
                )

    return parts.mapInArrow(run, DDL)
