"""Line dedup by pairwise alignment of documents that share rare lines.

A line of `min_words` words or more, or the shortest run of lines around a shorter one that has as many, is rare
enough to tell a copied passage from chance. Runs are hashed; each document is paired, for each of its runs, with
the first document that holds it. So there are no more pairs than runs, however many documents share a passage,
and no run is left out for being frequent. Each pair is aligned by a patience diff of its lines, and the aligned
common lines are deleted from the later document, whatever their length. What crosses the alignment, a moved passage,
stays unless the pair shares `moved_words` words of it in a row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small, small_batches, skew_join, tables_dropped, text_of, written

NO_ID = (1 << 63) - 1


def runs_of(text: bytes, min_words: int) -> list[tuple[int, int, int]]:
    """(hash, first line, number of lines) of each shortest run that starts or ends at a line and has `min_words` words."""
    lines = [b" ".join(x.split()) for x in text.split(b"\n")]
    words = np.array([x.count(b" ") + 1 if x else 0 for x in lines])
    before = np.concatenate([[0], np.cumsum(words)])
    if before[-1] < min_words:
        return []
    n = len(lines)
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)
    starts = np.flatnonzero(words > 0)
    ends = np.searchsorted(before, before[starts] + min_words)  # least end with enough words
    forward = {(int(a), int(b)) for a, b in zip(starts, ends) if b <= n}
    last = np.flatnonzero(words > 0) + 1
    begins = np.searchsorted(before, before[last] - min_words, side="right") - 1  # greatest start with enough words
    backward = {(int(a), int(b)) for a, b in zip(begins, last) if before[b] - before[a] >= min_words and a >= 0}
    return [(xxhash.xxh64_intdigest(hashes[a:b].tobytes()) - (1 << 63), a, b - a) for a, b in sorted(forward | backward)]


def _ranked(codes: list[int], lo: int, hi: int) -> dict[tuple[int, int], int]:
    """Positions by (line, how many equal lines come before it in the range); zeros, blank lines, are left out."""
    seen: dict[int, int] = {}
    out = {}
    for k in range(lo, hi):
        if x := codes[k]:
            n = seen[x] = seen.get(x, -1) + 1
            out[x, n] = k
    return out


def _once(ranked: dict[tuple[int, int], int]) -> dict[int, int]:
    again = {x for x, n in ranked if n == 1}
    return {x: k for (x, n), k in ranked.items() if not n and x not in again}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest sequence of the pairs, sorted by their first positions, that rises in the second too; by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, e) in enumerate(pairs):
        pile = bisect_left(tops, e)
        back.append(at[pile - 1] if pile else -1)
        tops[pile : pile + 1], at[pile : pile + 1] = [e], [k]
    k, out = at[-1] if at else -1, []
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions of equal lines, rising in both texts; zeros are blank lines and pair with nothing.

    Of a stretch of both texts the equal lines at its ends are paired, then those that come once in both, as many as
    rise in both; what lies between them is aligned in the same way. Without such lines the k-th of equal lines
    is paired with the k-th.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        lo, hi, lo2, hi2 = stack.pop()
        while lo < hi and lo2 < hi2 and (a[lo] == b[lo2] or not a[lo] or not b[lo2]):
            if a[lo] == b[lo2]:
                if a[lo]:
                    out.append((lo, lo2))
                lo, lo2 = lo + 1, lo2 + 1
            else:
                lo, lo2 = lo + (not a[lo]), lo2 + (not b[lo2])
        while lo < hi and lo2 < hi2 and (a[hi - 1] == b[hi2 - 1] or not a[hi - 1] or not b[hi2 - 1]):
            if a[hi - 1] == b[hi2 - 1]:
                if a[hi - 1]:
                    out.append((hi - 1, hi2 - 1))
                hi, hi2 = hi - 1, hi2 - 1
            else:
                hi, hi2 = hi - (not a[hi - 1]), hi2 - (not b[hi2 - 1])
        if lo == hi or lo2 == hi2:
            continue
        mine, other = _ranked(a, lo, hi), _ranked(b, lo2, hi2)
        one, two = _once(mine), _once(other)
        anchors = sorted((k, two[x]) for x, k in one.items() if x in two) or sorted((k, other[x]) for x, k in mine.items() if x in other)
        chain = _rising(anchors)
        out += chain
        if chain:
            for (i, j), (i2, j2) in zip([(lo - 1, lo2 - 1), *chain], [*chain, (hi, hi2)]):
                if i + 1 < i2 and j + 1 < j2:
                    stack.append((i + 1, i2, j + 1, j2))
    return sorted(out)


def blocks_of(anchors: list[tuple[int, int, int]], a: list[int], b: list[int], words: list[int], moved_words: int) -> list[tuple[int, int]]:
    """Blocks [first, end) of lines of a, the later document: aligned lines, and moved passages that the anchors show.

    anchors are (line in a, line in b, number of lines), words the words of the lines of a.
    """
    taken = [(i, i + 1) for i, _ in patience(a, b)]
    there = {i for i, _ in taken}
    passage: list[int] | None = None
    for d, e, n in [*sorted(anchors, key=lambda x: (x[0] - x[1], x[0])), (0, 1 << 60, 0)]:
        if passage is not None and d - e == passage[2] and d <= passage[1]:
            passage[1] = max(passage[1], d + n)
            continue
        if passage is not None and not all(k in there or not a[k] for k in range(*passage[:2])) and sum(words[passage[0] : passage[1]]) >= moved_words:
            taken.append((passage[0], passage[1]))
        passage = [d, d + n, d - e]
    out: list[tuple[int, int]] = []
    for x, end in merged(taken):  # blank lines between two blocks go with them
        if out and not any(a[out[-1][1] : x]):
            out[-1] = (out[-1][0], end)
        else:
            out.append((x, end))
    return out


def merged(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(blocks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _key(docs: DataFrame, id_col: str, text: Column) -> list[Column]:
    """A document is a doc_id (null after all others) and a text; repeated rows are one document."""
    return [F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("hash")]


def common_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, moved_words: int = 50) -> DataFrame:
    """(doc, hash, blocks array<struct<first, end>>): the blocks of lines to delete from each document that has some."""
    text = text_of(docs, text_col)
    schema = pa.schema([("doc", pa.int64()), ("hash", pa.int64()), ("run", pa.int64()), ("at", pa.int32()), ("lines", pa.int32())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_dropped()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = [(d, h, *r) for d, h, t in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)) for r in runs_of(t, min_words)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 5, schema)], schema=schema)

    found = docs.select(*_key(docs, id_col, text), text.cast("binary").alias("text"))
    found = written(found.mapInArrow(runs, "doc long, hash long, run long, at int, lines int"), "runs")
    holders = found.groupBy("run").agg(F.min(F.struct("doc", "hash", "at")).alias("first"), F.max(F.struct("doc", "hash")).alias("last"), F.count("*").alias("n"))
    holders = holders.where("first.doc <> last.doc or first.hash <> last.hash").select("run", F.col("first.doc").alias("e_doc"), F.col("first.hash").alias("e_hash"), F.col("first.at").alias("e_at"), "n")
    holders = written(holders, "holders")
    anchors = skew_join(found, holders, ["run"], F.xxhash64("doc", "hash")).where("doc <> e_doc or hash <> e_hash")
    pairs = written(anchors.groupBy("doc", "hash", "e_doc", "e_hash").agg(F.collect_set(F.struct("at", "e_at", "lines")).alias("anchors")), "pairs")
    sides = pairs.select("doc", "hash").union(pairs.select("e_doc", "e_hash")).distinct()
    line_schema = pa.schema([("l_doc", pa.int64()), ("l_hash", pa.int64()), ("codes", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_dropped()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lines = [[b" ".join(x.split()) for x in t.split(b"\n")] for t in part.column(2).to_pylist()]
                coded = [[xxhash.xxh64_intdigest(x) >> 1 if x else 0 for x in some] for some in lines]
                sizes = [[x.count(b" ") + 1 if x else 0 for x in some] for some in lines]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, f.type) for c, f in zip((coded, sizes), list(line_schema)[2:]))], schema=line_schema)

    # codes before the join, so that no text is shuffled
    coded = docs.select(*_key(docs, id_col, text), text.cast("binary").alias("text")).mapInArrow(codes, "l_doc long, l_hash long, codes array<long>, words array<int>").toDF("doc", "hash", "codes", "words")
    lines = written(coded.join(sides, ["doc", "hash"]).dropDuplicates(["doc", "hash"]), "lines")
    earlier = lines.select(F.col("doc").alias("e_doc"), F.col("hash").alias("e_hash"), F.col("codes").alias("b"))
    sizes = pairs.groupBy("e_doc", "e_hash").agg(F.count("*").alias("n"))
    both = pairs.join(lines.withColumnRenamed("codes", "a"), ["doc", "hash"])
    both = skew_join(both, earlier.join(sizes, ["e_doc", "e_hash"]), ["e_doc", "e_hash"], F.xxhash64("doc", "hash")).select("doc", "hash", "anchors", "a", "b", "words")
    ddl = "doc long, hash long, blocks array<struct<first: int, end: int>>"
    result = pa.schema([("doc", pa.int64()), ("hash", pa.int64()), ("blocks", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_dropped()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                blocks = []
                for some, a, b, words in zip(*(part.column(k).to_pylist() for k in (2, 3, 4, 5))):
                    blocks.append([{"first": x, "end": y} for x, y in blocks_of([(s["at"], s["e_at"], s["lines"]) for s in some], a, b, words, moved_words)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blocks, result.field(2).type)], schema=result)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [[{"first": x, "end": y} for x, y in merged([(s["first"], s["end"]) for s in some])] for some in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, result.field(2).type)], schema=result)

    every = both.mapInArrow(align, ddl).where(F.size("blocks") > 0).groupBy("doc", "hash").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))
    return every.mapInArrow(joined, ddl)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, moved_words: int = 50, removed_col: str = "lines_removed") -> DataFrame:
    """docs, with its columns, and texts without the lines that an alignment pairs with an earlier document; removed_col is added.

    Documents are ordered by doc_id, null after all others; of one doc_id by a hash of the text. Lines that are
    equal but for white space are common. Documents are aligned if they share a run of `min_words` words; what
    others share stays, and so do repeats within one document and passages under `moved_words` words that cross the
    alignment. Repeated rows (same id and text) are one document and stay alike. A document of which all is
    copied has an empty text; null texts stay null. Empty tables give an empty result. An own column of the name
    removed_col is replaced.
    """
    with small_batches(docs.sparkSession):  # of whole texts and their lines
        blocks = written(common_blocks(docs, id_col, text_col, min_words, moved_words), "blocks")
    blocks = small(blocks, F.size("blocks") + 3).select(F.col("doc").alias("cut_doc"), F.col("hash").alias("cut_hash"), "blocks")
    doc, digest = (c for c in _key(docs, id_col, text_of(docs, text_col)))
    columns = [c for c in docs.columns if c != removed_col]
    rows = docs.select(F.struct(*(docs[c].alias(f"c{k}") for k, c in enumerate(columns))).alias("kept"), doc, digest)
    joined = rows.join(blocks, (rows.doc == blocks.cut_doc) & (rows.hash == blocks.cut_hash), "left")
    text = F.col(f"kept.c{columns.index(text_col)}")
    lines = F.split(text, "\n")
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("blocks", lambda b: F.array(b.first, b.end))), F.array(F.size(lines)))
    # edges are 0, first, end, first, end, ..., size: what lies between an even one and the next is kept
    kept = F.transform(F.sequence(F.lit(0), F.size("blocks")), lambda k: F.slice(F.col("lines"), F.get(F.col("edges"), 2 * k) + 1, F.get(F.col("edges"), 2 * k + 1) - F.get(F.col("edges"), 2 * k)))
    cut = joined.withColumn("lines", F.when(F.col("blocks").isNotNull(), lines)).withColumn("edges", F.when(F.col("blocks").isNotNull(), edges))
    cut = cut.withColumn("new_text", F.when(F.col("blocks").isNotNull(), F.array_join(F.flatten(kept), "\n")).otherwise(text))
    removed = F.coalesce(F.aggregate("blocks", F.lit(0), lambda a, b: a + b.end - b.first), F.lit(0)).cast("long")
    return cut.select(*(F.col("new_text" if c == text_col else f"kept.c{k}").alias(c) for k, c in enumerate(columns)), removed.alias(removed_col))
