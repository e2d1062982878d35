"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

A mask picks some of a few consecutive words and ignores the rest. Texts and benchmark items are hashed under
each mask at each position, and equal hashes are hits. Around a hit the two word sequences are compared: a leak
is a stretch of `window` words that differs from the item in at most `window - need` words. Any such stretch
contains a hit, as the masks below are chosen so that each way to spoil 3 of 15 words leaves one of them whole.
An item of fewer words than the window leaks only as a whole and unchanged.

Texts are looked at in parts of PART positions, so that a hit carries the words around it and not a long text, and
items of one text are compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import small, text_of, words_of, written

MASKS = ("1111011", "11001000111", "11010110001")
WINDOW, NEED = 15, 12
#: Positions of a part of a text.
PART = 256
#: Up to so many seeds (of about 60 bytes) the benchmark is broadcast; beyond, seeds that a bitmap lets through are joined by shuffles.
MAX_BROADCAST = 500_000


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _parts(words: DataFrame, window: int, size: int = PART) -> DataFrame:
    """The rows of words, one for each `size` positions of h: h has the words of those and of a window around them.

    part is the number of the part, base the position of the first word of h, own the place in h of its first position.
    """
    around = window - 1
    base = lambda s: F.greatest(s - around, F.lit(0))
    cut = lambda s: F.struct((s / size).cast("int").alias("part"), base(s).alias("base"), (s - base(s)).alias("own"), F.slice("h", base(s) + 1, s - base(s) + size + around).alias("h"))
    # a lambda in the generator keeps it out of generated code, which would hold what all parts of a text give at once
    each = words.where(F.size("h") > 0).select("doc_id", "text_hash", F.explode(F.transform(F.sequence(F.lit(0), F.size("h") - 1, F.lit(size)), cut)).alias("p"))
    return each.select("doc_id", "text_hash", "p.*")


def _seeds(rows: DataFrame, masks: dict[int, str], h: str = "h", first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Each row once for each mask and position, from first to last: (mask, at, seed) besides its own columns."""
    at = F.col("at")
    each = [
        F.when(at + len(m) <= F.size(h), F.struct(F.lit(n).alias("mask"), F.xxhash64(F.lit(n), *(F.get(F.col(h), at + k) for k, c in enumerate(m) if c == "1")).alias("seed")))
        for n, m in masks.items()
    ]
    rows = rows.where(F.size(h) > 0).select("*", F.explode(F.sequence(F.lit(0) if first is None else first, F.size(h) - 1 if last is None else last)).alias("at"))
    return rows.select("*", F.explode(F.array(*each)).alias("s")).where("s is not null").select(*rows.columns, "s.mask", "s.seed")


def _may_hit(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows whose seed may be among those of `seeds`, by a bitmap of 2^26 bits; rows and columns stay as they are.

    The bitmap is broadcast as 1024 rows of 8 kB at any size; with very many seeds it only filters less.
    """
    slot = F.col("seed").bitwiseAND(F.lit((1 << 26) - 1))
    word, bit = F.shiftrightunsigned(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    words = seeds.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    every = rows.sparkSession.range(1 << 20).select(F.col("id").alias("word")).join(words, "word", "left")
    bitmap = every.groupBy(F.shiftrightunsigned("word", 10).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("w"))
    bitmap = written(bitmap.select("_part", F.col("w.bits").alias("_bits")), "bitmap")
    found = rows.withColumn("_part", F.shiftrightunsigned(slot, 16)).join(F.broadcast(bitmap), "_part")
    there = F.call_function("bit_get", F.get("_bits", word.bitwiseAND(F.lit(1023)).cast("int")), bit) == 1
    return found.where(there).drop("_part", "_bits")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, item, b): distinct items with the hashes of their words, item is one of those; items without a word are left out."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), _hashes(text_of(benchmark, text_col)).alias("b")).where(F.size("b") > 0)
    return items.withColumn("item", F.xxhash64("b")).dropDuplicates(["item_id", "item"])


def _verified(hits: DataFrame, window: int, need: int) -> DataFrame:
    """Adds (first, last) of the stretches around each hit that agree with the item; other hits go.

    A hit has the columns h, base, at of a part of the text and b, b_at of the item, and w, the window of its item.
    """
    back = F.least("at", "b_at", F.lit(window - 1))
    ahead = F.least(F.size("h") - F.col("at"), F.size("b") - F.col("b_at"), F.lit(window))
    same = F.zip_with(F.slice("h", F.col("at") - F.col("back") + 1, F.col("back") + F.col("ahead")), F.slice("b", F.col("b_at") - F.col("back") + 1, F.col("back") + F.col("ahead")), lambda x, y: (x == y).cast("int"))
    good = F.filter(
        F.when(F.size("same") >= F.col("w"), F.sequence(F.lit(0), F.size("same") - F.col("w"))).otherwise(F.array().cast("array<int>")),
        lambda k: F.aggregate(F.slice("same", k + 1, F.col("w")), F.lit(0), lambda a, x: a + x) >= F.when(F.col("w") < window, F.col("w")).otherwise(need),
    )
    found = hits.withColumn("back", back).withColumn("ahead", ahead).withColumn("same", same).withColumn("good", good).where(F.size("good") > 0)
    start = F.col("base") + F.col("at") - F.col("back")
    return found.withColumn("first", start + F.array_min("good")).withColumn("last", start + F.array_max("good") + F.col("w") - 1)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, need: int = NEED, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, text_hash, item_id, first_word, last_word): one row for each text and item that it leaks.

    first_word and last_word are the positions of the first and last word of the leaking stretches, from 0. Words
    are those between white space, A-Z lower-cased. Rows of one doc_id and text are one; null ids are kept; null
    texts and items are empty and leak nothing. Empty tables give an empty result. Other columns are not read.
    """
    found, items = _leaked(docs, benchmark, id_col, text_col, item_col, item_text_col, masks, window, need, max_broadcast)
    # an item_id may have several texts, and a text several items
    each = found.join(small(items.select("item_id", "item")), "item")
    return each.groupBy("doc_id", "text_hash", "item_id").agg(F.min("first").cast("long").alias("first_word"), F.max("last").cast("long").alias("last_word"))


def _leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, window: int = WINDOW, need: int = NEED, max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, item, first, last) of texts and the texts of items that they leak; and the items, see `_items`."""
    if any(len(m) > window or m[0] != "1" or m[-1] != "1" for m in masks):
        raise ValueError("masks begin and end with 1 and fit into the window")
    items = written(_items(benchmark, item_col, item_text_col), "items")
    texts = written(items.dropDuplicates(["item"]).select("item", "b"), "items")
    shorter = [r.n for r in texts.select(F.size("b").alias("n")).where(F.col("n") < window).distinct().collect()]
    every = dict(enumerate(masks)) | {1000 + n: "1" * n for n in shorter}
    right = ((F.size("b") >= window) & (F.col("mask") < 1000)) | ((F.col("mask") == F.size("b") + 1000) & (F.col("at") == 0))
    seeds = _seeds(texts, every, "b").where(right).select("item", "mask", "seed", F.col("at").alias("b_at"))
    few = texts.agg(F.coalesce(F.sum(F.size("b")), F.lit(0))).first()[0] * len(every) <= max_broadcast
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text_of(docs, text_col)).alias("text_hash"), text_of(docs, text_col).alias("text"))
    parts = lambda rows: _parts(rows.select("doc_id", "text_hash", _hashes(F.col("text")).alias("h")), window)
    placed = _seeds(parts(own), every, "h", F.col("own"), F.least(F.col("own") + PART, F.size("h")) - 1)
    if few:
        hits = placed.join(F.broadcast(seeds), ["mask", "seed"]).join(F.broadcast(texts), "item")
    else:  # what can't hit isn't shuffled, positions go through the shuffle without texts, and the parts of hits are fetched afterwards
        seeds = written(seeds, "seeds")
        placed = _may_hit(placed.select("doc_id", "text_hash", "part", "at", "mask", "seed"), seeds)
        hits = written(placed.join(seeds, ["mask", "seed"]).select("doc_id", "text_hash", "part", "at", "item", "b_at").distinct(), "hits")
        hit = _may_hit(own.withColumn("seed", F.col("text_hash")), hits.select(F.col("text_hash").alias("seed")))
        again = parts(hit).withColumnsRenamed({"doc_id": "d", "text_hash": "t", "part": "p"}).dropDuplicates(["d", "t", "p"])
        hits = hits.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("part") == F.col("p")))
        hits = hits.join(small(texts, F.size("b") + 1), "item")
    found = _verified(hits.withColumn("w", F.least(F.size("b"), F.lit(window))), window, need)
    return found.groupBy("doc_id", "text_hash", "item").agg(F.min("first").alias("first"), F.max("last").alias("last")), items


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, whose text leaks no benchmark item.

    Null and empty texts leak nothing and stay, and so do rows with a null id and repeated rows whose text is clean;
    repeated rows of a leaking text all go. Empty tables give docs as it is. Columns of docs may have any names.
    """
    bad = _leaked(docs, benchmark, id_col, text_col, **options)[0].select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    bad = small(written(bad, "leaks"))
    same = docs[id_col].cast("long").eqNullSafe(bad.leak_id) & (F.xxhash64(text_of(docs, text_col)) == bad.leak_hash)
    return docs.join(bad, same, "left_anti")
