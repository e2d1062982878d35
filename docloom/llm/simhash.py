"""SimHash near-duplicates by a binary trie self-join.

Documents with one fingerprint become one node. Fingerprints are cut into blocks; two that differ in
at most `budget` bits agree on at least `blocks - budget` whole blocks, so each node goes to one trie for
each choice of that many blocks. A trie's self-join walks node pairs together and prunes a pair once its
paths differ in more bits than the budget. A trie with very many nodes is dealt out in bounded slices, so no
task holds an unbounded group. A task returns a link from each linked node to the first of its component there,
never all pairs; alternating star rounds join those links into components.

Copies with more changes than few bits can show are proposed by the same join with a wider budget: their tries are
dealt by min-hashes of the shingles instead of fingerprint blocks, and pairs are checked loosely by a sketch. The
sets of shingles of what was proposed together are then compared exactly, by the same join once more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import map_texts, skew_join, small, text_of, written
from docloom.llm.components import components
from docloom.llm.trie import link_within

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
OFFSETS = np.arange(8, dtype=np.int64) * 256


def simhash(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of UTF-8 text; 0 if it has no word."""
    words = text.lower().split()  # on bytes: A-Z, and the white space \x20 \x09-\x0D
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    hashed = xxhash.xxh64_intdigest
    codes = np.fromiter((hashed(s, seed) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(codes), 1 << 16):
        values = codes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + OFFSETS
        seen = np.bincount(values.ravel(), minlength=2048).reshape(8, 256)
        counts += (seen @ BITS).ravel()
    return int(np.packbits(2 * counts > len(codes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp is the fingerprint's 64 bits as a signed long. A null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def one(ids, texts):
        return ids, np.array([simhash(t, width) for t in texts], np.uint64).view(np.int64)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).cast("binary").alias("text"))
    return map_texts(rows, one, schema, "doc_id long, fp long")


def _block_keys(fp: Column, budget: int, blocks: int) -> Column:
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - budget)):
        key, bits = F.lit(n).cast("long"), 0
        for k in chosen:
            size = edges[k + 1] - edges[k]
            part = F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << size) - 1))
            key, bits = F.shiftleft(key, size).bitwiseOR(part), bits + size
        if bits > 54:
            raise ValueError("too many blocks for the budget")
        keys.append(key)
    return F.array(*keys)


def _join_tiles(dealt: DataFrame, budget: int, similarity: float | None, exact: bool = False) -> DataFrame:
    """dealt (tile, key, fp, rep, lead, sketch) -> (key, a, b, led): a link from each linked node to the first of its component in the tile.

    led says that the component has the tile's leader. Tiles follow one another in a task, some at a time.
    With `exact`, sketch is the set of shingles itself.
    """
    # order by unsigned value, as in the trie: the sign bit goes first
    dealt = dealt.select("tile", "key", "fp", "rep", "lead", "sketch").repartition("tile").sortWithinPartitions("tile", F.expr("fp < 0"), "fp")
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("led", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        most, step = (100_000, 50_000) if not exact else (10_000, 1000)

        def joined(last: bool):
            nonlocal held, rows
            whole = pa.Table.from_batches(held)
            tile = whole.column("tile").to_numpy()
            cut = len(tile) if last else int(np.searchsorted(tile, tile[-1]))  # a tile that may go on waits
            held, rows = [] if last else whole.slice(cut).combine_chunks().to_batches(), 0 if last else len(tile) - cut
            if not cut:
                return None
            whole = whole.slice(0, cut)
            tile, key, fp, rep, lead = (whole.column(c).to_numpy() for c in ("tile", "key", "fp", "rep", "lead"))
            check = None
            if exact:
                check = _ExactCheck(whole.column("sketch").to_pylist(), similarity)
            elif similarity is not None:
                sketch = np.frombuffer(b"".join(whole.column("sketch").to_pylist()), np.uint8).reshape(cut, -1)
                check = lambda i, j: alike(sketch, i, j) >= similarity
            label = link_within(tile, fp.view(np.uint64), budget, check)
            least, led = np.full(cut, np.iinfo(np.int64).max), np.zeros(cut, bool)
            np.minimum.at(least, label, rep)
            np.logical_or.at(led, label, lead)
            root, led = least[label], led[label]
            out = (root != rep) | (led & ~lead)
            return pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, rep, root, led)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                rows += held[-1].num_rows
                if (rows >= most or exact and sum(b.nbytes for b in held) > HELD_BYTES) and (out := joined(False)) is not None:
                    yield out
        if rows and (out := joined(True)) is not None:
            yield out

    return dealt.mapInArrow(run, "key long, a long, b long, led boolean")


def _leaders(hot: DataFrame) -> DataFrame:
    """(key, lead_rep): of each key's nodes the one nearest to the majority of each bit, the least of equals."""
    sums = hot.groupBy("key").agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))).alias(f"b{k}") for k in range(64)))
    center = F.lit(0).cast("long")
    for k in range(64):
        center = center.bitwiseOR(F.when(2 * F.col(f"b{k}") > F.col("n"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    near = hot.join(sums.select("key", center.alias("center")), "key")
    best = F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("center"))).alias("d"), "rep")).alias("best")
    return near.groupBy("key").agg(best).select("key", F.col("best.rep").alias("lead_rep"))


def _finer_keys(fp: Column, budget: int, blocks: int) -> Column:
    """As _block_keys, of the fingerprint turned by half a block: other bits than those that a trie's nodes share."""
    half = 32 // blocks
    return _block_keys(F.shiftleft(fp, half).bitwiseOR(F.shiftrightunsigned(fp, 64 - half)), budget, blocks)


def links(keyed: DataFrame, budget: int, slice_rows: int = 4000, similarity: float | None = None, exact: bool = False, finer: Column | None = None) -> DataFrame:
    """keyed (key, fp, rep, sketch): nodes by the tries that they belong to -> (a, b): reps to link.

    Nodes of one trie link at `budget` or fewer differing bits (and likeness of their sketches of at least
    `similarity`). The pairs span every component of that relation but are not all its pairs. `slice_rows` bounds
    what one task holds of a trie. A larger trie is cut into slices, each of which also gets the trie's leader,
    the node amid the others. Nodes that a slice connects with the leader need no comparison with one another;
    the rest are dealt with all nodes to tries by the keys `finer`, an array of which linked nodes share one; without
    it, or in such a trie that is large again, they are compared with all nodes, slice by slice. With `exact`, sketch
    is the set of shingles as 64-bit codes, and slices are bounded in bytes too.
    """
    share = F.lit(1.0 / slice_rows)
    if exact:
        share = F.greatest(share, F.length("sketch") / F.lit(float(SLICE_BYTES)))
    slices = lambda: F.ceil(F.round(F.sum(share), 6)).cast("int")
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("count"), slices().alias("slices")).where("count > 1").select("key", F.greatest("slices", F.lit(1)).alias("slices")), "tries")
    small = keyed.join(sizes.where("slices = 1"), "key").select(F.xxhash64("key").alias("tile"), "key", "fp", "rep", F.lit(False).alias("lead"), "sketch")
    found = _join_tiles(small, budget, similarity, exact).select("a", "b")
    if not sizes.where("slices > 1").take(1):
        return found
    own = F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")
    hot = written(keyed.join(sizes.where("slices > 1"), "key").withColumn("own", own), "hot")
    hot = hot.join(_leaders(hot), "key").withColumn("lead", F.col("rep") == F.col("lead_rep"))
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    first = hot.withColumn("slice", F.explode(F.when(F.col("lead"), every).otherwise(F.array("own")))).withColumn("tile", F.xxhash64("key", "slice"))
    led = written(_join_tiles(first, budget, similarity, exact), "led")
    done = led.where("led").select("key", F.col("a").alias("rep")).distinct()
    rest = written(hot.where("not lead").join(done, ["key", "rep"], "left_anti"), "rest")
    found = found.union(led.select("a", "b"))
    if finer is not None:
        if not rest.take(1):
            return found.where("a <> b")
        fine = lambda df: df.select("fp", "rep", "sketch", F.explode(F.transform(finer, lambda k: F.xxhash64("key", k))).alias("key"))
        keys = fine(rest).select("key").distinct()
        again = written(fine(hot).join(keys, "key", "left_semi").select("key", "fp", "rep", "sketch"), "finer")
        return found.union(links(again, budget, slice_rows, similarity, exact)).where("a <> b")
    parts = rest.groupBy("key").agg(F.greatest(slices(), F.lit(1)).alias("parts"))
    mine = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    tile = lambda part, slice_: F.xxhash64("key", part, slice_)
    left = rest.join(parts, "key").withColumn("slice", F.explode(every)).withColumn("tile", tile(mine, F.col("slice")))
    right = hot.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("tile", tile(F.col("part"), F.col("own")))
    columns = ["tile", "key", "fp", "rep", "lead", "sketch"]
    tiles = left.select(columns).union(right.select(columns)).dropDuplicates(["tile", "rep"])
    return found.union(_join_tiles(tiles, budget, similarity, exact).select("a", "b")).where("a <> b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 3, blocks: int = 5, slice_rows: int = 4000) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links): one row per row of docs.

    Fingerprints link at `budget` or fewer differing bits; component_id is the smallest doc_id reachable,
    the row's own included; n_links counts the rows of the same fingerprint, the row's own included.
    Null or blank texts have fingerprint zero and link like any other. A row with a null doc_id keeps its
    fingerprint, gets a null component_id and links nothing. Repeated rows are all returned. An empty table
    gives an empty result. Other columns of docs are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_links")), "nodes")
    keyed = nodes.select("fp", "rep", F.lit(None).cast("binary").alias("sketch"), F.explode(_block_keys(F.col("fp"), budget, blocks)).alias("key"))
    roots = components(links(keyed, budget, slice_rows, finer=_finer_keys(F.col("fp"), budget, blocks)))
    named = nodes.join(roots, nodes.rep == roots.node, "left").select(F.col("fp").alias("node_fp"), F.coalesce("root", "rep").alias("component_id"), "n_links")
    known = fps.doc_id.isNotNull() & (fps.fp == named.node_fp)
    return fps.join(named, known, "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


BANDS, ROWS, BINS = 16, 3, 128
HELD_BYTES, SLICE_BYTES = 64_000_000, 16_000_000
#: A slice of whole sets has fewer rows, as each pair may be compared code by code.
SET_ROWS = 256
_ODD = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def alike(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Estimated similarity of the shingle sets of rows i and j: the share of equal bins among those with a shingle."""
    out = np.empty(len(i))
    for at in range(0, len(i), 50_000):
        a, b = sketch[i[at : at + 50_000]], sketch[j[at : at + 50_000]]
        used = (a != 0) | (b != 0)
        out[at : at + 50_000] = ((a == b) & used).sum(1) / np.maximum(used.sum(1), 1)
    return out


class _ExactCheck:
    """Which pairs of sets of codes share `similarity` of their union. Pairs that earlier ones connect are passed over."""

    def __init__(self, sets: list[bytes], similarity: float):
        self.sets = [np.frombuffer(s, np.uint64) for s in sets]
        self.sizes = np.array([len(s) for s in self.sets])
        self.similarity = similarity
        self.root = list(range(len(sets)))
        self.bits = np.zeros((len(sets), 2048), bool)
        for k, s in enumerate(self.sets):
            self.bits[k, (s >> np.uint64(53)).astype(np.int64)] = True
        self.bits = np.packbits(self.bits, axis=1).view(np.uint64)

    def _find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = k = self.root[self.root[k]]
        return k

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 20_000):
            a, b = i[at : at + 20_000], j[at : at + 20_000]
            x, y = self.bits[a], self.bits[b]
            # a bit that only one set has is a code that the other lacks
            most = np.minimum(self.sizes[a] - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), self.sizes[b] - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
            may = most >= self.similarity * (self.sizes[a] + self.sizes[b] - most) - 1e-9
            for k in np.flatnonzero(may).tolist():
                p, q = int(a[k]), int(b[k])
                if (root := self._find(p)) == (other := self._find(q)):
                    continue
                both = np.sort(np.concatenate([self.sets[p], self.sets[q]]))
                shared = int((both[1:] == both[:-1]).sum())
                if shared >= self.similarity * (len(both) - shared) - 1e-9:
                    out[at + k] = True
                    self.root[max(root, other)] = min(root, other)
        return out


def shingle_codes(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct 64-bit codes of a text's shingles; a text of fewer words is one shingle."""
    words = text.lower().split()
    shingles = {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 7) for s in shingles), np.uint64, len(shingles)))


def copy_marks(text: bytes, width: int) -> tuple[int, int, list[int], bytes]:
    """(hash, fingerprint, min-hash keys, sketch) of the set of a text's shingles."""
    codes = shingle_codes(text, width)
    counts, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(codes), 1 << 14):
        part = codes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        mixed = part[:, None] * _ODD
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(0))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), n) - (1 << 63) for n, row in enumerate(least.reshape(BANDS, ROWS))]
    best = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(best, (codes >> np.uint64(57)).astype(np.int64), codes & np.uint64((1 << 57) - 1))
    sketch = np.where(best == np.iinfo(np.uint64).max, 0, best % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return xxhash.xxh64_intdigest(codes.tobytes()) - (1 << 63), int(np.packbits(2 * counts > len(codes), bitorder="little").view("<u8")[0]) - (1 << 63), keys, sketch.tobytes()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, budget: int = 24, loose: float = 0.6, slice_rows: int = 500) -> DataFrame:
    """The rows of docs, with their columns, of which no near copy comes earlier: one of each group of near copies.

    Near copies share `similarity` of their distinct shingles of `width` words, exactly counted; groups are the
    connected components of that relation. Pairs are proposed by min-hash keys, `budget` bits and a sketch's estimate
    of `loose`, and all sets of shingles that proposals connect are compared. Of a group the row with the
    least doc_id stays (null after all others), of equal ids the one with the least text hash, of repeated rows
    one. Texts of fewer words are one shingle; null and blank texts are all copies of each other. An empty table
    gives an empty result.
    """
    text = text_of(docs, text_col)
    key = [F.coalesce(docs[id_col].cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("hash")]
    schema = pa.schema([("doc", pa.int64()), ("hash", pa.int64()), ("rep", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                marks = [copy_marks(t, width) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, f.type) for c, f in zip(zip(*marks), list(schema)[2:]))], schema=schema)

    marked = docs.select(*key, text.cast("binary").alias("text")).mapInArrow(run, "doc long, hash long, rep long, fp long, keys array<long>, sketch binary")
    marked = written(marked, "marks")
    nodes = written(marked.groupBy("rep").agg(F.min_by(F.struct("fp", "keys", "sketch", "doc", "hash"), F.struct("doc", "hash")).alias("m")).select("rep", "m.*"), "nodes")
    # keys that one node alone has go before sketches are carried along
    pairs = nodes.select(F.explode("keys").alias("key"), "rep")
    shared = pairs.join(pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "left_semi")
    keyed = written(shared.join(nodes.select("rep", "fp", "sketch"), "rep").select("key", "fp", "rep", "sketch"), "keyed")
    proposed = components(links(keyed, budget, slice_rows, loose))
    proposed = written(proposed.select("node", "root").union(proposed.select(F.col("root").alias("node"), "root")).distinct(), "proposed")
    counted = written(marked.groupBy("doc", "hash", "rep").agg(F.count("*").alias("copies")), "counted")
    members = nodes.join(proposed, F.col("rep") == F.col("node")).select("doc", "hash", F.col("root").alias("key"), "rep")
    members = written(members.join(counted.select("doc", "hash", "copies"), ["doc", "hash"]).withColumnsRenamed({"doc": "m_doc", "hash": "m_hash"}), "members")
    texts = docs.select(*key, text.cast("binary").alias("text")).join(small(members), (F.col("doc") == F.col("m_doc")) & (F.col("hash") == F.col("m_hash")))
    texts = texts.where("copies = 1").union(texts.where("copies > 1").dropDuplicates(["key", "rep"]))  # repeated rows have one set
    set_schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("rep", pa.int64()), ("sketch", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                codes = pa.array([shingle_codes(t, width).tobytes() for t in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(1), codes], schema=set_schema)

    # the set's hash stands for the fingerprint, so that 64 bits compare all of a component
    whole = written(texts.select("key", "rep", "text").mapInArrow(sets, "key long, fp long, rep long, sketch binary"), "sets")
    roots = components(links(whole, 64, min(slice_rows, SET_ROWS), similarity, exact=True))
    classes = counted.join(roots, F.col("rep") == F.col("node"), "left").select("doc", "hash", "copies", F.coalesce("root", "rep").alias("root"))
    classes = written(classes, "classes")
    stays = written(classes.groupBy("root").agg(F.min(F.struct("doc", "hash")).alias("s"), F.count("*").alias("n")), "stays")
    judged = skew_join(classes, stays, ["root"], F.xxhash64("doc", "hash")).select(F.col("doc").alias("k_doc"), F.col("hash").alias("k_hash"), "copies", (F.struct("doc", "hash") == F.col("s")).alias("stays"))
    special = small(written(judged.where("not stays or copies > 1"), "special"))  # all other rows pass without a shuffle
    rows = docs.select(F.struct(*(docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns))).alias("kept"), *key)
    same = (F.col("doc") == F.col("k_doc")) & (F.col("hash") == F.col("k_hash"))
    again = rows.join(special.where("stays"), same, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("doc", "hash").orderBy("doc"))).where("n = 1").drop("n")
    rows = rows.join(special, same, "left_anti").union(again)
    return rows.select(*(F.col(f"kept.c{k}").alias(c) for k, c in enumerate(docs.columns)))
