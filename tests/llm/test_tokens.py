import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docloom.llm import bpe, tokenfile
from docloom.llm.common import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", "  \n", "The and attion", "A\x00b", "<|startoftext|> hi <|endoftext|>x<|ENDOFTEXT|>", "é é ﬁ İSTANBUL ΣΑΣ",
    "日本語 text 123 4567", "it's don'T we'LL ''s", "​zero nbsp", "a" * 3000, "🙂👍🏽", "x﻿y  z", "The and attion", "word, " * 5000, "ab\x1ccd\x85ef",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 - k, t, "x", "y") for k, t in enumerate(TEXTS)] + [(None, "no id", "x", "y"), (97, "The and attion", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_encode_as_the_library(docs, library):
    got = bpe.encode(docs, PATH).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids, texts[r.doc_id][:40]
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_digests(docs, library):
    got = {r.doc_id: r for r in bpe.digests(bpe.encode(docs, PATH)).collect()}
    ids = library.encode(TEXTS[3], add_special_tokens=False).ids
    assert got[97].n_tokens == len(ids)
    assert got[97].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[97].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert got[100].n_tokens == 0 and got[100].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_files(spark, docs, library):
    path = scratch(spark, "test")
    tokenfile.write(docs, path, PATH)
    got = tokenfile.digests(tokenfile.read(spark, path)).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert len(got) == len(rows)
    found = sorted(got, key=lambda r: r.start)
    at = 0
    for r, w in zip(found, rows):
        ids = [*library.encode(w.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (w.doc_id, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_selective_reads(spark, docs):
    path = scratch(spark, "test")
    tokenfile.write(docs, path, PATH)
    meta = tokenfile.metadata(spark, path, 90, 95)
    plan = meta._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[1].splitlines()[0]
    assert sorted(r.doc_id for r in meta.collect()) == [90, 91, 92, 93, 94, 95]


def test_layout_of_the_files(spark, tmp_path):
    """Dictionary-coded ids, delta-coded counters, page indexes, and row groups that a range of doc_id skips."""
    import pyarrow.parquet as pq

    many = spark.range(0, 6000).selectExpr("id as doc_id", "concat(repeat('the house of stone ', 40), id) as text").repartition(1)
    path = f"file://{tmp_path}/files"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tokenfile.write(many, path, PATH, row_group_mb=0, page_kb=4, page_rows=100)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    files = sorted((tmp_path / "files").glob("*.parquet"))
    groups = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {c.path_in_schema: c for c in map(meta.row_group(g).column, range(meta.num_columns))}
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert ids.has_dictionary_page and any("DICTIONARY" in e for e in ids.encodings)
            for name in ("doc_id", "local_start", "n_tokens"):
                assert columns[name].has_offset_index and columns[name].has_column_index
            for name in ("doc_id", "local_start"):
                assert "DELTA_BINARY_PACKED" in columns[name].encodings and not columns[name].has_dictionary_page
            groups.append((columns["doc_id"].statistics.min, columns["doc_id"].statistics.max))
    assert len(groups) > 2 and all(a[1] < b[0] for a, b in zip(groups, groups[1:]))
    wanted = tokenfile.read(spark, path, 10, 20, ("doc_id", "n_tokens", "ids"))
    assert wanted.count() == 11
    read = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in read and "GreaterThanOrEqual(doc_id,10)" in read


def test_empty_table(spark, docs):
    none = docs.limit(0)
    assert bpe.encode(none, PATH).count() == 0
    path = scratch(spark, "test")
    tokenfile.write(none, path, PATH)
    assert tokenfile.read(spark, path).count() == 0
