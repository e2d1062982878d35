from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.operators import convert


def test_a_slice_has_few_rows_and_few_bytes():
    texts = pa.array([None, "x" * (convert.SLICE_BYTES * 2), "y", *["z" * (convert.SLICE_BYTES // 4)] * 6, *[""] * 1000])
    found = list(convert._slices((texts, pa.array(range(len(texts))))))
    assert [at for at, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) == len(texts)
    sizes = [sum(len(t or "") for t in texts.slice(at, n).to_pylist()) for at, n in found]
    assert all(n <= convert.SLICE_ROWS and (size <= convert.SLICE_BYTES or n == 1) for (_, n), size in zip(found, sizes))


def test_results_of_a_large_batch_go_on_in_slices(spark):
    """Rows that are read at once: each result says how many the worker held when it was made."""
    held = []

    @contextmanager
    def emptied():
        held.clear()
        yield

    one = convert.each_row(lambda k: held.append(k) or len(held), "int", emptied)
    most = spark.range(0, 3000, 1, 1).select(one("id").alias("n")).agg(F.max("n")).first()[0]
    assert most == convert.SLICE_ROWS


def test_what_makes_a_file_runs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def page(k):
        made.add(1)
        return b"<p>%d</p>" % k

    files = spark.range(40).select(F.concat("id", F.lit(".html")).alias("filename"), convert.each_row(page, "binary")("id").alias("content"))
    assert len(convert.converted(files).select("markdown").collect()) == made.value == 40


def test_a_large_scan_is_dealt_to_more_tasks_than_cores(spark, tmp_path):
    spark.range(0, 3_000_000, 1, 1).select(F.xxhash64("id").alias("k")).write.parquet(str(tmp_path / "t"))
    assert convert.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
