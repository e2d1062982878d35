"""A training corpus from raw documents: stages that each write their rows and read what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, linededup, quality, simhash
from docloom.llm.common import collected, discard, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels`, accepts; null texts are judged as empty ones.

    Repeated rows are judged alike, an empty table stays empty, and columns of any name are kept as they are.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in an earlier one; n_chars, if there is one, follows the text.

    Null texts stay null, repeated rows are cut alike, an empty table stays empty; own columns of any name are kept.
    """
    count = next(c for c in map("lines_removed_{}".format, range(len(docs.columns) + 1)) if c not in docs.columns)
    cut = linededup.deduplicated(docs, removed_col=count)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the least doc_id; of repeated rows one. Null and blank texts are one group."""
    return simhash.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of `benchmark`; null and empty texts leak nothing.

    Repeated rows of a leaking text all go, an empty table stays empty, and columns of any name are kept as they are.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded, n_tokens), one row per row; other columns are left out. A null text has no ids."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_documents),
    ("decontamination", remove_benchmark),
    ("bpe", encode),
]

#: The classifier, the fingerprints and the encoder have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables of a stage are deleted once its result is written; only what the last one reads stays."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with collected() as made:
            docs = written(stage(spark, docs, sf_dir), "stage")
        discard(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
