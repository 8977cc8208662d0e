"""The corpus pipeline: language ID, exact dedup, near-duplicate dedup, benchmark decontamination, tokenisation.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next stage's docs. All but the last return the columns
of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docspark.llm import bpe, contamination, exact_dedup, jaccard, language
from docspark.llm.common import table, written


#: Rows that go to a Python worker at once: at a few kB a text, Spark's 10,000 are tens of MB in the JVM and in the worker, for each task.
BATCH_ROWS = 2_000


def _bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit for Arrow batches to BATCH_ROWS; a lower one stays. It changes no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts that are null or have no letter go. The filters are fitted on docs themselves."""
    _bounded_batches(spark)
    labelled = docs.where("doc_id IS NOT NULL").where(~language.held_out("doc_id"))
    told = language.identify(docs, language.train(labelled), lang_col="__language", score_col="__language_score")
    return told.where("__language <> 'und'").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard 0.8), the one with the smallest id."""
    _bounded_batches(spark)
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (0.8 of its five-word shingles)."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the token ids of the whole text, and their number."""
    _bounded_batches(spark)
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.selectExpr("*", "cast(size(ids) AS bigint) AS n_tokens")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", without_benchmark),
    ("bpe_tokens", tokenised),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: SQL has no byte-level BPE and no language filters; a brute-force version in tests/llm holds the rows.
ORACLE_SQL = None
