"""From raw documents to token ids: quality, line dedup, near-duplicate documents, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents. run() writes each result as Parquet and reads it again for the next, so a lost executor costs one stage at most.
What a stage wrote on its way goes once another one starts on rows that don't come from it.

Defined results: rows with a null id or text pass as the stages' docstrings say (an id-less row is scored, deduplicated by
lines, kept by the near-duplicate stage, mixed and encoded; a null text scores as an empty one and has no tokens); equal rows
leave one where near-duplicates go; ties are settled by ids, then hashes; an empty table makes an empty one; texts are worked
on whole; other columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import bpe, linededup, mixing, ngram, quality
from broadsheet.llm.common import collected, durable, forget, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[DataFrame] = []


def _tidy(stage: Stage) -> Stage:
    """The stage, which first deletes what earlier ones wrote on their way, where its docs don't read it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reads = docs.inputFiles()
        for old in list(_left):
            if old.sparkSession._jsparkSession.sparkContext().isStopped():
                _left.remove(old)
            elif not any(old._durable_path in x for x in reads):
                forget(old)
                _left.remove(old)
        with collected() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


@_tidy
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels that are not held out."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


@_tidy
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that come again."""
    return linededup.dedup_lines(docs)


@_tidy
def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram.keep_one(docs)


@_tidy
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for each epoch of a document."""
    return mixing.mix_documents(docs)


@_tidy
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their number, and a digest of the bytes that decode from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_documents(docs.select("doc_id", "source", "text"), path, keep_text=False)
    return out.withColumns({"n_tokens": F.size("ids").cast("long"), "decoded_sha256": F.sha2(bpe.decode(F.col("ids"), path), 256)})


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("n-gram Jaccard join", ngram_stage), ("mixing sources", mixing_stage), ("byte-level BPE", bpe_stage)]

#: The classifier's decisions are not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            forget(before)
        before = docs
    return docs
