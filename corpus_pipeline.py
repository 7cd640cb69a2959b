"""The corpus pipeline: language, toxicity, near-duplicates, decontamination, packing.

Every stage takes all rows that the one before kept, and its decision removes rows; the last one
returns the packed pieces. Stages read their inputs as Spark tables below `sf_dir` and leave no
state but files in the shared folder.

For every stage: an empty table gives an empty result; all columns of the input are returned but by
the last stage, whatever their names; texts are read whole, however long; rows without an id are
documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontamination, language_id, near_copies, packing, toxicity
from lectern.llm.shared import given_back, small_batches, written
from lectern.sources.tables import load


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or between two languages, go: null and empty ones, and ties between two codewords. Repeated rows fare alike."""
    return language_id.keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts predicted to be toxic (a score of 0.5 or more) go; null and empty texts stay, repeated rows fare alike."""
    kept = toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))
    given_back()  # what the driver trained with
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles or more) the document of the smallest id stays.

    Null and empty texts are one group; of equal rows one stays; pairs at exactly 0.8 are linked.
    """
    return near_copies.keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (0.8 of its shingles or more) go; null and empty texts hold none, rows of one id are one document."""
    return decontamination.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents, packed into sequences; null and empty texts are an end id alone, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("packing", packed)]

#: The classifiers and the packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None

#: Texts that a worker is handed at once; what an executor's workers hold of a batch adds to what the stages before left in its heap.
ROWS = toxicity.BATCH_ROWS


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = load(spark, sf_dir, "documents")
    with small_batches(spark, ROWS):
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
