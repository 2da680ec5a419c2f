"""Corpus pipeline over documents: quality rules, SimHash near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``. All but the last return the
columns of documents, other columns that come along included; the last returns the pieces of training
sequences. An empty table goes through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import common, mixing, packing, quality, simhash, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their language's and source's thresholds.

    Null and empty texts fail; a null language or source is a group; repeated rows are judged one by one.
    """
    return quality.keep(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates.

    Null and empty texts are one group; of repeated rows, and of copies without an id, one stays.
    """
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has.

    Null texts stay null; a text that is all repeats becomes empty; repeated rows count as one document.
    """
    return substring.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training rows in order: a document as often as its source's target takes it.

    Null and empty texts have no words and give no rows; a null source is a source; repeated rows count singly.
    """
    return mixing.curriculum(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. Null and empty texts are one id; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Fingerprints by XXH64 and byte-level BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``; each stage's result is written before the next reads it."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, common.cut(stage(spark, docs, sf_dir))
        common.forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
