"""From raw documents to packed token sequences, in five stages.

Each stage takes what the stage before kept and returns the columns of documents, the last one pieces of
sequences.  Every stage takes null and repeated doc_ids, null, empty and very long texts, ties, columns of any name beside those of
documents, and empty tables (which give empty results), each as its operator states.  Between stages the rows are written to the shared folder, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayframe.llm import jaccard_join, line_dedup, mixing, packing, quality
from wayframe.llm.common import settle, table
from wayframe.sources.shared import clear, made


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie beyond a fence of their language and source go."""
    return quality.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but their first; a document that loses every line goes with them."""
    return line_dedup.keep_rest(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 % of their five-word shingles, directly or through others, the first stays."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

#: Token ids are beyond SQL; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = made(spark)
        docs = settle(stage(spark, docs, sf_dir), name)
        # The result is written last; what the stage wrote on the way, and what it read, is done with.
        *steps, result = [p for p in made(spark) if p not in before]
        clear(spark, [*steps, *read])
        read = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
