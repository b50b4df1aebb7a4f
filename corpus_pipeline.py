"""A corpus pipeline of five stages: quality classifier, exact dedup, n-gram Jaccard join, source mixing, packing.

Each stage works on all rows that its predecessor kept. All but the last return the columns of documents, whatever
others come with them and whatever they are called. A null text counts as an empty one everywhere; empty and very long
texts, ties and repeated rows are handled as each stage says; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import common, exact_dedup, jaccard, mixing, packing, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go.

    Null and empty texts are scored as texts without words; repeated rows stay or go together.
    """
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays.

    Null and empty texts are equal. Of rows that share that id the first read stays; null ids come after all others.
    """
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles with a Jaccard similarity of 0.8 or more connect, the one with the
    smallest doc_id stays.

    Null texts and those without words link with nothing. Repeated rows are one group, of which the first read stays.
    """
    return jaccard.keep_first(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as the mix takes it, none to two times.

    Null and empty texts are never taken. Repeated rows have copies each of their own; a null source is a source.
    """
    return mixing.take_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a document's copies and repeated rows are packed each on their own.

    A null or empty text is its end id alone; a very long one has sequences of its own.
    """
    return packing.harmonic_pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: The classifier's weights, the tree-merge and the tokenizer can't be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
        if before is not None:
            common.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
