"""A training corpus from documents: each stage works on all rows that the one before kept, written as Parquet between.

Near duplicates are documents that share five-word shingles at a similarity of 0.8 or more. The classifier, the
near-duplicate search and the tokens are beyond SQL; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symbolweave.llm import exact_dedup, minhash, mixing, packing, quality
from symbolweave.llm.common import save, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier, fitted on the labelled ones among them, rejects.

    A null or empty text gets the model's constant; without labels, or with labels of one class only, all rows score
    alike, and without any all stay. Columns of any name stay as they are.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts the one with the largest doc_id; null counts as the empty text, a null doc_id as the smallest."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8 or more.

    Texts without words and rows without a doc_id link with nothing and stay; all rows of a doc_id that stays do.
    """
    return minhash.drop_near_duplicates(docs, k=5, percent=80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs repeated or left out so that each source, null being one, gets an equal share of the bytes, in a global shuffle."""
    return mixing.mix_sources(docs).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences of 2048 tokens, with their ids; a null or empty text is its end token alone."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing_sources),
    ("packing", packed_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each on what the one before kept; an empty table gives no pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
