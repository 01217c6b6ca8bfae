"""From raw documents to packed windows: five stages, each one of the text
operators.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``docs``.  ``run`` writes each
result as Parquet below ``spark.checkpoint.dir`` and reads it back for the next
stage, so a lost executor never reaches back beyond one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlens.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from eventlens.llm.common import in_file_order, stage


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or
    more, the one with the smallest doc_id stays."""
    return ngram_join.drop_near_copies(docs, words=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.interleave(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens, sequence ids in the order
    of the mix, which is the order in which the stage before wrote its rows.
    Null and empty texts give the end token alone."""
    return packing.packed_bpe(in_file_order(docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_jaccard", remove_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The classifier and the tokenizer have no SQL form; tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
