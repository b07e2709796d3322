"""A corpus pipeline of five stages, each written as Parquet and read again by the next.

What holds for every stage: an empty table gives an empty one; columns beside those of
documents go through; repeated rows and ties are as in the operator that the stage calls; a
very long text is worked on alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vitals.llm import bpe, exact, minhash, substring, toxicity
from vitals.llm.queries import VOCABULARY
from vitals.llm.tables import saved, small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores below 0.7. Null and empty texts stay, as do rows with a null id, which nothing can name."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    toxic = toxicity.score_toxicity(docs, index).where("score >= 0.7 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts. Null and empty texts are equal; rows with a null id stay."""
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles, similarity 0.8 or more. Null and empty texts, and rows with a null id, stay."""
    small_batches(spark)
    return minhash.drop_near_duplicates(docs, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has too; a text without a word left goes, one that had none stays."""
    small_batches(spark)
    return substring.drop_repeated_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, with their ids; a null or empty text is the end token alone."""
    small_batches(spark)
    return bpe.pack_powers_of_two(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

#: Neither the nearest examples nor the tokens can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages, rows go to a folder in spark.checkpoint.dir, which goes with the session."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
