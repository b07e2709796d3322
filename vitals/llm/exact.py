"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import saved, spread_join


def normalised(text: Column) -> Column:
    """Each run of blanks as one space; null as the empty text."""
    return F.coalesce(F.regexp_replace(text.cast("string"), r"[\x20\x09-\x0D]+", " "), F.lit(""))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by (128-bit hash, normalised text): Spark deals them out by the key and
    compares the bytes of the text within it, so texts that collide stay apart. Copies are
    counted in each map task before the shuffle, hence a group that holds a third of all
    rows is one row per task. Rows then find their group by hash and SHA-256; a group with a
    thousandth of all rows, and 50,000 or more, is dealt in parts for that (spread_join).

    A null text counts as empty; empty texts are copies of one another. Ids are taken as
    unique: rows that repeat an id count each in group_size and are all kept or all dropped.
    A null id is never the smallest, so its row is dropped where a copy has an id; a group
    of null ids only has a null keep_id and keeps its rows. Very long texts are hashed and
    compared whole. Other columns are left out. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    keyed = rows.select("doc_id", "norm", content_hash(F.col("norm")).alias("hash"))
    texts = keyed.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = saved(texts.select("hash", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    named = keyed.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    return (
        spread_join(named, groups, ["hash", "text_sha256"], ["doc_id"], "group_size")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with all their columns. Rows with a null id stay."""
    dropped = exact_duplicates(docs, id_col, text_col).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(docs.columns)
