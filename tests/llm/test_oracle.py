"""Queries of the training-data operators against their SQL on the smallest tables, and whole tables for the rest."""

import os

import duckdb
import pytest

from tests.test_queries import rows
from vitals.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert rows(got) == rows(con.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["op4_quality_classifier", "op8_toxicity", "op9_bpe", "op10_quality_rules"])
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op4_quality_classifier"](spark, DATA).collect() if r["held_out"] and r["doc_id"] in labels]
    assert got and sum(r["predicted"] == labels[r["doc_id"]]["quality"] for r in got) >= 0.85 * len(got)
