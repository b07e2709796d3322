"""Connected components of a graph in DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.llm import tables
from vitals.llm.tables import saved, spread_join


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of edges (a, b): the smallest id that it reaches.

    Each step finds the smallest neighbour of every id by an aggregation with map-side
    partial sums and joins it back; an id with a thousandth of all edges or more is dealt in
    parts for that (spread_join), so a hub with any number of neighbours is never gathered in
    one place. Edges are saved in the shared checkpoint folder after each round, and the
    rounds end when each component is a star. Edges with a null end are left out; no edges
    give no rows.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _print(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        # large star: larger neighbours move to the smallest neighbour (or the id itself)
        most = 2 * before[0]
        keep = saved if most >= tables.LEAST else lambda df: df
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = keep(spread_join(both.where("v > u"), least, ["u"], ["v"], at_most=most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: an id and its smaller neighbours move to the smallest of them
        least = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        moved = spread_join(large, least, ["u"], ["v"], at_most=most).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = saved(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _print(now)
        # stars, or what a round doesn't change
        if after == before or now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _print(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)
