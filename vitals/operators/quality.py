"""What is there, what is missing, what can't be right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory(facts: DataFrame, dataset: str, priorities: DataFrame | None = None) -> DataFrame:
    """Rows, areas, sexes, bands and source priority of each slice (Q1). facts: source_indicator, year, cause, area, sex, band_idx.

    priorities (source_indicator, priority): a source that it lacks has 0; without it all have 1,
    as the one source of a population has.
    """
    slices = facts.groupBy(F.lit(dataset).alias("dataset"), "source_indicator", "year", "cause").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sort_array(F.collect_set("area")).alias("areas"),
        F.sort_array(F.collect_set("sex")).alias("sexes"),
        F.sort_array(F.collect_set("band_idx")).alias("bands"),
    )
    if priorities is None:
        return slices.withColumn("priority", F.lit(1))
    return slices.join(priorities.select("source_indicator", "priority"), "source_indicator", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))


def availability(grid: DataFrame, facts: DataFrame, keys: list[str], required: DataFrame) -> DataFrame:
    """Of each requested slice: status, covered and missing areas, sources, rows (Q2). required: area."""
    have = facts.join(required.distinct(), "area", "left_semi").groupBy(*keys).agg(
        F.collect_set("area").alias("held"), F.count(F.lit(1)).alias("n_rows"), F.array_join(F.sort_array(F.collect_set("source_indicator")), ", ").alias("sources")
    )
    need = required.agg(F.sort_array(F.collect_set("area")).alias("need"))
    j = grid.join(have, keys, "left").join(F.broadcast(need))
    held = F.coalesce("held", F.array().cast("array<string>"))
    missing = F.sort_array(F.array_except("need", held))
    status = F.when(F.size("need") == 0, "nothing selected").when(F.size(held) == 0, "unavailable").when(F.size(missing) > 0, "partial").otherwise("available")
    return j.select(*keys, status.alias("status"), F.size(held).alias("covered"), F.array_join(missing, ", ").alias("missing"), F.coalesce("sources", F.lit("N/D")).alias("sources"), F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))


def missing_combinations(grid: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Requested combinations that are not there."""
    return grid.join(facts.select(*keys).distinct(), keys, "left_anti")


def issue_summary(status: DataFrame, examples: int, order: list[str]) -> DataFrame:
    """How many slices have each status, and the first of them (Q4)."""
    label = F.concat_ws(" ", *order)
    listed = F.array_join(F.slice(F.sort_array(F.collect_list(label)), 1, examples), "; ")
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"), listed.alias("examples"))


def inventory_summary(inv: DataFrame) -> DataFrame:
    """Slices, span, causes and most areas of each dataset (Q5)."""
    return inv.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_slices"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("cause").alias("n_causes"), F.max(F.size("areas")).alias("most_areas")
    )


def to_ingest(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Slices (year, cause, area) wanted and not stored, by slice (Q6)."""
    miss = wanted.join(stored.select("year", "cause", "area").distinct(), ["year", "cause", "area"], "left_anti")
    return miss.groupBy("year", "cause").agg(F.count(F.lit(1)).alias("n_areas"))


def sexes_add_up(pop: DataFrame, keys: list[str], value: str, within: float = 1.0) -> DataFrame:
    """Men and women against both, and whether they agree (Q7)."""
    s = lambda x: F.sum(F.when(F.col("sex") == x, F.col(value)).otherwise(0.0))
    t = pop.groupBy(*keys).agg(s("HM").alias("both"), (s("H") + s("M")).alias("parts"))
    return t.withColumn("agrees", F.abs(F.col("both") - F.col("parts")) <= within)


def plausible_totals(facts: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Totals of each year, and whether they are inside the bounds (Q8)."""
    return facts.groupBy("year").agg(F.sum(value).alias("total")).withColumn("plausible", F.col("total").between(low, high))


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks (Q9)."""
    if lacking := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def seam_scan(series: DataFrame, threshold: float) -> DataFrame:
    """Change of each area's series from year to year: median, quartile range, and how many exceed a threshold (Q10)."""
    before = series.select("area", (F.col("year") + 1).alias("year"), F.col("value").alias("_b"))
    change = series.join(before, ["area", "year"]).where("_b > 0").withColumn("change", F.col("value") / F.col("_b") - 1)
    q = lambda p: F.percentile("change", F.lit(p))
    return change.groupBy("year").agg(F.count(F.lit(1)).alias("n"), q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"), F.sum((F.abs("change") > threshold).cast("long")).alias("n_over"))


def causes_in_two_groups(groups: DataFrame) -> DataFrame:
    """Causes that more than one group claims; there should be none (Q11)."""
    return groups.groupBy("cause").agg(F.count_distinct("group").alias("n_groups")).where("n_groups > 1")
