"""Many sources to one fact per cell, and what the sources cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.schema import RATE_METRICS


def by_priority(facts: DataFrame, priorities: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of the source with the largest priority in each cell; lower ones fill cells it lacks (M1).

    Ties go to the smaller indicator. An aggregation, so nothing is sorted and each task
    sends one row per cell.
    """
    ranked = facts.join(priorities, "source_indicator")
    best = F.min_by(F.struct(value, "source_indicator"), F.struct(-F.col("priority"), "source_indicator")).alias("best")
    return ranked.groupBy(*keys).agg(best).select(*keys, f"best.{value}", "best.source_indicator")


def source_plan(available: DataFrame, priorities: DataFrame) -> DataFrame:
    """(year, source): each year from the source with the largest priority that has it (M2)."""
    return by_priority(available.select("year", "source_indicator", F.lit(1).alias("one")), priorities, ["year"], "one").select("year", "source_indicator")


def with_fallback(detailed: DataFrame, total_only: DataFrame, priorities: DataFrame) -> DataFrame:
    """As source_plan, where a source of totals serves years that no detailed source has (M3)."""
    plan = source_plan(detailed, priorities)
    return plan.unionByName(total_only.select("year", "source_indicator").join(plan, "year", "left_anti"))


def by_year_range(facts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of each indicator inside its own range of years (M4). ranges: source_indicator, first, last.

    A range is a row for each of its years, so the join is by equality; a fact in two ranges
    of its indicator comes twice, and a range that ends before it begins holds nothing.
    """
    years = ranges.where("first <= last").select("source_indicator", F.explode(F.sequence("first", "last")).alias("year"))
    return facts.join(years.withColumn("year", F.col("year").cast(facts.schema["year"].dataType)), ["source_indicator", "year"]).select(facts.columns)


def with_sources(deaths: DataFrame, pop: DataFrame, keys: list[str]) -> DataFrame:
    """Deaths and population of the same cells, with where each is from (M5)."""
    return deaths.withColumnRenamed("source_indicator", "death_source").join(pop.withColumnRenamed("source_indicator", "population_source"), keys)


def seams_crossed(series: DataFrame, seams: DataFrame, keys: list[str], metric: str | None = None) -> DataFrame:
    """(keys, seam, effect) where a series has years on both sides of a seam (M6).

    metric: a column of the series that names what its values are. Counts cross no seam, as
    they aren't divided by the population.
    """
    if metric:
        series = series.where(F.col(metric).isin(RATE_METRICS))
    spans = series.groupBy(*keys).agg(F.min("year").alias("_a"), F.max("year").alias("_b"))
    return spans.join(F.broadcast(seams), (F.col("_a") < F.col("seam")) & (F.col("_b") >= F.col("seam"))).select(*keys, "seam", "effect")


def seam_note(series: DataFrame, seams: DataFrame, keys: list[str], metric: str | None = None) -> DataFrame:
    """One note per series that crosses seams (M7); metric as in seams_crossed, so that counts have no note."""
    crossed = seams_crossed(series, seams, keys, metric)
    one = F.concat((F.col("seam") - 1).cast("string"), F.lit("/"), F.col("seam").cast("string"), F.lit(" ("), F.col("effect"), F.lit(")"))
    listed = F.sort_array(F.collect_list(F.struct("seam", one.alias("text"))))
    return crossed.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "; ").alias("note"))


def year_sets(pop: DataFrame, deaths: DataFrame) -> DataFrame:
    """Years of either fact, and whether rates can be had: (year, has_pop, has_deaths, usable) (M8)."""
    both = pop.select("year", F.lit(1).alias("p"), F.lit(0).alias("d")).distinct().unionByName(deaths.select("year", F.lit(0).alias("p"), F.lit(1).alias("d")).distinct())
    n = both.groupBy("year").agg(F.max("p").alias("p"), F.max("d").alias("d"))
    return n.select("year", (F.col("p") == 1).alias("has_pop"), (F.col("d") == 1).alias("has_deaths"), (F.col("p") + F.col("d") == 2).alias("usable"))


def gaps(requested: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Requested years that are not there, listed per key (M9). requested: keys, year."""
    missing = requested.join(available.select(*keys, "year").distinct(), [*keys, "year"], "left_anti")
    return missing.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("year")).cast("array<string>"), ", ").alias("missing_years"), F.count(F.lit(1)).alias("n_missing"))


def detail_check(years: DataFrame, facts: DataFrame, cause: str, sex: str) -> DataFrame:
    """Each year and whether it holds the cause and sex."""
    have = facts.where((F.col("cause") == cause) & (F.col("sex") == sex)).select("year").distinct().withColumn("_h", F.lit(True))
    return years.select("year").distinct().join(have, "year", "left").select("year", F.coalesce("_h", F.lit(False)).alias("held"))
