"""Reading, checking and writing facts as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitals.operators.merge import by_priority
from vitals.operators.quality import require_columns
from vitals.schema import BIRTHS, DEATHS, INFANT_DEATHS, LOOKUP, POPULATION

SCHEMAS = {"population": POPULATION, "deaths": DEATHS, "births": BIRTHS, "infant_deaths": INFANT_DEATHS, "lookup": LOOKUP}
POPULATION_KEYS = ["year", "area", "sex", "age_band"]
DEATH_KEYS = ["year", "area", "sex", "cause", "age_band"]


def conformed(df: DataFrame, schema: T.StructType, source: str | None = None) -> DataFrame:
    """The columns of a schema, cast; a source that is missing is filled in, anything else missing is an error."""
    if "source_indicator" in schema.fieldNames() and "source_indicator" not in df.columns:
        df = df.withColumn("source_indicator", F.lit(source))
    require_columns(df, schema.fieldNames())
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def read_facts(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    return conformed(spark.read.parquet(path), SCHEMAS[dataset])


def chosen(df: DataFrame, years: list[int] | None = None, areas: list[str] | None = None, causes: list[str] | None = None, sexes: list[str] | None = None) -> DataFrame:
    """Filters that reach the scan: years prune partitions, the rest use the statistics of the files."""
    for column, values in (("year", years), ("area", areas), ("cause", causes), ("sex", sexes)):
        if values is not None:
            df = df.where(F.col(column).isin(values))
    return df


def scan_population(df: DataFrame, years: list[int] | None = None, areas: list[str] | None = None, band: str = "age_band") -> DataFrame:
    """Population of the years and areas, summed by cell and source."""
    return chosen(df, years, areas).groupBy("year", "area", "sex", band, "source_indicator").agg(F.sum("pop").alias("pop"))


def scan_deaths(df: DataFrame, years: list[int] | None = None, areas: list[str] | None = None, causes: list[str] | None = None, band: str = "age_band") -> DataFrame:
    """Deaths of the years, areas and causes, summed by cell and source."""
    return chosen(df, years, areas, causes).groupBy("year", "area", "sex", "cause", band, "source_indicator").agg(F.sum("deaths").alias("deaths"))


def scan_chunks(df: DataFrame, priorities: DataFrame, years: list[int], causes: list[str], areas: list[str]) -> DataFrame:
    """Deaths with the priority of their source, of slices that hold any of the areas (S3)."""
    slices = chosen(df, years, None, causes)
    held = chosen(slices, None, areas).select("source_indicator", "year", "cause").distinct()
    return slices.join(held, ["source_indicator", "year", "cause"], "left_semi").join(F.broadcast(priorities), "source_indicator")


def scan_population_chunks(df: DataFrame, years: list[int], areas: list[str]) -> DataFrame:
    """Population of the years and areas; a requested year that no row has is an error when the rows are read."""
    have = chosen(df, years, areas)
    wanted = df.sparkSession.createDataFrame([(y,) for y in years], "year int")
    n = wanted.join(df.select("year").distinct(), "year", "left_anti").agg(F.count(F.lit(1)).alias("_missing"))
    checked = have.join(F.broadcast(n)).withColumn("_ok", F.assert_true(F.col("_missing") == 0, "a requested year has no population"))
    return checked.where("_ok IS NULL").drop("_missing", "_ok")


def scan_births(df: DataFrame, years: list[int] | None = None, areas: list[str] | None = None) -> DataFrame:
    return chosen(df, years, areas)


def scan_infant_deaths(df: DataFrame, years: list[int] | None = None, areas: list[str] | None = None, cause: str | None = None, sex: str | None = None) -> DataFrame:
    return chosen(df, years, areas, [cause] if cause else None, [sex] if sex else None)


def scan_lookup(df: DataFrame, vintage: str) -> DataFrame:
    return df.where(F.col("vintage") == vintage)


def refolded(df: DataFrame, keys: list[str], value: str, band: str = "age_band") -> DataFrame:
    """Bands folded to the common ones, roll-ups left out, summed again."""
    from vitals.functions.labels import folded_band, no_roll_ups

    return no_roll_ups(df, band).withColumn(band, folded_band(F.col(band))).groupBy(*keys, band).agg(F.sum(value).alias(value))


def upserted(stored: DataFrame, batch: DataFrame, keys: list[str] = ["year", "cause", "area"]) -> DataFrame:  # noqa: B006
    """Stored rows without those whose keys the batch has, and the batch."""
    return stored.join(batch.select(*keys).distinct(), keys, "left_anti").unionByName(batch.select(stored.columns))


def write_facts(df: DataFrame, path: str, by: list[str] = ["year"]) -> None:  # noqa: B006
    """Parquet by year; rows of an area stand together, so that statistics skip row groups."""
    df.repartition(*by).sortWithinPartitions(*by, "area").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def merged_population(stored: DataFrame, new: DataFrame, priorities: DataFrame, keys: list[str] = POPULATION_KEYS) -> DataFrame:
    """Stored rows give way to any new source."""
    spark = stored.sparkSession
    old = spark.createDataFrame([("stored", 0)], "source_indicator string, priority int")
    rows = stored.withColumn("source_indicator", F.lit("stored")).unionByName(new.select(stored.columns))
    return by_priority(rows, priorities.select("source_indicator", "priority").unionByName(old), keys, "pop")


def snapshot(pop: DataFrame, deaths: DataFrame, priorities: DataFrame, pop_keys: list[str], death_keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both facts with one source per cell, and a summary of rows."""
    p, d = by_priority(pop, priorities, pop_keys, "pop"), by_priority(deaths, priorities, death_keys, "deaths")
    count = lambda df, name: df.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_rows"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return p, d, count(p, "population").unionByName(count(d, "deaths"))


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 with a header."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
