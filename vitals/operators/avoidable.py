"""Avoidable mortality under 75: groups of causes that prevention or care could avoid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.operators.rates import standardised_rate, total


def group_map(groups: DataFrame) -> DataFrame:
    """(cause, group): a cause's own group, and avoidable if it is preventable or treatable (A1)."""
    own = F.col("group")
    both = F.when(own.isin("preventable", "treatable"), F.array(own, F.lit("avoidable"))).otherwise(F.array(own))
    return groups.select("cause", F.explode(both).alias("group"))


def under75(df: DataFrame, bands: DataFrame) -> DataFrame:
    return df.join(F.broadcast(bands.where("under").select("age_band")), "age_band", "left_semi")


def group_deaths(deaths: DataFrame, groups: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Deaths under 75 by group (A2)."""
    return under75(deaths, bands).join(F.broadcast(group_map(groups)), "cause").groupBy(*keys, "group").agg(total("deaths").alias("deaths"))


def breakdown(deaths: DataFrame, groups: DataFrame, bands: DataFrame, keys: list[str], all_causes: str) -> DataFrame:
    """Six parts that add up to all deaths under 75, and each one's share (A3)."""
    j = under75(deaths, bands).join(F.broadcast(groups.select("cause", "group")), "cause", "left")
    part = lambda g: total(F.when(F.col("group") == g, F.col("deaths")))
    s = j.groupBy(*keys).agg(part("preventable").alias("p"), part("treatable").alias("t"), part("unresolved").alias("u"), total(F.when(F.col("cause") == all_causes, F.col("deaths"))).alias("a"))
    p, t, u, a = (F.col(c) for c in "ptua")
    rows = [("preventable", p), ("treatable", t), ("avoidable", p + t), ("unresolved", u), ("other", F.greatest(a - p - t - u, F.lit(0.0))), ("total", a)]
    long = s.select(*keys, "a", F.explode(F.array(*(F.struct(F.lit(g).alias("group"), v.alias("deaths")) for g, v in rows))).alias("x"))
    return long.select(*keys, "x.group", "x.deaths", F.when(F.col("a") > 0, F.col("x.deaths") / F.col("a") * 100).alias("share"))


def group_rate(deaths: DataFrame, pop: DataFrame, groups: DataFrame, bands: DataFrame, keys: list[str], min_count: float = 10) -> DataFrame:
    """Standardised rate under 75 of each group (A4).

    Population stands once per (year, area, sex, band) before it is summed, whatever the
    number of causes; bands without a death of the group count with 0.
    """
    people = under75(pop, bands).dropDuplicates(["year", "area", "sex", "age_band"]).groupBy(*keys, "age_band").agg(total("pop").alias("pop"))
    names = F.broadcast(group_map(groups).select("group").distinct())
    dead = under75(deaths, bands).join(F.broadcast(group_map(groups)), "cause").groupBy(*keys, "group", "age_band").agg(total("deaths").alias("deaths"))
    full = people.join(names).join(dead, [*keys, "group", "age_band"], "left").withColumn("deaths", F.coalesce("deaths", F.lit(0.0)))
    return standardised_rate(full, bands, [*keys, "group"], min_count=min_count)


def group_table(deaths: DataFrame, pop: DataFrame, groups: DataFrame, bands: DataFrame, keys: list[str], all_causes: str, n_years: float, min_count: float = 10) -> DataFrame:
    """Deaths a year, share and rate by group, rounded half to even (A5)."""
    parts = breakdown(deaths, groups, bands, keys, all_causes)
    rates = group_rate(deaths, pop, groups, bands, keys, min_count).select(*keys, "group", "rate")
    return parts.join(rates, [*keys, "group"], "left").select(*keys, "group", F.bround(F.col("deaths") / n_years, 0).alias("deaths"), F.bround("share", 1).alias("share"), F.bround("rate", 1).alias("rate"))


def cause_listing(groups: DataFrame) -> DataFrame:
    """Each cause with its group, and why it is left out."""
    return groups.select("cause", "group", F.coalesce("reason", F.lit("")).alias("reason"))
