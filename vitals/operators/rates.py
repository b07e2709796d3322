"""Rates of every cell in one pass: crude, standardised, years of life lost, proportional, infant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.functions.intervals import with_binomial_limits, with_poisson_limits

CELL = ["year", "area", "sex", "band_idx", "age_band"]
SERIES = ["year", "area", "sex", "cause"]


def total(x: str | Column) -> Column:
    """A sum that is 0 for nothing."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def joined(deaths: DataFrame, pop: DataFrame, keys: list[str] = CELL, keep_zero_bands: bool = False, causes: DataFrame | None = None) -> DataFrame:
    """Deaths with the population of their cell (J1): cells without either leave.

    A band with people and no death row leaves the denominator; keep_zero_bands keeps it with
    0 deaths, for each of `causes` (cause).
    """
    if not keep_zero_bands:
        return deaths.join(pop, keys)
    every = pop.crossJoin(causes.distinct()) if causes is not None else pop  # each cell with each cause: what is asked for
    by = [*keys, "cause"] if causes is not None else keys
    return every.join(deaths, by, "left").withColumn("deaths", F.coalesce("deaths", F.lit(0.0)))


def with_weights(df: DataFrame, bands: DataFrame) -> DataFrame:
    """Adds the standard weight of each band."""
    return df.join(F.broadcast(bands.select("age_band", "weight")), "age_band", "left")


def collapsed(full: DataFrame, keys: list[str]) -> DataFrame:
    """Deaths and population summed by keys, of one cause each.

    Population repeats for each cause, so `cause` must be among the keys.
    """
    if "cause" in full.columns and "cause" not in keys:
        raise ValueError("population repeats by cause: keep cause among the keys")
    return full.groupBy(*keys).agg(total("deaths").alias("deaths"), total("pop").alias("pop"))


def scoped(full: DataFrame, bands: DataFrame) -> DataFrame:
    """Each row once for all ages, and once more if under 75."""
    under = F.broadcast(bands.select("age_band", F.col("under").alias("_u")))
    scopes = F.when(F.col("_u"), F.array(F.lit("total"), F.lit("under75"))).otherwise(F.array(F.lit("total")))
    return full.join(under, "age_band").withColumn("scope", F.explode(scopes)).drop("_u")


def crude_rate(full: DataFrame, keys: list[str] = SERIES, per: float = 1e5) -> DataFrame:
    """Deaths by population (R2); null without population."""
    s = full.groupBy(*keys).agg(total("deaths").alias("deaths"), total("pop").alias("pop"))
    return s.withColumn("rate", F.when(F.col("pop") > 0, F.col("deaths") / F.col("pop") * per))


def crude_rate_limits(full: DataFrame, keys: list[str] = SERIES, per: float = 1e5) -> DataFrame:
    """The crude rate with exact limits."""
    return with_poisson_limits(crude_rate(full, keys, per), "deaths", scale=F.when(F.col("pop") > 0, F.lit(per) / F.col("pop")))


def standardised_rate(full: DataFrame, bands: DataFrame, keys: list[str] = SERIES, per: float = 1e5, min_count: float = 10) -> DataFrame:
    """Directly standardised rate over the bands at hand (R5); null below min_count deaths.

    weights of the bands at hand only, so leaving bands out renormalises. `variance` is of the
    rate; limits come from standardised_rate_limits.
    """
    w, d, n = F.col("weight"), F.col("deaths"), F.col("pop")
    by_band = full.where("pop > 0").groupBy(*keys, "age_band").agg(total("deaths").alias("deaths"), total("pop").alias("pop"))
    s = with_weights(by_band, bands).groupBy(*keys).agg(
        total("deaths").alias("deaths"), F.sum("weight").alias("_w"), F.sum(w * d / n).alias("_wr"), F.sum(w * w * d / (n * n)).alias("_v")
    )
    enough = (F.col("deaths") >= min_count) & (F.col("_w") > 0)
    return s.select(*keys, "deaths", F.when(enough, F.col("_wr") / F.col("_w") * per).alias("rate"), F.when(enough, F.col("_v") / F.pow("_w", F.lit(2)) * per * per).alias("variance"))


def standardised_rate_limits(full: DataFrame, bands: DataFrame, keys: list[str] = SERIES, per: float = 1e5, min_count: float = 10) -> DataFrame:
    """With limits that scale the exact limits of the total count by the rate's variance."""
    s = with_poisson_limits(standardised_rate(full, bands, keys, per, min_count), "deaths", "_lo", "_hi")
    scale = F.sqrt(F.col("variance") / F.col("deaths"))
    return s.select(*keys, "deaths", "rate", (F.col("rate") + scale * (F.col("_lo") - F.col("deaths"))).alias("lower"), (F.col("rate") + scale * (F.col("_hi") - F.col("deaths"))).alias("upper"))


def observed_bundle(full: DataFrame, bands: DataFrame, keys: list[str] = SERIES, min_count: float = 10) -> DataFrame:
    """Crude and standardised rates for both scopes with their limits, long."""
    by = [*keys, "scope"]
    both = scoped(full, bands)
    columns = ["deaths", "rate", "lower", "upper"]
    crude = crude_rate_limits(both, by).select(*by, F.lit("crude").alias("rate_type"), *columns)
    return crude.unionByName(standardised_rate_limits(both, bands, by, min_count=min_count).select(*by, F.lit("dsr").alias("rate_type"), *columns))


def selected_series(bundle: DataFrame, scope: str, rate_type: str, first: int, last: int) -> DataFrame:
    """(keys, year, rate, lower, upper) of one scope, rate type and range of years.

    The range is clipped to the years there are; one without any is an error when rows are read.
    """
    if first > last:
        raise ValueError("the range of years is empty")
    own = bundle.where((F.col("scope") == scope) & (F.col("rate_type") == rate_type))
    inside = F.col("year").between(first, last)
    some = own.agg(F.count(F.when(inside, 1)).alias("_n"))
    checked = F.assert_true(F.col("_n") > 0, "no year of the range has a rate")
    kept = some.join(own.where(inside), F.lit(True), "left").withColumn("_ok", checked)
    return kept.where("_ok IS NULL").drop("_n", "_ok", "scope", "rate_type")


def with_midpoints(df: DataFrame, bands: DataFrame) -> DataFrame:
    return df.join(F.broadcast(bands.select("age_band", "mid")), "age_band")


def years_lost(deaths: DataFrame, bands: DataFrame, cutoff: float, keys: list[str] = SERIES) -> DataFrame:
    """Years of life lost before the cutoff (R9); bands without a midpoint don't count.

    premature deaths and the sum of squares are kept for years_lost_limits.
    """
    gone = F.greatest(F.lit(cutoff) - F.col("mid"), F.lit(0.0))
    rows = with_midpoints(deaths, bands).where("mid IS NOT NULL").withColumn("_g", gone)
    return rows.groupBy(*keys).agg(total(F.col("deaths") * F.col("_g")).alias("ypll"), total(F.when(F.col("_g") > 0, F.col("deaths"))).alias("premature"), total(F.col("deaths") * F.col("_g") * F.col("_g")).alias("variance"))


def years_lost_limits(deaths: DataFrame, bands: DataFrame, cutoff: float, keys: list[str] = SERIES) -> DataFrame:
    """Limits that scale those of the premature count (R11); without one, 0 and the estimate."""
    y = with_poisson_limits(years_lost(deaths, bands, cutoff, keys), "premature", "_lo", "_hi")
    n = F.bround("premature", 0)
    some = (n > 0) & (F.col("variance") > 0)
    scale = F.sqrt(F.col("variance") / n)
    return y.select(
        *keys,
        "ypll",
        F.when(some, F.greatest(F.col("ypll") + scale * (F.col("_lo") - n), F.lit(0.0))).otherwise(0.0).alias("lower"),
        F.when(some, F.col("ypll") + scale * (F.col("_hi") - n)).otherwise(F.col("ypll")).alias("upper"),
    )


def split_youngest(deaths: DataFrame, under_one: DataFrame, keys: list[str], band: str = "0 - 4 anos") -> DataFrame:
    """The youngest band as < 1 and 1 - 4 where the count under one is known (R10), which is kept within the band; pop becomes null."""
    known = under_one.groupBy(*keys).agg(F.sum("deaths").alias("_u"))
    j = deaths.join(known, keys, "left")
    infant = F.greatest(F.least(F.col("_u"), F.col("deaths")), F.lit(0.0))
    gone = F.lit(None).cast("double")
    split = F.array(F.struct(F.lit("< 1 ano").alias("age_band"), infant.alias("deaths"), gone.alias("pop")), F.struct(F.lit("1 - 4 anos").alias("age_band"), (F.col("deaths") - infant).alias("deaths"), gone.alias("pop")))
    pop = F.col("pop") if "pop" in deaths.columns else gone
    same = F.array(F.struct("age_band", "deaths", pop.cast("double").alias("pop")))
    rest = [c for c in deaths.columns if c not in ("age_band", "deaths", "pop")]
    return j.select(*rest, F.explode(F.when((F.col("age_band") == band) & F.col("_u").isNotNull(), split).otherwise(same)).alias("_x")).select(*rest, "_x.age_band", "_x.deaths", "_x.pop")


def death_counts(deaths: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Counts with exact limits."""
    return with_poisson_limits(deaths.groupBy(*keys).agg(total("deaths").alias("deaths")), "deaths")


def proportional(deaths: DataFrame, all_causes: str, keys: list[str] = SERIES) -> DataFrame:
    """Each cause's share of all deaths, in percent (R13); null without deaths."""
    within = [k for k in keys if k != "cause"]
    counts = deaths.groupBy(*keys).agg(total("deaths").alias("deaths"))
    whole = counts.where(F.col("cause") == all_causes).select(*within, F.col("deaths").alias("all_deaths"))
    return counts.where(F.col("cause") != all_causes).join(whole, within).withColumn("share", F.when(F.col("all_deaths") > 0, F.col("deaths") / F.col("all_deaths") * 100))


def proportional_limits(deaths: DataFrame, all_causes: str, keys: list[str] = SERIES) -> DataFrame:
    """With exact binomial limits."""
    return with_binomial_limits(proportional(deaths, all_causes, keys), "deaths", "all_deaths")


def infant_rate(infant: DataFrame, births: DataFrame, keys: list[str], thin: float, per: float = 1000.0) -> DataFrame:
    """Deaths under one by live births (R14), flagged where births are few (R17); null without births."""
    d = infant.groupBy(*keys).agg(total("deaths").alias("deaths"))
    b = births.groupBy(*keys).agg(total("births").alias("births"))
    return d.join(b, keys, "left").select(
        *keys,
        "deaths",
        "births",
        F.when(F.col("births") > 0, F.col("deaths") / F.col("births") * per).alias("rate"),
        F.when(F.col("births") < thin, "*").otherwise("").alias("flag"),
        F.when(F.coalesce(F.col("births"), F.lit(0.0)) <= 0, "no births").alias("note"),
    )


def infant_rate_limits(infant: DataFrame, births: DataFrame, keys: list[str], thin: float, per: float = 1000.0) -> DataFrame:
    return with_poisson_limits(infant_rate(infant, births, keys, thin, per), "deaths", scale=F.when(F.col("births") > 0, F.lit(per) / F.col("births")))


def infant_count(infant: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Deaths under one of a window, null unless every year of it is covered.

    windows: year (the target) and source_year; infant has a row for each covered year.
    """
    size = windows.groupBy("year").agg(F.count_distinct("source_year").alias("_n"))
    seen = infant.withColumnRenamed("year", "source_year").join(F.broadcast(windows), "source_year").groupBy("year", *keys).agg(F.count_distinct("source_year").alias("covered"), total("deaths").alias("_d"))
    return seen.join(F.broadcast(size), "year").select("year", *keys, F.col("_n").alias("n_years"), "covered", F.when(F.col("covered") == F.col("_n"), F.col("_d")).alias("deaths"))


def births_total(births: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Births of a window, of whatever years there are."""
    return births.withColumnRenamed("year", "source_year").join(F.broadcast(windows), "source_year").groupBy("year", *keys).agg(total("births").alias("births"))


def thin(births: Column, limit: float) -> Column:
    """* for few births; nothing if unknown."""
    return F.when(births < limit, "*").otherwise("")
