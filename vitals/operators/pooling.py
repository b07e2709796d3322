"""Centred pooling over years, and indirect standardisation against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.functions.intervals import byar_limits, with_poisson_limits
from vitals.functions.labels import period
from vitals.operators.rates import total


def pooling_window(window: object) -> int:
    """An odd number of years; less than one or no number counts as one, even ones are an error."""
    try:
        w = int(float(window))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return 1
    if w < 1:
        return 1
    if w % 2 == 0:
        raise ValueError("a centred window has an odd number of years")
    return w


def windows(years: DataFrame, window: int) -> DataFrame:
    """(year, source_year): the years that each target year pools, of those there are."""
    half = (pooling_window(window) - 1) // 2
    own = years.select("year").distinct()
    around = own.select("year", F.explode(F.sequence(F.col("year") - half, F.col("year") + half)).alias("source_year"))
    return around.join(F.broadcast(own.withColumnRenamed("year", "source_year")), "source_year").select("year", "source_year")


def pooled(full: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """Deaths and population summed over centred windows of the years in the table.

    A group stands at a target year if any year of the window has it, even if that year hasn't.
    Facts are summed by year and dealt by group first; the windows then meet what each task
    holds of a group, so no more rows move for a longer window.
    """
    w = F.broadcast(windows(full, window))
    yearly = full.groupBy(F.col("year").alias("source_year"), *keys).agg(total("deaths").alias("deaths"), total("pop").alias("pop"))
    t = yearly.repartition(*keys).join(w, "source_year")
    return t.groupBy("year", *keys).agg(
        total("deaths").alias("deaths"), total("pop").alias("pop"), F.min("source_year").alias("period_start"), F.max("source_year").alias("period_end"), F.count_distinct("source_year").alias("n_years")
    ).withColumn("period_label", period(F.col("period_start"), F.col("period_end")))


def clipped_windows(years: DataFrame, window: int, usable: DataFrame) -> DataFrame:
    """Windows without the years that a metric's denominator lacks (P2). usable: year."""
    return windows(years, window).join(F.broadcast(usable.select(F.col("year").alias("source_year")).distinct()), "source_year", "left_semi")


def annualised(metric: Column, value: Column, n_years: Column) -> Column:
    """Counts of a pooled window by its years; rates and infant counts stay."""
    return F.when(metric.isin("deaths", "ypll"), value / n_years).otherwise(value)


def expected(area: DataFrame, reference: DataFrame, keys: list[str], match: list[str]) -> DataFrame:
    """Observed and expected deaths over the bands that the reference has.

    match: the keys (without the band) that area and reference share; keys: those of the result.
    """
    ref = reference.groupBy(*match, "age_band").agg(total("deaths").alias("ref_deaths"), total("pop").alias("ref_pop")).where("ref_pop > 0")
    own = area.groupBy(*keys, "age_band").agg(total("deaths").alias("deaths"), total("pop").alias("pop"))
    j = own.join(ref, [*match, "age_band"], "left")
    has = F.col("ref_pop").isNotNull()
    return j.groupBy(*keys).agg(
        total(F.when(has, F.col("deaths"))).alias("observed"),
        total(F.col("pop") * F.col("ref_deaths") / F.col("ref_pop")).alias("expected"),
        (F.sum("ref_deaths") / F.sum("ref_pop")).alias("ref_rate"),
        F.count("ref_pop").alias("bands_used"),
        F.array_join(F.sort_array(F.collect_set(F.when(~has, F.col("age_band")))), ", ").alias("missing_bands"),
    )


def smr(observed: DataFrame, per: float = 1e5) -> DataFrame:
    """SMR and indirectly standardised rate with Byar's limits, for counts of ten or more (P5); excluded says which bands had no reference."""
    o, e = F.col("observed"), F.col("expected")
    lower, upper = byar_limits(o)
    some = e > 0
    ten = some & (o >= 10)
    ratio = F.when(some, o / e * 100)
    return observed.withColumns(
        {
            "smr": ratio,
            "smr_lower": F.when(ten, lower / e * 100),
            "smr_upper": F.when(ten, upper / e * 100),
            "isr": ratio / 100 * F.col("ref_rate") * per,
            "isr_lower": F.when(ten, lower / e * F.col("ref_rate") * per),
            "isr_upper": F.when(ten, upper / e * F.col("ref_rate") * per),
            "excluded": F.when(F.col("missing_bands") != "", F.concat(F.lit("bands without a usable reference, left out: "), "missing_bands")),
            "note": F.when(F.col("bands_used") == 0, "no data").when(~some, "no deaths expected"),
        }
    )


def smr_exact(observed: DataFrame, per: float = 1e5) -> DataFrame:
    """As smr, with exact limits below ten deaths."""
    s = with_poisson_limits(smr(observed, per), "observed", "_lo", "_hi")
    e, rate = F.col("expected"), F.col("ref_rate") * per
    exact = {f"{m}_{side}": F.coalesce(f"{m}_{side}", F.when(e > 0, F.col(c) / e * by)) for m, by in (("smr", F.lit(100.0)), ("isr", rate)) for side, c in (("lower", "_lo"), ("upper", "_hi"))}
    return s.withColumns(exact).drop("_lo", "_hi")


def smr_class(lower: Column, upper: Column) -> Column:
    """Against 100 (P6); null without limits."""
    return F.when(lower.isNull() | upper.isNull(), None).when(lower > 100, "above").when(upper < 100, "below").otherwise("no significant difference")


def smr_series(full: DataFrame, reference_area: str, keys: list[str]) -> DataFrame:
    """SMR of every area against one of them, matched on all keys but the area."""
    match = [k for k in keys if k != "area"]
    out = smr(expected(full, full.where(F.col("area") == reference_area), keys, match))
    return out.withColumn("class", smr_class(F.col("smr_lower"), F.col("smr_upper")))
