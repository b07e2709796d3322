"""One metric for many causes and places: canonical rows, matrices, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitals.functions.intervals import binomial_limits_of, byar_limits, poisson_limits_of
from vitals.functions.labels import interval_text, period, rounded_metric
from vitals.operators import pooling, rates

ROW = ["location", "cause", "metric", "year", "value", "lower", "upper", "flag"]


def _row(df: DataFrame, metric: str, value: str, lower: str | None = None, upper: str | None = None, flag: str | None = None) -> DataFrame:
    gone = F.lit(None).cast("double")
    return df.select(
        F.col("area").alias("location"),
        "cause",
        F.lit(metric).alias("metric"),
        "year",
        F.col(value).alias("value"),
        (F.col(lower) if lower else gone).alias("lower"),
        (F.col(upper) if upper else gone).alias("upper"),
        (F.col(flag) if flag else F.lit("")).alias("flag"),
    )


def annual_metric(metric: str, full: DataFrame, bands: DataFrame, infant: DataFrame, births: DataFrame, sex: str, reference: str, all_causes: str, cutoff: float, thin: float, limits: bool = True, min_count: float = 10) -> DataFrame:
    """Canonical rows of a metric for every place, cause and year at once."""
    keys = ["year", "area", "cause"]
    f = full.where(F.col("sex") == sex)
    lo_hi = ("lower", "upper") if limits else (None, None)
    if metric == "deaths":
        return _row(rates.death_counts(f, keys) if limits else f.groupBy(*keys).agg(rates.total("deaths").alias("deaths")), metric, "deaths", *lo_hi)
    if metric == "crude":
        return _row(rates.crude_rate_limits(f, keys) if limits else rates.crude_rate(f, keys), metric, "rate", *lo_hi)
    if metric == "dsr":
        return _row((rates.standardised_rate_limits if limits else rates.standardised_rate)(f, bands, keys, min_count=min_count), metric, "rate", *lo_hi)
    if metric in ("smr", "isr"):
        s = pooling.expected(f, f.where(F.col("area") == reference), keys, ["year", "cause"])
        s = pooling.smr_exact(s) if limits else pooling.smr(s)
        return _row(s, metric, metric, f"{metric}_lower", f"{metric}_upper")
    if metric == "proportional":
        return _row((rates.proportional_limits if limits else rates.proportional)(f, all_causes, keys), metric, "share", *lo_hi)
    if metric == "ypll":
        return _row(rates.years_lost_limits(f, bands, cutoff, keys) if limits else rates.years_lost(f, bands, cutoff, keys), metric, "ypll", *lo_hi)
    i = infant.where(F.col("sex") == sex).groupBy(*keys).agg(rates.total("deaths").alias("deaths"))
    if metric == "infant_deaths":
        return _row(i, metric, "deaths")
    if metric == "infant":
        b = births.groupBy("year", "area").agg(rates.total("births").alias("births"))
        r = i.join(b, ["year", "area"], "left").withColumns({"rate": F.when(F.col("births") > 0, F.col("deaths") / F.col("births") * 1000), "flag": rates.thin(F.col("births"), thin)})
        return _row(r, metric, "rate", flag="flag")
    raise ValueError(f"no metric {metric!r}")


#: The metrics of the annual table, in its order.
METRICS = ["deaths", "crude", "dsr", "smr", "isr", "proportional", "infant_deaths", "infant", "ypll"]


def _windows(df: DataFrame, years: list[int], sizes: tuple[int, ...]) -> DataFrame:
    """(window, year, source_year) of the years named, a row for each year that a window holds."""
    rows = [(k, y, x) for k in map(pooling.pooling_window, sizes) for y in years for x in years if abs(x - y) <= (k - 1) // 2]
    return df.sparkSession.createDataFrame(rows, "window int, year int, source_year int")


def _span(windows: DataFrame, usable: list[int]) -> DataFrame:
    """(window, year, n_years, period) of the usable years of each window, or of all if none is usable."""
    ok = F.col("source_year").isin(usable) if usable else F.lit(False)
    own = lambda f, c: F.coalesce(f(F.when(ok, F.col(c))), f(c))
    n = F.count(F.when(ok, 1))
    g = windows.groupBy("window", "year").agg(F.when(n > 0, n).otherwise(F.count(F.lit(1))).alias("n_years"), own(F.min, "source_year").alias("_a"), own(F.max, "source_year").alias("_b"))
    return g.select("window", "year", "n_years", period(F.col("_a"), F.col("_b")).alias("period"))


def _listed(sets: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(F.flatten(sets))), ", "), F.lit("")), F.lit("N/D"))


def annual_table(
    full: DataFrame, bands: DataFrame, infant: DataFrame, births: DataFrame, sex: str, reference: str, all_causes: str, cutoff: float, thin: float, windows: tuple[int, ...] = (1, 3, 5), years: list[int] | None = None, youngest: tuple[str, float, float] = ("0 - 4 anos", 0.5, 3.0), min_count: float = 10, per: float = 1e5, metrics: list[str] = METRICS
) -> DataFrame:
    """All metrics of all places, causes and years, pooled over each of the windows, in one pass over the facts (C1 with P1 to P3).

    full: year, area, sex, cause, age_band, deaths, pop, and where they are known
    population_source and death_source. One grouped scan sums deaths and population by year,
    place, cause and band; these states add up over the years of each window, and the rest is
    computed from the sums: rates of pooled person-years, SMR and ISR against the reference
    place pooled alike, shares of all causes, years lost with the youngest band split where
    the deaths under one of every year of the window are known. Counts are by year of the
    window, infant counts are its total and null unless all years that can be covered are.

    years: the years that windows may hold, else those of the facts (a short list, read
    first). youngest: the band that deaths under one are part of, with the midpoints of its
    two parts. Rows: location, cause, metric, window, year, period, n_years, value, lower,
    upper, flag, source_detail.
    """
    listed = lambda df: sorted(r["year"] for r in df.select("year").distinct().collect())  # noqa: E731  years are few
    years = listed(full) if years is None else years
    own_infant = infant.where(F.col("sex") == sex)
    infant_years = listed(own_infant)
    rate_years = sorted(set(infant_years) & set(listed(births)))
    w = _windows(full, years, windows)
    place, series = ["area", "cause"], ["window", "year", "area", "cause"]
    total = rates.total
    sources = [c for c in ("population_source", "death_source") if c in full.columns]

    # states by year, then by window: dealt by place and cause, so windows add no rows to what moves
    yearly = full.where(F.col("sex") == sex).groupBy(F.col("year").alias("source_year"), *place, "age_band").agg(total("deaths").alias("deaths"), total("pop").alias("pop"), *(F.collect_set(c).alias(c) for c in sources))
    pooled = yearly.repartition(*place).join(F.broadcast(w), "source_year").groupBy(*series, "age_band").agg(total("deaths").alias("deaths"), total("pop").alias("pop"), *(F.flatten(F.collect_list(c)).alias(c) for c in sources))

    alike = Window.partitionBy("window", "year", "cause", "age_band")
    at_reference = lambda c: F.max(F.when((F.col("area") == reference) & (F.col("pop") > 0), F.col(c))).over(alike)
    b = pooled.withColumns({"ref_deaths": at_reference("deaths"), "ref_pop": at_reference("pop")}).join(F.broadcast(bands.select("age_band", "weight", "mid")), "age_band", "left")
    d, n, weight, some = F.col("deaths"), F.col("pop"), F.col("weight"), F.col("pop") > 0
    is_youngest, has = F.col("age_band") == youngest[0], F.col("ref_pop").isNotNull()
    lost = F.greatest(F.lit(cutoff) - F.col("mid"), F.lit(0.0))
    s = b.groupBy(*series).agg(
        total("deaths").alias("deaths"), total("pop").alias("pop"),
        total(F.when(some, d)).alias("_d"), F.sum(F.when(some, weight)).alias("_w"), F.sum(F.when(some, weight * d / n)).alias("_wr"), F.sum(F.when(some, weight * weight * d / (n * n))).alias("_v"),
        total(F.when(has, d)).alias("observed"), total(n * F.col("ref_deaths") / F.col("ref_pop")).alias("expected"), (F.sum("ref_deaths") / F.sum("ref_pop")).alias("ref_rate"),
        F.max(is_youngest).alias("_has_youngest"), total(F.when(is_youngest, d)).alias("_young"), F.max(F.when(is_youngest, lost)).alias("_young_lost"),
        *(total(F.when(~is_youngest, x)).alias(f"_{k}") for k, x in (("y0", F.when(lost > 0, d)), ("y1", d * lost), ("y2", d * lost * lost))),
        *(F.collect_list(c).alias(c) for c in sources),
    )
    of_place = Window.partitionBy("window", "year", "area")
    s = s.withColumn("all_deaths", F.max(F.when(F.col("cause") == all_causes, F.col("deaths"))).over(of_place)).withColumn("_there", F.lit(True))
    if sources:
        s = s.withColumn("all_source", _listed(F.array(F.flatten(F.max(F.when(F.col("cause") == all_causes, F.col("death_source"))).over(of_place)))) if "death_source" in sources else F.lit("N/D"))
    named = {c: _listed(F.col(c)) if c in sources else F.lit("N/D") for c in ("population_source", "death_source")}
    s = s.withColumns(named | {"all_source": F.col("all_source") if sources else F.lit("N/D")})

    young = own_infant.groupBy(F.col("year").alias("source_year"), *place).agg(total("deaths").alias("u")).join(F.broadcast(w), "source_year")
    young = young.groupBy(*series).agg(F.sum("u").alias("u"), F.count(F.lit(1)).alias("covered"), F.sum(F.when(F.col("source_year").isin(rate_years), F.col("u"))).alias("u_rate"), F.count(F.when(F.col("source_year").isin(rate_years), 1)).alias("covered_rate"))
    born = births.groupBy(F.col("year").alias("source_year"), "area").agg(total("births").alias("births")).where(F.col("source_year").isin(rate_years)).join(F.broadcast(w), "source_year").groupBy("window", "year", "area").agg(F.sum("births").alias("births"))
    spans = lambda usable, tag: F.broadcast(_span(w, usable).withColumnsRenamed({"n_years": f"n_{tag}", "period": f"period_{tag}"}))
    x = s.join(young, series, "full").join(born, ["window", "year", "area"], "left")
    for usable, tag in ((years, "all"), (infant_years, "count"), (rate_years, "rate")):
        x = x.join(spans(usable, tag), ["window", "year"])

    # the youngest band in two where every year of the window is covered
    split = (F.col("covered") == F.col("n_all")) & F.col("_has_youngest")
    first = F.greatest(F.least(F.col("u"), F.col("_young")), F.lit(0.0))
    gone = [F.greatest(F.lit(cutoff - m), F.lit(0.0)) for m in youngest[1:]]
    part = lambda k: F.when(split, sum((c * (F.when(g > 0, 1.0).otherwise(0.0) if k == 0 else F.pow(g, F.lit(k))) for c, g in ((first, gone[0]), (F.col("_young") - first, gone[1]))), F.lit(0.0))).otherwise(F.col("_young") * F.coalesce(F.when(F.col("_young_lost") > 0, 1.0).otherwise(0.0) if k == 0 else F.pow("_young_lost", F.lit(k)), F.lit(0.0)))
    x = x.withColumns({f"_y{k}": F.col(f"_y{k}") + part(k) for k in range(3)})
    x = x.withColumns({"count": F.when(F.col("covered") == F.col("n_count"), F.col("u")), "infant": F.when(F.col("covered_rate") == F.col("n_rate"), F.col("u_rate"))})
    # limits take longer than their few rows let Spark expect: every core has a share
    x = x.repartition(x.sparkSession.sparkContext.defaultParallelism, *series)
    limits = {"deaths": "deaths", "observed": "observed", "_y0": "_y0", "count": "count", "infant": "infant", "_d": "_d"}
    x = x.withColumns({f"l_{k}": poisson_limits_of(F.col(c)) for k, c in limits.items()} | {"l_share": binomial_limits_of(F.col("deaths"), F.col("all_deaths"))})

    c = F.col
    lo_hi = lambda k, f: [f(c(f"l_{k}.lower")), f(c(f"l_{k}.upper"))]
    rate = F.when(c("pop") > 0, F.lit(per) / c("pop"))
    enough = (c("_d") >= min_count) & (c("_w") > 0)
    dsr, spread = F.when(enough, c("_wr") / c("_w") * per), F.sqrt(c("_v") / (c("_w") * c("_w")) * per * per / c("_d"))
    e = F.when(c("expected") > 0, c("expected"))
    byar = byar_limits(c("observed"))
    ratio = [c("observed") / e, *(F.when(c("observed") >= 10, y).otherwise(z) / e for y, z in zip(byar, (c("l_observed.lower"), c("l_observed.upper")), strict=True))]
    premature = F.bround("_y0", 0)
    scale = F.when((premature > 0) & (c("_y2") > 0), F.sqrt(c("_y2") / premature))
    ypll = [c("_y1"), F.coalesce(F.greatest(c("_y1") + scale * (c("l__y0.lower") - premature), F.lit(0.0)), F.lit(0.0)), F.coalesce(c("_y1") + scale * (c("l__y0.upper") - premature), c("_y1"))]
    born_rate = F.when(c("births") > 0, F.lit(1000.0) / c("births"))
    both = F.concat(F.lit("Pop.: "), "population_source", F.lit("; deaths: "), "death_source")
    against = F.concat(both, F.lit(f"; ref.: {reference}"))
    whole = lambda v: F.coalesce(F.bround(v, 0).cast("long").cast("string"), F.lit("N/D"))
    made = {
        "deaths": ([v / c("n_all") for v in (c("deaths"), *lo_hi("deaths", lambda v: v))], c("death_source"), "all"),
        "crude": ([c("deaths") * rate, *lo_hi("deaths", lambda v: v * rate)], both, "all"),
        "dsr": ([dsr, *(F.when(enough, dsr + spread * (v - c("_d"))) for v in lo_hi("_d", lambda v: v))], both, "all"),
        "smr": ([v * 100 for v in ratio], F.concat(against, F.lit(" (O="), whole(c("observed")), F.lit(", E="), F.format_string("%.1f", F.bround("expected", 1)), F.lit(")")), "all"),
        "isr": ([v * c("ref_rate") * per for v in ratio], against, "all"),
        "proportional": ([F.when(c("all_deaths") > 0, c("deaths") / c("all_deaths") * 100), *lo_hi("share", lambda v: v)], F.concat(F.lit("deaths: "), "death_source", F.lit("; of: "), "all_source"), "all"),
        "infant_deaths": ([c("count"), *lo_hi("count", lambda v: v)], F.concat(F.lit("deaths under one: "), whole(c("count"))), "count"),
        "infant": ([c("infant") * born_rate, *lo_hi("infant", lambda v: v * born_rate)], F.concat(F.lit("deaths under one: "), whole(c("infant")), F.lit("; births: "), whole(c("births"))), "rate"),
        "ypll": ([v / c("n_all") for v in ypll], F.concat(c("death_source"), F.when(split, F.concat(F.lit("; under one apart ("), whole(c("u")), F.lit(")"))).otherwise(F.lit("; under one not apart"))), "all"),
    }
    shown = {"proportional": c("_there") & (c("cause") != all_causes) & c("all_deaths").isNotNull(), "infant": c("u").isNotNull(), "infant_deaths": c("u").isNotNull()}
    row = lambda m: F.struct(F.lit(m).alias("metric"), c(f"period_{made[m][2]}").alias("period"), c(f"n_{made[m][2]}").cast("int").alias("n_years"), *(v.cast("double").alias(k) for v, k in zip(made[m][0], ("value", "lower", "upper"), strict=True)), (rates.thin(c("births"), thin) if m == "infant" else F.lit("")).alias("flag"), made[m][1].alias("source_detail"))
    rows = F.array_compact(F.array(*(F.when(shown.get(m, c("_there")), row(m)) for m in metrics)))
    return x.select(c("area").alias("location"), "cause", "window", "year", F.explode(rows).alias("r")).select("location", "cause", "window", "year", "r.*")


def comparators(selected: DataFrame, national: str, region: str, membership: DataFrame, label: str) -> DataFrame:
    """(label, area): the nation, a region's municipalities, and the selection without these two."""
    own = selected.where(~F.col("area").isin(national, region)).select(F.lit(label).alias("label"), "area")
    part = membership.where(F.col("region") == region).select(F.col("region").alias("label"), F.col("municipality").alias("area"))
    nation = selected.sparkSession.range(1).select(F.lit(national).alias("label"), F.lit(national).alias("area"))
    return own.unionByName(part).unionByName(nation).distinct()


def cause_order(rows: DataFrame, location: str) -> DataFrame:
    """(cause, rank) by falling value at one location."""
    w = Window.orderBy(F.col("value").desc_nulls_last(), "cause")
    return rows.where(F.col("location") == location).select("cause", F.row_number().over(w).alias("rank"))


def matrix(rows: DataFrame, locations: list[str], order_by: str, cell: Column | None = None) -> DataFrame:
    """Causes in order by locations; cells are values with limits and flag (C4)."""
    r = lambda c: rounded_metric(F.col("metric"), F.col(c))
    text = F.concat(interval_text(r("value"), r("lower"), r("upper")), "flag") if cell is None else cell
    wide = rows.withColumn("cell", text).groupBy("cause").pivot("location", locations).agg(F.first("cell"))
    return wide.join(F.broadcast(cause_order(rows, order_by)), "cause").orderBy("rank")


def sources_matrix(rows: DataFrame, locations: list[str]) -> DataFrame:
    """Causes by locations; cells say where the values are from (C5). rows: cause, location, source_detail."""
    return rows.groupBy("cause").pivot("location", locations).agg(F.first("source_detail"))


def needs_footnote(rows: DataFrame) -> DataFrame:
    """Whether any row has a flag, by metric."""
    return rows.groupBy("metric").agg(F.max(F.col("flag") != "").alias("footnote"))


def observed_summary(series: DataFrame, keys: list[str], sources: DataFrame | None = None) -> DataFrame:
    """First and last value of each series and the change between them.

    Where the series has limits (lower, upper), those of the last value too; sources (keys,
    population_source, death_source): where the numbers are from.
    """
    ends = [F.max_by(c, "year").alias(f"last_{c}") for c in ("lower", "upper") if c in series.columns]
    s = series.groupBy(*keys).agg(*ends, F.min_by("value", "year").alias("first"), F.max_by("value", "year").alias("last"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    change = F.col("last") - F.col("first")
    out = s.withColumns({"change": change, "percent": F.when(F.col("first") != 0, change / F.col("first") * 100)})
    return out if sources is None else out.join(sources.select(*keys, "population_source", "death_source"), keys, "left")
