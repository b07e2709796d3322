"""Rates, pooling, indirect standardisation and avoidable mortality on hand-checked frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitals.functions import intervals
from vitals.operators import avoidable, pooling, rates

BANDS = "age_band string, band_idx int, weight double, mid double, under boolean"
FULL = "year int, area string, sex string, cause string, age_band string, deaths double, pop double"


def bands(spark):
    from vitals.functions.labels import band_midpoint
    from vitals.schema import age_bands

    return age_bands(spark).select("age_band", "band_idx", "weight", band_midpoint(F.col("age_band")).alias("mid"), F.col("under75").alias("under"))


def full(spark, rows):
    return spark.createDataFrame([(2020, "A", "HM", "c", b, float(d), float(p)) for b, d, p in rows], FULL)


def test_poisson_limits_against_tables():
    lower, upper = intervals.poisson_limits(np.array([0, 1, 10, 25]))
    assert lower == pytest.approx([0, 0.0253, 4.7954, 16.1787], abs=5e-4)
    assert upper == pytest.approx([3.6889, 5.5716, 18.3904, 36.9049], abs=5e-4)


def test_poisson_limits_are_quantiles():
    lower, upper = (x[0] for x in intervals.poisson_limits(np.array([1000])))
    at_most = lambda k, m: sum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(k + 1))
    assert at_most(1000, upper) == pytest.approx(0.025, abs=1e-9)
    assert at_most(999, lower) == pytest.approx(0.975, abs=1e-9)


def test_binomial_limits():
    lower, upper = intervals.binomial_limits(np.array([30, 100, 0]), np.array([100, 100, 100]))
    assert lower == pytest.approx([0.2124064, 0.9637833, 0], abs=1e-6)
    assert upper == pytest.approx([0.3998147, 1, 0.0362167], abs=1e-6)


def test_crude_rate(spark):
    r = rates.crude_rate_limits(full(spark, [("0 - 4 anos", 20, 50_000), ("5 - 9 anos", 130, 40_000)])).first()
    assert r["rate"] == pytest.approx(150 / 90_000 * 1e5)
    assert r["lower"] == pytest.approx(intervals.poisson_limits(np.array([150]))[0][0] / 90_000 * 1e5)


def test_standardised_rates(spark):
    b = bands(spark)
    names = [r["age_band"] for r in b.orderBy("band_idx").collect()]
    f = full(spark, [(x, 100, 100_000) for x in names])
    assert rates.standardised_rate(f, b).first()["rate"] == pytest.approx(100)
    f = full(spark, [(x, 100 if k < 15 else 1000, 100_000) for k, x in enumerate(names)])
    got = {r["scope"]: r["rate"] for r in rates.standardised_rate(rates.scoped(f, b), b, [*rates.SERIES, "scope"]).collect()}
    assert got["under75"] == pytest.approx(100) and got["total"] == pytest.approx(100 + 900 * 0.09)
    few = full(spark, [(names[0], 4, 1000)])
    assert rates.standardised_rate(few, b).first()["rate"] is None
    assert rates.standardised_rate(few, b, min_count=0).first()["rate"] == pytest.approx(400)


def test_years_lost(spark):
    b = bands(spark)
    f = full(spark, [("0 - 4 anos", 3, 1), ("30 - 34 anos", 10, 1), ("60 - 64 anos", 25, 1), ("80 - 84 anos", 40, 1)])
    assert rates.years_lost(f, b, 70.0).first()["ypll"] == pytest.approx(782.5)
    late = full(spark, [("80 - 84 anos", 25, 1)])
    r = rates.years_lost_limits(late, b, 70.0).first()
    assert (r["ypll"], r["lower"], r["upper"]) == (0, 0, 0)


def test_infant_split(spark):
    f = full(spark, [("0 - 4 anos", 286, 10), ("30 - 34 anos", 10, 10)])
    u = spark.createDataFrame([(2020, "A", "HM", "c", 254.0)], "year int, area string, sex string, cause string, deaths double")
    got = {r["age_band"]: (r["deaths"], r["pop"]) for r in rates.split_youngest(f, u, rates.SERIES).collect()}
    assert got == {"< 1 ano": (254, None), "1 - 4 anos": (32, None), "30 - 34 anos": (10, 10)}
    more = spark.createDataFrame([(2020, "A", "HM", "c", 999.0)], u.schema)
    assert {r["age_band"]: r["deaths"] for r in rates.split_youngest(f, more, rates.SERIES).collect()}["1 - 4 anos"] == 0


def test_infant_rate_and_flag(spark):
    i = spark.createDataFrame([(2000, "A", 254.0), (2000, "B", 0.0), (2000, "C", 3.0)], "year int, area string, deaths double")
    b = spark.createDataFrame([(2000, "A", 84642.0), (2000, "B", 999.0), (2000, "C", 0.0)], "year int, area string, births double")
    got = {r["area"]: r for r in rates.infant_rate_limits(i, b, ["year", "area"], 1000).collect()}
    assert got["A"]["rate"] == pytest.approx(3.0, abs=0.01) and got["A"]["flag"] == ""
    assert got["B"]["rate"] == 0 and got["B"]["upper"] > 0 and got["B"]["flag"] == "*"
    assert got["C"]["rate"] is None and got["C"]["note"] == "no births"


def test_pooling_over_a_gap_and_edges(spark):
    rows = [(2000, "A", 10.0, 1000.0), (2002, "A", 30.0, 1000.0), (2000, "B", 1.0, 5.0), (2001, "B", 1.0, 5.0), (2002, "B", 1.0, 5.0)]
    f = spark.createDataFrame(rows, "year int, area string, deaths double, pop double")
    got = {(r["year"], r["area"]): r for r in pooling.pooled(f, 3, ["area"]).collect()}
    assert got[2001, "A"]["deaths"] == 40 and got[2001, "A"]["n_years"] == 2 and got[2001, "A"]["period_label"] == "2000-2002"
    assert got[2000, "A"]["deaths"] == 10 and got[2000, "A"]["period_label"] == "2000"


@pytest.mark.parametrize(("given", "window"), [(3, 3), (0, 1), ("x", 1), (None, 1)])
def test_window(given, window):
    assert pooling.pooling_window(given) == window


def test_even_window_is_an_error():
    with pytest.raises(ValueError, match="odd"):
        pooling.pooling_window(4)


def test_smr_of_itself_and_of_twice_the_risk(spark):
    names = ["0 - 4 anos", "30 - 34 anos", "60 - 64 anos"]
    base = [(n, d, p) for n, d, p in zip(names, (20, 60, 300), (10_000, 20_000, 50_000), strict=True)]
    f = full(spark, base).unionByName(full(spark, [(n, 2 * d, p) for n, d, p in base]).withColumn("area", F.lit("B")))
    got = {r["area"]: r for r in pooling.smr_series(f, "A", rates.SERIES).collect()}
    assert got["A"]["smr"] == pytest.approx(100) and got["A"]["class"] == "no significant difference"
    assert got["B"]["smr"] == pytest.approx(200) and got["B"]["class"] == "above"


def test_avoidable_parts_add_up(spark):
    b = bands(spark)
    g = spark.createDataFrame([("p", "preventable", None), ("t", "treatable", None), ("u", "unresolved", "why")], "cause string, `group` string, reason string")
    names = ["0 - 4 anos", "5 - 9 anos", "10 - 14 anos", "85 e mais anos"]
    rows = [(2020, "A", "HM", c, n, float(d), 10_000.0) for n in names for c, d in (("p", 10), ("t", 5), ("u", 20), ("ALL", 100))]
    f = spark.createDataFrame(rows, FULL)
    got = {r["group"]: r["deaths"] for r in avoidable.breakdown(f, g, b, ["year", "area", "sex"], "ALL").collect()}
    assert got == {"preventable": 30, "treatable": 15, "avoidable": 45, "unresolved": 60, "other": 195, "total": 300}
    pop = f.select("year", "area", "sex", "age_band", "pop").distinct()
    one = avoidable.group_rate(f, pop, g, b, ["year", "area", "sex"]).where("group = 'avoidable'").first()["rate"]
    twice = f.unionByName(f.withColumn("area", F.lit("B")))
    both = avoidable.group_rate(twice, twice.select("year", "area", "sex", "age_band", "pop").distinct(), g, b, ["year", "sex"]).where("group = 'avoidable'").first()["rate"]
    assert one == pytest.approx(150) and both == pytest.approx(one)


def test_bundle_and_selection_have_limits(spark):
    b = bands(spark)
    names = [r["age_band"] for r in b.orderBy("band_idx").collect()]
    f = full(spark, [(x, 100, 100_000) for x in names])
    bundle = rates.observed_bundle(f, b)
    got = {(r["scope"], r["rate_type"]): r for r in bundle.collect()}
    assert len(got) == 4 and all(r["lower"] < r["rate"] < r["upper"] for r in got.values())
    n = 100 * len(names)
    low, high = (x[0] for x in intervals.poisson_limits(np.array([n])))
    assert (got["total", "crude"]["lower"], got["total", "crude"]["upper"]) == pytest.approx((low / (n * 1000) * 1e5, high / (n * 1000) * 1e5))
    assert rates.selected_series(bundle, "total", "dsr", 1990, 2050).first()["lower"] < 100
    with pytest.raises(Exception, match="no year of the range"):
        rates.selected_series(bundle, "total", "dsr", 1990, 2000).collect()


def test_annual_table_pools_over_gaps_and_splits_where_covered(spark):
    from vitals.operators import annual

    years = [2000, 2001, 2002]
    rows = [(y, a, "HM", c, b, d, 1000.0) for y in years for a in ("X", "Ref") for c, d in (("ALL", 20.0), ("c", 5.0)) for b in ("0 - 4", "5 - 9") if not (y == 2001 and a == "X" and c == "c")]
    full = spark.createDataFrame(rows, "year int, area string, sex string, cause string, age_band string, deaths double, pop double")
    bands = spark.createDataFrame([("0 - 4", 2.5, 1.0), ("5 - 9", 7.5, 1.0)], "age_band string, mid double, weight double")
    infant = spark.createDataFrame([(y, "X", "HM", "ALL", 4.0) for y in years] + [(2000, "X", "HM", "c", 1.0)], "year int, area string, sex string, cause string, deaths double")
    births = spark.createDataFrame([(2000, "X", 500.0), (2001, "X", 700.0)], "year int, area string, births double")
    got = annual.annual_table(full, bands, infant, births, "HM", "Ref", "ALL", 70.0, 1000.0, windows=(1, 3), youngest=("0 - 4", 0.5, 3.0))
    at = {(r["location"], r["cause"], r["metric"], r["window"], r["year"]): r for r in got.collect()}
    assert ("X", "c", "deaths", 1, 2001) not in at and at["X", "c", "deaths", 3, 2001]["value"] == pytest.approx(20 / 3)
    assert (at["X", "ALL", "deaths", 3, 2001]["n_years"], at["X", "ALL", "deaths", 3, 2001]["period"]) == (3, "2000-2002")
    assert at["X", "ALL", "crude", 3, 2001]["value"] == pytest.approx(2000) and at["X", "ALL", "smr", 3, 2001]["value"] == pytest.approx(100)
    isr = at["X", "ALL", "isr", 3, 2001]
    assert isr["value"] == pytest.approx(2000) and isr["lower"] < 2000 < isr["upper"]
    # births reach 2001 only, so windows of the rate hold the years up to it
    rate = at["X", "ALL", "infant", 3, 2001]
    assert (rate["value"], rate["period"], rate["n_years"], rate["flag"]) == (pytest.approx(8 / 1200 * 1000), "2000-2001", 2, "")
    assert at["X", "c", "infant_deaths", 1, 2000]["value"] == 1 and at["X", "c", "infant_deaths", 3, 2001]["value"] is None
    # 12 under one of 60 in the youngest band
    assert at["X", "ALL", "ypll", 3, 2001]["value"] == pytest.approx((12 * 69.5 + 48 * 67 + 60 * 62.5) / 3)
    assert at["X", "c", "ypll", 3, 2001]["value"] == pytest.approx((10 * 67.5 + 10 * 62.5) / 3)
    assert "not apart" in at["X", "c", "ypll", 3, 2001]["source_detail"]


def test_bands_without_a_reference_are_named(spark):
    row = spark.createDataFrame([(4.0, 2.0, 0.5, 2, "0 - 4"), (30.0, 20.0, 0.5, 2, "")], "observed double, expected double, ref_rate double, bands_used int, missing_bands string")
    few, many = pooling.smr_exact(row).orderBy("observed").collect()
    assert few["excluded"].endswith("0 - 4") and many["excluded"] is None
    assert few["isr_lower"] < few["isr"] == 1e5 < few["isr_upper"] and few["isr_upper"] == pytest.approx(few["smr_upper"] / 100 * 0.5 * 1e5)
    assert many["isr_lower"] == pytest.approx(many["smr_lower"] / 100 * 0.5 * 1e5)


def test_limits_take_few_evaluations(monkeypatch):
    calls = {"gamma_p": 0, "beta_i": 0}
    for name in calls:
        own = getattr(intervals, name)

        def counted(*args, own=own, name=name):
            calls[name] += 1
            return own(*args)

        monkeypatch.setattr(intervals, name, counted)
    lower, upper = intervals.poisson_limits(np.array([3.0, 50.0, 1e6]))
    assert intervals.gamma_p(np.array([3.0, 50.0, 1e6]), lower) == pytest.approx(0.025, rel=1e-6)
    assert intervals.gamma_p(np.array([4.0, 51.0, 1e6 + 1]), upper) == pytest.approx(0.975, rel=1e-6)
    lower, upper = intervals.binomial_limits(np.array([3.0, 2e5]), np.array([40.0, 1e6]))
    assert intervals.beta_i(np.array([3.0, 2e5]), np.array([38.0, 8e5 + 1]), lower) == pytest.approx(0.025, rel=1e-6)
    assert intervals.beta_i(np.array([4.0, 2e5 + 1]), np.array([37.0, 8e5]), upper) == pytest.approx(0.975, rel=1e-6)
    assert max(calls.values()) < 30  # halving took more than 80
