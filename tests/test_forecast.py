"""Forecasts and breaks: errors by hand, known shapes found again."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitals.operators import breaks
from vitals.operators import forecast as fc

SERIES = "series_id string, year int, value double"


@pytest.mark.parametrize(("n", "share", "k"), [(21, 0.25, 5), (21, 0.40, 8), (4, 0.25, 1), (3, 0.25, 0), (5, 0.90, 2)])
def test_sizes(spark, n, share, k):
    assert spark.range(1).select(fc.test_size(F.lit(n), share).alias("k")).first()["k"] == k


def test_errors(spark):
    p = spark.createDataFrame([("s", 100.0, 110.0), ("s", 200.0, 190.0), ("s", 300.0, 330.0)], "series_id string, actual double, predicted double")
    r = fc.errors(p, ["series_id"], spark.createDataFrame([("s", 50.0)], "series_id string, scale double")).first()
    assert (r["me"], r["mae"], r["mase"]) == pytest.approx((10, 50 / 3, 1 / 3))


def test_lines_go_on(spark):
    s = spark.createDataFrame([("up", 2000 + k, 10.0 + 3 * k) for k in range(15)] + [("short", 2000, 1.0)], SERIES)
    fleet = fc.arrays(s)
    assert [r["series_id"] for r in fc.failures(fleet).collect()] == ["short"]
    got = {(r["model"], r["year"]): r["mean"] for r in fc.forecast(fleet, 3, ["naive", "drift", "holt", "ets"]).collect()}
    assert got["naive", 2016] == 52
    for m in ("drift", "holt", "ets"):
        assert got[m, 2017] == pytest.approx(61, abs=0.2)
    best = fc.recommended(fc.rolling(s, 0.3, ["naive", "drift"])).collect()
    assert [(r["series_id"], r["model"]) for r in best] == [("up", "drift")]


def test_break_is_found(spark):
    rows = [("b", 1990 + k, (5.0 if k < 10 else 50.0) + 0.1 * ((k * 7) % 5)) for k in range(20)] + [("n", 1990 + k, 5.0 + 0.1 * ((k * 7) % 5)) for k in range(20)]
    s = spark.createDataFrame(rows, SERIES)
    found = breaks.breakpoints(s)
    got = {r["series_id"]: r["breaks"] for r in found.collect()}
    assert got["b"] == [10] and got["n"] == []
    table = breaks.segments(s, found).where("series_id = 'b'").orderBy("segment").collect()
    assert [(r["first_year"], r["last_year"], r["break_year"]) for r in table] == [(1990, 1999, 1999), (2000, 2009, None)]


def test_holdout_covers_every_held_out_year(spark):
    """A smoothing model against its own forecast from the years before; more than 30 held-out years are refused."""
    rng = np.random.default_rng(6)
    values = np.cumsum(rng.normal(0.2, 1, 140)) + 50
    series = spark.createDataFrame([("x", 1800 + k, float(v)) for k, v in enumerate(values)], SERIES)
    with pytest.raises(ValueError, match="30"):
        fc.holdout(series, 0.3, ["naive"])
    (got,) = fc.holdout(series.where("year < 1850"), 0.3, ["theta"]).collect()
    made = {r["year"]: r["mean"] for r in fc.MODELS["theta"](fc.arrays(series.where("year < 1835")), 15).collect()}
    assert got["mae"] == pytest.approx(np.mean([abs(made[1800 + k] - values[k]) for k in range(35, 50)]))


def test_breaks_fall_back_to_a_mean(spark):
    rows = [(name, 1990 + k, (5.0 if k < n // 2 else 50.0) + 0.1 * ((k * 7) % 5)) for name, n in (("trend", 20), ("mean", 14), ("none", 8), ("short", 4)) for k in range(n)]
    got = {r["series_id"]: (r["model"], r["breaks"]) for r in breaks.chosen_breaks(spark.createDataFrame(rows, SERIES)).collect()}
    assert got == {"trend": ("trend", [10]), "mean": ("mean", [7]), "none": ("none", [])}


def test_failures_by_model(spark):
    fleet = fc.arrays(spark.createDataFrame([("big", 2000 + k, 1e308 if k % 2 else -1e308) for k in range(6)] + [("ok", 2000 + k, float(k * k)) for k in range(6)] + [("short", 2000, 1.0)], SERIES))
    made = fc.forecast(fleet, 2, ["naive", "drift"]).withColumn("mean", F.when((F.col("series_id") == "big") & (F.col("model") == "drift"), float("nan")).otherwise(F.col("mean")))
    got = {(r["series_id"], r["model"]): r["status"] for r in fc.model_failures(fleet, made, ["naive", "drift"]).collect()}
    assert got == {("big", "drift"): "no finite forecast", ("short", "naive"): "too short", ("short", "drift"): "too short"}


def test_validation_names_its_years(spark):
    s = spark.createDataFrame([("a", 2000 + k, float(k)) for k in range(10)] + [("b", 2000 + k, float(k)) for k in range(3)], SERIES)
    got = {r["series_id"]: r for r in fc.validated(s, "rolling", 0.3, ["naive"]).collect()}
    assert [got["a"][c] for c in ("method", "train_first", "train_last", "test_first", "test_last")] == ["rolling", 2000, 2006, 2007, 2009]
    assert (got["b"]["method"], got["b"]["test_first"]) == ("insample", None) and got["b"]["note"]


def test_refined_fit_beats_the_grid(spark):
    """The fit is no worse than any of very many points tried by hand."""
    rng = np.random.default_rng(3)
    v = np.cumsum(rng.normal(0.5, 2, 25)) + 40
    got = fc.smoothed(fc.arrays(spark.createDataFrame([("x", 1990 + k, float(x)) for k, x in enumerate(v)], SERIES)), "holt").first()

    def sse(a, b):
        level, trend, s = v[0], v[1] - v[0], 0.0
        for y in v[1:]:
            ahead = level + trend
            s += (y - ahead) ** 2
            new = a * y + (1 - a) * ahead
            trend, level = b * (new - level) + (1 - b) * trend, new
        return s

    assert got["state"]["sse"] == pytest.approx(sse(got["p"]["alpha"], got["p"]["beta"]))
    assert got["state"]["sse"] <= 1.002 * min(sse(a, b) for a in np.linspace(0.05, 0.99, 60) for b in np.linspace(0.01, 0.7, 60))


def test_partial_autocorrelation_against_the_recursion(spark):
    rng = np.random.default_rng(2)
    rows = [(s, k, float(x)) for s in ("a", "b") for k, x in enumerate(rng.normal(0, 1, 30))]
    acf = fc.autocorrelation(spark.createDataFrame(rows, "series_id string, t int, e double"), 8)
    got = {(r["series_id"], r["lag"]): r["pacf"] for r in fc.partial_autocorrelation(acf).collect()}
    for s in ("a", "b"):
        r = [x["acf"] for x in acf.where(F.col("series_id") == s).orderBy("lag").collect()]
        for k in range(1, 9):  # the last coefficient of the Yule-Walker equations
            m = np.array([[1.0 if i == j else r[abs(i - j) - 1] for j in range(k)] for i in range(k)])
            assert got[s, k] == pytest.approx(np.linalg.solve(m, r[:k])[-1])


def test_breaks_against_every_partition():
    """Costs and the choice against least squares over all partitions, with ties of exact lines."""
    rng = np.random.default_rng(8)
    rows = rng.normal(0, 1, (6, 13))
    rows[0] = 2.0  # every partition has the same error
    rows[1] = np.where(np.arange(13) < 6, 1.0, 9.0)
    for trend in (False, True):
        for y, got in zip(rows, breaks.best_breaks(rows, 0.2, 3, trend), strict=True):
            cost = lambda v: float(np.sum((v - (np.polyval(np.polyfit(np.arange(len(v)), v, 1), np.arange(len(v))) if trend else v.mean())) ** 2))
            least, n = (3 if trend else 2), len(y)
            options = []
            for c in range(4):
                for at in itertools.combinations(range(1, n), c):
                    ends = [0, *at, n]
                    if min(b - a for a, b in itertools.pairwise(ends)) >= least:
                        options.append((c, list(at), sum(cost(y[a:b]) for a, b in itertools.pairwise(ends))))
            bic = lambda c, r: n * (np.log(max(r, 1e-12) / n) + np.log(2 * np.pi) + 1) + np.log(n) * ((3 if trend else 2) * (c + 1))
            assert got[3] == pytest.approx(min(bic(c, r) for c, _, r in options), abs=1e-6)
            assert [r for c, at, r in options if at == got[1]] == [pytest.approx(got[2], abs=1e-9)] and len(got[1]) == got[0]
    assert breaks.best_breaks(rows[:1], 0.2, 3, False)[0][:2] == (0, [])
    assert breaks.best_breaks(np.zeros((1, 4)), 2.0, 3, False) == [None]
