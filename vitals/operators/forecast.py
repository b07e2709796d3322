"""Forecasts of a fleet of yearly series: every model on every series in one job.

series: series_id, year, value. Each series becomes one row of ordered arrays; exponential
smoothing is fitted over a grid of parameters, and then finer ones around the best point, for
all series of an Arrow batch at once, so nothing is copied or shuffled per model, origin or
parameter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitals.functions.intervals import Z95, chi_square_tail

FORECAST = "series_id string, model string, year int, mean double, lower double, upper double"
_STEPS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99]
_TREND = [0.01, 0.05, 0.1, 0.2, 0.4, 0.7]
#: (model, alpha, beta, phi); phi 0 has no trend.
GRID = {
    "ses": [(a, 0.0, 0.0) for a in _STEPS],
    "holt": [(a, b, 1.0) for a in _STEPS for b in _TREND],
    "holt_damped": [(a, b, p) for a in _STEPS for b in _TREND for p in (0.8, 0.9, 0.98)],
}
#: Steps by which the best point of a grid is moved, one after another.
WIDTHS = (0.04, 0.02, 0.01, 0.005)
#: Free parameters with starting values and variance, for the information criterion.
_FREE = {"ses": 3, "holt": 5, "holt_damped": 6}


def logged(series: DataFrame) -> DataFrame:
    """Adds offset (half the smallest positive value, or 1e-6), n_zero, log_value (F1); series with a negative value are flagged."""
    w = Window.partitionBy("series_id")
    least = F.min(F.when(F.col("value") > 0, F.col("value"))).over(w)
    out = series.withColumns({"offset": F.coalesce(least / 2, F.lit(1e-6)), "n_zero": F.sum((F.col("value") == 0).cast("long")).over(w), "negative": F.min("value").over(w) < 0})
    return out.withColumn("log_value", F.when(~F.col("negative"), F.log(F.col("value") + F.col("offset"))))


def back(mean: Column, lower: Column, upper: Column, offset: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Mean and limits of a log forecast on the first scale (F2); the mean counts half the variance in."""
    sigma = (upper - mean) / z
    at = lambda x: F.greatest(F.exp(x) - offset, F.lit(0.0))
    return at(mean + sigma * sigma / 2), at(lower), at(upper)


def arrays(series: DataFrame, least: int = 3) -> DataFrame:
    """One row per series: years, values, n, and a status (F10): short and non-finite series are refused."""
    rows = F.sort_array(F.collect_list(F.struct("year", "value")))
    bad = F.max(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))
    s = series.groupBy("series_id").agg(rows.alias("r"), bad.alias("bad"))
    s = s.select("series_id", F.transform("r", lambda x: x["year"]).alias("years"), F.transform("r", lambda x: x["value"]).alias("values"), F.size("r").alias("n"), "bad")
    return s.withColumn("status", F.when(F.col("bad"), "values that are not finite").when(F.col("n") < least, "too short").otherwise("ok")).drop("bad")


def failures(fleet: DataFrame) -> DataFrame:
    return fleet.where("status <> 'ok'").select("series_id", "status")


def model_failures(fleet: DataFrame, made: DataFrame, models: list[str]) -> DataFrame:
    """(series_id, model, status) for what went without a forecast (F10): refused series under every model, and models that made no finite one.

    A model that fails on a series doesn't touch its other models; made: their forecasts.
    """
    finite = F.col("mean").isNotNull() & ~F.isnan("mean") & (F.abs("mean") < float("inf"))
    good = made.groupBy("series_id", "model").agg(F.min(finite).alias("_good"))
    every = fleet.select("series_id", F.col("status").alias("_s"), F.explode(F.array(*(F.lit(m) for m in models))).alias("model"))
    status = F.when(F.col("_s") != "ok", F.col("_s")).when(F.coalesce("_good", F.lit(False)), "ok").otherwise("no finite forecast")
    return every.join(good, ["series_id", "model"], "left").select("series_id", "model", status.alias("status")).where("status <> 'ok'")


def _ok(fleet: DataFrame) -> DataFrame:
    return fleet.where("status = 'ok'")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, v: x + v)


def _differences(v: Column, n: Column) -> Column:
    return F.zip_with(F.slice(v, F.lit(2), n - 1), F.slice(v, F.lit(1), n - 1), lambda b, a: b - a)


def horizon(df: DataFrame, h: int) -> DataFrame:
    """One row per year ahead (F9): h, year."""
    if not 1 <= h <= 30:
        raise ValueError("the horizon is 1 to 30 years")
    return df.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h)))).withColumn("year", F.element_at("years", -1) + F.col("h"))


def _limits(df: DataFrame, model: str, mean: Column, se: Column) -> DataFrame:
    return df.select("series_id", F.lit(model).alias("model"), "year", mean.alias("mean"), (mean - Z95 * se).alias("lower"), (mean + Z95 * se).alias("upper"))


def naive(fleet: DataFrame, h: int) -> DataFrame:
    """The last value."""
    v, n = F.col("values"), F.col("n")
    s = _ok(fleet).withColumn("s", F.sqrt(_sum(F.transform(_differences(v, n), lambda d: d * d)) / (n - 1)))
    return _limits(horizon(s, h), "naive", F.element_at("values", -1), F.col("s") * F.sqrt("h"))


def drift(fleet: DataFrame, h: int) -> DataFrame:
    """The last value and the mean change."""
    v, n = F.col("values"), F.col("n")
    s = _ok(fleet).withColumn("d", (F.element_at(v, -1) - v[0]) / (n - 1)).withColumn("diffs", _differences(v, n))
    s = s.withColumn("s", F.sqrt(_sum(F.zip_with("diffs", F.array_repeat("d", n - 1), lambda x, d: (x - d) * (x - d))) / (n - 2)))
    return _limits(horizon(s, h), "drift", F.element_at("values", -1) + F.col("h") * F.col("d"), F.col("s") * F.sqrt(F.col("h") * (1 + F.col("h") / (n - 1))))


def _runs(y: np.ndarray, n: np.ndarray, al: np.ndarray, be: np.ndarray, ph: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, trend and squared error after running over each row of y (n values each), for each point."""
    first, trended = y[:, :1], ph > 0
    level = first + np.zeros_like(al)
    trend = np.where(trended, y[:, 1:2] - first, 0.0)
    sse = np.zeros_like(level)
    for t in range(1, y.shape[1]):
        live, now = (t < n)[:, None], y[:, t : t + 1]
        ahead = level + ph * trend
        new = al * now + (1 - al) * ahead
        sse = np.where(live, sse + (now - ahead) * (now - ahead), sse)
        trend = np.where(live, np.where(trended, be * (new - level) + (1 - be) * ph * trend, 0.0), trend)
        level = np.where(live, new, level)
    return level, trend, sse


def best_points(values: list[np.ndarray], model: str) -> np.ndarray:
    """alpha, beta, phi, level, trend, squared error of the best point of each series: of the grid, then around it."""
    n = np.array([len(v) for v in values])
    y = np.zeros((len(values), n.max()))
    for k, v in enumerate(values):
        y[k, : len(v)] = v
    at = np.arange(len(values))
    points = [np.array(c, float)[None, :] for c in zip(*GRID[model], strict=True)]
    for width in (*WIDTHS, None):
        level, trend, sse = _runs(y, n, *points)
        i = np.where(np.isnan(sse), np.inf, sse).argmin(axis=1)
        best = [np.broadcast_to(c, sse.shape)[at, i] for c in (*points, level, trend, sse)]
        if width is None:
            return np.stack(best, axis=1)
        moves = np.array([-width, 0.0, width])
        al, be, ph = (c[:, None] for c in best[:3])
        al = np.clip(al + moves, 0.01, 0.99)
        be = be if model == "ses" else np.clip(be + moves, 0.001, 0.99)
        ph = np.clip(ph + moves / 4, 0.8, 0.98) if model == "holt_damped" else ph
        grid = np.broadcast_arrays(al[:, :, None, None], be[:, None, :, None], ph[:, None, None, :])
        points = [g.reshape(len(values), -1) for g in grid]
    raise AssertionError


def _fitted(v: Column, n: Column, p: Column) -> Column:
    """One-step-ahead values; the first is null."""
    trended = p["phi"] > 0
    start = F.struct(v[0].alias("l"), F.when(trended, v[1] - v[0]).otherwise(0.0).alias("b"), F.array(F.lit(None).cast("double")).alias("f"))

    def step(x: Column, y: Column) -> Column:
        ahead = x["l"] + p["phi"] * x["b"]
        level = p["alpha"] * y + (1 - p["alpha"]) * ahead
        trend = F.when(trended, p["beta"] * (level - x["l"]) + (1 - p["beta"]) * p["phi"] * x["b"]).otherwise(0.0)
        return F.struct(level.alias("l"), trend.alias("b"), F.concat(x["f"], F.array(ahead)).alias("f"))

    return F.aggregate(F.slice(v, F.lit(2), n - 1), start, step, lambda x: x["f"])


def smoothed(fleet: DataFrame, model: str) -> DataFrame:
    """The best parameters of each series: p (alpha, beta, phi), state (l, b, sse), aicc.

    All points of the grid are tried on all series of an Arrow batch at once, then those around
    the best one, with steps from WIDTHS[0] down to WIDTHS[-1]. Of points that tie, the smallest
    counts. Nothing is copied or shuffled per point; the same recursion in higher-order
    functions, which Spark interprets, took a hundred times as long.
    """

    @F.pandas_udf("alpha double, beta double, phi double, l double, b double, sse double")
    def fit(values: pd.Series) -> pd.DataFrame:
        names = ["alpha", "beta", "phi", "l", "b", "sse"]
        if not len(values):
            return pd.DataFrame({c: np.empty(0) for c in names})
        return pd.DataFrame(best_points([np.asarray(v, float) for v in values], model), columns=names)

    best = _ok(fleet).withColumn("f", fit("values"))
    best = best.select("series_id", "years", "values", "n", F.struct("f.alpha", "f.beta", "f.phi").alias("p"), F.struct("f.l", "f.b", "f.sse").alias("state"))
    k, m = _FREE[model], F.col("n")
    spare = m - k - 1
    penalty = F.when(spare > 0, 2.0 * k * (k + 1) / spare).otherwise(1e6)
    return best.withColumns({"model": F.lit(model), "aicc": m * F.log(F.greatest(F.col("state.sse"), F.lit(1e-12)) / m) + 2.0 * k + penalty})


def _ahead(best: DataFrame, h: int, name: str | None = None) -> DataFrame:
    s = horizon(best, h)
    phi = F.col("p.phi")
    damp = F.when(phi == 1, F.col("h").cast("double")).when(phi == 0, 0.0).otherwise(phi * (1 - F.pow(phi, F.col("h"))) / (1 - phi))
    sums = lambda j: F.when(phi == 1, j.cast("double")).when(phi == 0, 0.0).otherwise(phi * (1 - F.pow(phi, j)) / (1 - phi))
    terms = F.when(F.col("h") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("h") - 1, F.lit(1))), lambda j: F.pow(F.col("p.alpha") * (1 + F.col("p.beta") * sums(j)), F.lit(2)))).otherwise(F.array().cast("array<double>"))
    se = F.sqrt(F.col("state.sse") / (F.col("n") - 1)) * F.sqrt(1 + _sum(terms))
    out = _limits(s.withColumn("m", F.col("state.l") + damp * F.col("state.b")), "", F.col("m"), se)
    return out.withColumn("model", F.lit(name)) if name else out


def holt(fleet: DataFrame, h: int, damped: bool = False) -> DataFrame:
    """Linear trend (F6), or damped."""
    name = "holt_damped" if damped else "holt"
    return _ahead(smoothed(fleet, name), h, name)


def ets_choice(fleet: DataFrame) -> DataFrame:
    """The model without season of least AICc: no trend, trend, damped trend (F8)."""
    every = smoothed(fleet, "ses").unionByName(smoothed(fleet, "holt")).unionByName(smoothed(fleet, "holt_damped"))
    return every.groupBy("series_id").agg(F.min_by(F.struct("years", "values", "n", "p", "state", F.col("model").alias("form"), "aicc"), F.struct("aicc", "model")).alias("x")).select("series_id", "x.*")


def ets(fleet: DataFrame, h: int) -> DataFrame:
    return _ahead(ets_choice(fleet), h, "ets")


def _slope() -> Column:
    """Slope of a straight line through the values."""
    t = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i.cast("double"))
    mid_t, mid_v = (F.col("n") + 1) / 2, _sum(F.col("values")) / F.col("n")
    return _sum(F.zip_with(t, "values", lambda a, b: (a - mid_t) * (b - mid_v))) / _sum(F.transform(t, lambda a: (a - mid_t) * (a - mid_t)))


def theta(fleet: DataFrame, h: int) -> DataFrame:
    """Simple smoothing with half the slope of a straight line."""
    best = smoothed(fleet, "ses").withColumn("slope", _slope())
    s = horizon(best, h)
    a, n, k = F.col("p.alpha"), F.col("n"), F.col("h")
    mean = F.col("state.l") + F.col("slope") / 2 * (k - 1 + 1 / a - F.pow(1 - a, n) / a)
    return _limits(s, "theta", mean, F.sqrt(F.col("state.sse") / (n - 1)) * F.sqrt(1 + (k - 1) * a * a))


MODELS = {"naive": naive, "drift": drift, "theta": theta, "holt": holt, "holt_damped": lambda f, h: holt(f, h, True), "ets": ets}


def forecast(fleet: DataFrame, h: int, models: list[str]) -> DataFrame:
    out = None
    for m in models:
        one = MODELS[m](fleet, h)
        out = one if out is None else out.unionByName(one)
    return out


def fitted(fleet: DataFrame, model: str) -> DataFrame:
    """(series_id, model, year, value, fitted): one-step-ahead values."""
    v, n = F.col("values"), F.col("n")
    gone = F.array(F.lit(None).cast("double"))
    if model == "naive":
        s = _ok(fleet).withColumn("f", F.concat(gone, F.slice(v, F.lit(1), n - 1)))
    elif model == "drift":
        d = (F.element_at(v, -1) - v[0]) / (n - 1)
        s = _ok(fleet).withColumn("d", d).withColumn("f", F.concat(gone, F.zip_with(F.slice(v, F.lit(1), n - 1), F.array_repeat("d", n - 1), lambda a, b: a + b)))
    elif model == "theta":  # the level, and half the slope as far as smoothing lags behind it
        s = smoothed(fleet, "ses").withColumn("slope", _slope()).withColumn("f", _fitted(v, n, F.col("p")))
        a = F.col("p.alpha")
        s = s.withColumn("f", F.transform("f", lambda x, i: x + F.col("slope") / 2 * (1 / a - F.pow(1 - a, i) / a)))
    elif model == "ets":
        s = ets_choice(fleet).withColumn("f", _fitted(v, n, F.col("p")))
    else:
        s = smoothed(fleet, model).withColumn("f", _fitted(v, n, F.col("p")))
    z = s.select("series_id", F.explode(F.arrays_zip("years", "values", "f")).alias("z"))
    return z.select("series_id", F.lit(model).alias("model"), F.col("z.years").alias("year"), F.col("z.values").alias("value"), F.col("z.f").alias("fitted"))


def scale(series: DataFrame) -> DataFrame:
    """Mean absolute change of each series from row to row, the measure of MASE."""
    w = Window.partitionBy("series_id").orderBy("year")
    d = series.withColumn("d", F.abs(F.col("value") - F.lag("value").over(w)))
    return d.groupBy("series_id").agg(F.avg("d").alias("scale"))


def errors(pairs: DataFrame, keys: list[str], scales: DataFrame | None = None) -> DataFrame:
    """ME, RMSE, MAE, MAPE (actuals that aren't 0), MASE (F11). pairs: keys, actual, predicted."""
    e = F.col("predicted") - F.col("actual")
    p = pairs.where("actual IS NOT NULL AND predicted IS NOT NULL")
    out = p.groupBy(*keys).agg(
        F.avg(e).alias("me"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.avg(F.when(F.abs("actual") > 1e-8, F.abs(e / F.col("actual")))) * 100).alias("mape")
    )
    if scales is None:
        return out.withColumn("mase", F.lit(None).cast("double"))
    return out.join(scales, "series_id", "left").withColumn("mase", F.when(F.col("scale") > 0, F.col("mae") / F.col("scale"))).drop("scale")


def insample(series: DataFrame, models: list[str]) -> DataFrame:
    """Errors of fitted values on the scale of the values."""
    fleet = arrays(series)
    out = None
    for m in models:
        f = fitted(fleet, m)
        out = f if out is None else out.unionByName(f)
    return errors(out.select("series_id", "model", F.col("value").alias("actual"), F.col("fitted").alias("predicted")), ["series_id", "model"], scale(series))


def test_size(n: Column, fraction: float, least_train: int = 3) -> Column:
    """How many years to hold out."""
    k = F.least(F.greatest(F.lit(1), F.bround(n * fraction, 0).cast("int")), n - least_train)
    return F.when(n < least_train + 1, 0).otherwise(k).cast("int")


def holdout(series: DataFrame, fraction: float, models: list[str]) -> DataFrame:
    """Errors on the last years, forecast from all before them (F15); more than 30 held-out years are refused."""
    last = Window.partitionBy("series_id")
    s = series.withColumns({"n": F.count(F.lit(1)).over(last), "i": F.row_number().over(last.orderBy("year"))})
    s = s.withColumn("k", test_size(F.col("n").cast("int"), fraction))
    most = s.agg(F.max("k")).first()[0] or 1  # one number: the longest horizon that any series needs
    train = s.where("i <= n - k AND k > 0")
    actual = s.where("i > n - k AND k > 0").select("series_id", (F.col("i") - (F.col("n") - F.col("k"))).alias("step"), F.col("value").alias("actual"))
    f = forecast(arrays(train.select("series_id", F.col("i").alias("year"), "value")), most, models)
    ends = train.groupBy("series_id").agg(F.max("i").alias("end"))
    p = f.join(ends, "series_id").select("series_id", "model", (F.col("year") - F.col("end")).alias("step"), F.col("mean").alias("predicted")).join(actual, ["series_id", "step"])
    return errors(p, ["series_id", "model"], scale(train.select("series_id", "year", "value")))


def rolling(series: DataFrame, fraction: float, models: list[str]) -> DataFrame:
    """One-step errors over every test year, each forecast from all years before it (F16).

    Each series and origin is a short series of its own, so origins run side by side.
    """
    a = arrays(series).withColumn("k", test_size(F.col("n"), fraction)).where("status = 'ok' AND k > 0")
    origin = a.withColumn("m", F.explode(F.sequence(F.col("n") - F.col("k"), F.col("n") - 1)))
    name = F.concat_ws("~", "series_id", F.lpad(F.col("m").cast("string"), 4, "0"))
    cut = origin.select(name.alias("series_id"), F.slice("years", F.lit(1), F.col("m")).alias("years"), F.slice("values", F.lit(1), F.col("m")).alias("values"), F.col("m").alias("n"), F.lit("ok").alias("status"))
    actual = origin.select(name.alias("part"), F.col("series_id").alias("of"), F.get("values", F.col("m")).alias("actual"))
    p = forecast(cut, 1, models).join(actual, F.col("series_id") == F.col("part")).select(F.col("of").alias("series_id"), "model", "actual", F.col("mean").alias("predicted"))
    return errors(p, ["series_id", "model"], scale(series))


def validated(series: DataFrame, method: str, fraction: float, models: list[str]) -> DataFrame:
    """Errors by the method asked for, in-sample where a series is too short to hold years out.

    train_first to test_last are the years learnt from and tested on, null in-sample.
    """
    if method not in ("insample", "single", "rolling"):
        raise ValueError(f"no method {method!r}")
    names = ("train_first", "train_last", "test_first", "test_last")
    inside = insample(series, models).withColumns({c: F.lit(None).cast("int") for c in names})
    if method == "insample":
        return inside.withColumns({"method": F.lit(method), "note": F.lit("")})
    out = (holdout if method == "single" else rolling)(series, fraction, models)
    held = arrays(series).withColumn("k", test_size(F.col("n"), fraction)).where("k > 0")
    at = lambda i: F.get("years", i).cast("int")
    cut = F.col("n") - F.col("k")
    out = out.join(held.select("series_id", *(at(i).alias(c) for c, i in zip(names, (F.lit(0), cut - 1, cut, F.col("n") - 1), strict=True))), "series_id", "left")
    missing = inside.join(out.select("series_id").distinct(), "series_id", "left_anti")
    return out.withColumns({"method": F.lit(method), "note": F.lit("")}).unionByName(missing.withColumns({"method": F.lit("insample"), "note": F.lit("too short to hold years out")}))


def ranked(metrics: DataFrame) -> DataFrame:
    """Models of each series by RMSE, MAE, MASE, MAPE, then name (F19); the first is recommended."""
    by = [F.when(F.isnan(c), None).otherwise(F.col(c)).asc_nulls_last() for c in ("rmse", "mae", "mase", "mape")]
    return metrics.withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy(*by, "model")))


def recommended(metrics: DataFrame) -> DataFrame:
    return ranked(metrics).where("rank = 1").select("series_id", "model")


def projection(series: DataFrame, fc: DataFrame) -> DataFrame:
    """Last observed and last projected value, and the change."""
    o = series.groupBy("series_id").agg(F.max_by("value", "year").alias("observed"), F.max("year").alias("observed_year"))
    f = fc.groupBy("series_id", "model").agg(F.max_by(F.struct("mean", "lower", "upper"), "year").alias("x"), F.max("year").alias("projected_year"))
    change = F.col("projected") - F.col("observed")
    j = f.join(o, "series_id").select("series_id", "model", "observed_year", "observed", "projected_year", F.col("x.mean").alias("projected"), F.col("x.lower").alias("lower"), F.col("x.upper").alias("upper"))
    return j.withColumns({"change": change, "percent": F.when(F.col("observed") != 0, change / F.col("observed") * 100)})


def reliability(series: DataFrame, fc: DataFrame, chosen: DataFrame) -> DataFrame:
    """A score of 0 to 6 by length, width of the interval and agreement of models (F21). chosen: series_id, model."""
    n = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    ends = fc.groupBy("series_id", "model").agg(F.max_by(F.struct("mean", "lower", "upper"), "year").alias("x"))
    spread = ends.groupBy("series_id").agg((F.max("x.mean") - F.min("x.mean")).alias("spread"))
    j = ends.join(chosen, ["series_id", "model"]).join(spread, "series_id").join(n, "series_id")
    width = (F.col("x.upper") - F.col("x.lower")) / F.greatest(F.col("x.mean"), F.lit(1e-6))
    agree = F.col("spread") / F.greatest(F.abs(F.col("x.mean")), F.lit(1e-6))
    points = lambda c, two, one: F.when(c < two, 2).when(c < one, 1).otherwise(0)
    score = F.when(F.col("n") >= 15, 2).when(F.col("n") >= 8, 1).otherwise(0) + points(width, 0.25, 0.6) + points(agree, 0.15, 0.35)
    return j.select("series_id", "model", width.alias("interval_ratio"), agree.alias("agreement_ratio"), score.alias("score")).withColumn("level", F.when(F.col("score") >= 5, "high").when(F.col("score") >= 3, "moderate").otherwise("low"))


def trend_class(percent: Column) -> Column:
    """stable within five percent, else up or down."""
    return F.when(F.abs(percent) < 5, "stable").when(percent > 0, "up").otherwise("down")


def observed_and_forecast(series: DataFrame, fc: DataFrame) -> DataFrame:
    """(series_id, year, observed, model, mean, lower, upper), all years of either."""
    return series.withColumnRenamed("value", "observed").join(fc, ["series_id", "year"], "full_outer")


def wide_forecast(series: DataFrame, fc: DataFrame, models: list[str]) -> DataFrame:
    """One column of means per model."""
    both = series.select("series_id", "year", F.lit("observed").alias("model"), F.col("value").alias("mean")).unionByName(fc.select("series_id", "year", "model", "mean"))
    return both.groupBy("series_id", "year").pivot("model", ["observed", *models]).agg(F.first("mean"))


def residuals(fits: DataFrame) -> DataFrame:
    """(series_id, t, e) of fitted values, without the first."""
    w = Window.partitionBy("series_id").orderBy("year")
    return fits.where("fitted IS NOT NULL").select("series_id", F.row_number().over(w).alias("t"), (F.col("value") - F.col("fitted")).alias("e"))


def autocorrelation(res: DataFrame, most: int = 20) -> DataFrame:
    """(series_id, n, lag, acf) up to the smaller of `most` and n - 1."""
    w = Window.partitionBy("series_id")
    c = res.withColumns({"n": F.count(F.lit(1)).over(w), "c": F.col("e") - F.avg("e").over(w)}).where("n >= 3")
    total = c.groupBy("series_id", "n").agg(F.sum(F.col("c") * F.col("c")).alias("s"))
    lagged = c.select("series_id", "n", "t", "c", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), (F.col("n") - 1).cast("int")))).alias("lag"))
    other = c.select("series_id", F.col("t").alias("t2"), F.col("c").alias("c2"))
    j = lagged.join(other, (lagged["series_id"] == other["series_id"]) & (F.col("t2") == F.col("t") - F.col("lag"))).select(lagged["series_id"], "lag", (F.col("c") * F.col("c2")).alias("x"))
    return j.groupBy("series_id", "lag").agg(F.sum("x").alias("x")).join(total, "series_id").select("series_id", "n", "lag", F.when(F.col("s") > 0, F.col("x") / F.col("s")).alias("acf"))


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """(series_id, lag, pacf) by the Durbin-Levinson recursion over the ordered lags of a series."""
    r = F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda x: x["acf"])
    rows = acf.groupBy("series_id").agg(r.alias("r"))
    dot = lambda phi, other: _sum(F.zip_with(phi, other, lambda a, b: a * b))
    none = F.array().cast("array<double>")

    def step(x: Column, k: Column) -> Column:
        known = F.slice(F.col("r"), F.lit(1), k)
        low = 1 - dot(x["phi"], known)
        a = F.when(F.abs(low) > 1e-12, (F.get("r", k) - dot(x["phi"], F.reverse(known))) / low).otherwise(F.lit(float("nan")))
        phi = F.concat(F.zip_with(x["phi"], F.reverse(x["phi"]), lambda p, q: p - a * q), F.array(a))
        return F.struct(phi.alias("phi"), F.concat(x["out"], F.array(a)).alias("out"))

    start = F.struct(none.alias("phi"), none.alias("out"))
    out = F.aggregate(F.sequence(F.lit(0), F.size("r") - 1), start, step, lambda x: x["out"])
    return rows.select("series_id", F.posexplode(out).alias("lag", "pacf")).withColumn("lag", F.col("lag") + 1)


def ljung_box(acf: DataFrame, fitdf: int = 0, lags: tuple[int, ...] = (5, 10, 15)) -> DataFrame:
    """(series_id, lags, statistic, p_value) for lags within the series and over fitdf."""
    wanted = F.array_distinct(F.transform(F.array(*(F.lit(x) for x in lags)), lambda x: F.least(x, (F.col("n") - 1).cast("int"))))
    each = acf.withColumn("lags", F.explode(wanted)).where((F.col("lags") > fitdf) & (F.col("lag") <= F.col("lags")))
    q = each.groupBy("series_id", "n", "lags").agg(F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("s"))
    q = q.select("series_id", "lags", (F.col("n") * (F.col("n") + 2) * F.col("s")).alias("statistic"))
    return q.withColumn("p_value", chi_square_tail(F.col("statistic"), (F.col("lags") - fitdf).cast("double")))
