"""Structural breaks of a fleet of yearly series: segmented trends by dynamic programming, in the row of each series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 5


def segment_costs(series: DataFrame, share: float = 0.15, trend: bool = True) -> DataFrame:
    """(series_id, n, i, j, rss): a line (or a mean) through places i + 1 to j of each series, of share * n places or more.

    Sums up to each place give those of any segment; places of one series meet each other
    only, and a series has tens of years.
    """
    w = Window.partitionBy("series_id").orderBy("year")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    t = series.withColumns({"t": F.row_number().over(w), "n": n})
    sums = t.withColumns({"sy": F.sum("value").over(run), "st": F.sum(F.col("t").cast("double")).over(run), "stt": F.sum((F.col("t") * F.col("t")).cast("double")).over(run), "sty": F.sum(F.col("t") * F.col("value")).over(run), "syy": F.sum(F.col("value") * F.col("value")).over(run)})
    names = ["sy", "st", "stt", "sty", "syy"]
    zero = t.where("t = 1").select("series_id", F.lit(0).alias("i"), *(F.lit(0.0).alias(f"a_{c}") for c in names))
    begin = zero.unionByName(sums.select("series_id", F.col("t").alias("i"), *(F.col(c).alias(f"a_{c}") for c in names)))
    end = sums.where("n >= 5").select(F.col("series_id").alias("sid"), "n", F.col("t").alias("j"), *names)
    least = F.greatest(F.lit(3 if trend else 2), F.floor(F.col("n") * share).cast("int"))
    s = begin.join(end, (F.col("series_id") == F.col("sid")) & (F.col("j") - F.col("i") >= least))
    m = (F.col("j") - F.col("i")).cast("double")
    d = {c: F.col(c) - F.col(f"a_{c}") for c in names}
    yy = d["syy"] - d["sy"] * d["sy"] / m
    ty, tt = d["sty"] - d["st"] * d["sy"] / m, d["stt"] - d["st"] * d["st"] / m
    rss = F.greatest(yy - (ty * ty / tt if trend else F.lit(0.0)), F.lit(0.0))
    return s.select("series_id", "n", "i", "j", rss.alias("rss"))


def _costs(y: np.ndarray, least: int, trend: bool) -> np.ndarray:
    """cost[s, i, j]: squared error of a line (or a mean) through places i + 1 to j of row s, infinite for fewer than `least` places."""
    n = y.shape[1]
    t = np.arange(1.0, n + 1)
    sums = [np.concatenate([np.zeros((len(y), 1)), np.cumsum(x, axis=1)], axis=1) for x in (y, t * y, y * y)]
    sy, sty, syy = (x[:, None, :] - x[:, :, None] for x in sums)
    st, stt = (np.concatenate([[0.0], np.cumsum(x)]) for x in (t, t * t))
    st, stt = st[None, :] - st[:, None], stt[None, :] - stt[:, None]
    m = np.arange(n + 1.0)[None, :] - np.arange(n + 1.0)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        rss = syy - sy * sy / m
        if trend:
            ty, tt = sty - st * sy / m, stt - st * st / m
            rss = rss - ty * ty / tt
    return np.where(m >= least, np.maximum(rss, 0.0), np.inf)


def best_breaks(y: np.ndarray, share: float, most: int, trend: bool) -> list[tuple | None]:
    """(n_breaks, breaks, rss, bic) of each row of y by the dynamic programme over segment costs; None where no segment fits.

    Of partitions that tie, the one with the smallest places counts: lists of equally many
    breaks are ranked from level to level, so that no list is compared.
    """
    rows, n = y.shape
    cost = _costs(y, max(3 if trend else 2, int(np.floor(n * share))), trend)
    at = np.arange(rows)[:, None]
    best, rank = cost[:, 0, :], np.broadcast_to(np.arange(n + 1), (rows, n + 1))
    ends, came = [best[:, n]], []
    for _ in range(most):
        through = best[:, :, None] + cost
        least = through.min(axis=1)
        tied = np.where(through == least[:, None, :], rank[:, :, None], n + 1)
        came.append(tied.argmin(axis=1))
        best = least
        rank = np.argsort(np.argsort(rank[at, came[-1]], axis=1, kind="stable"), axis=1, kind="stable")
        ends.append(best[:, n])
    rss = np.stack(ends, axis=1)
    k = 2 if trend else 1
    bic = n * (np.log(np.maximum(rss, 1e-12) / n) + math.log(2 * math.pi) + 1) + math.log(n) * ((k + 1) * (np.arange(most + 1) + 1))
    out: list[tuple | None] = []
    for r, c in enumerate(np.where(np.isfinite(rss), bic, np.inf).argmin(axis=1).tolist()):
        if not np.isfinite(rss[r, c]):
            out.append(None)
            continue
        places, j = [], n
        for level in range(c - 1, -1, -1):
            j = int(came[level][r, j])
            places.append(j)
        out.append((c, places[::-1], float(rss[r, c]), float(bic[r, c])))
    return out


_FOUND = "n_breaks int, breaks array<int>, rss double, bic double"
#: Cells of cost matrices that are worked on at once.
CELLS = 1 << 21


def _searched(series: DataFrame, share: float, most: int, model: Column) -> DataFrame:
    """series_id, model and the struct `f` (n_breaks, breaks, rss, bic) of series of five years or more; model: `trend`, `mean` or `none`, by n and h (share * n).

    A series becomes one row, which is searched there: one shuffle, whatever the number of
    breaks. Years without a value are left out.
    """

    @F.pandas_udf(_FOUND)
    def search(values: pd.Series, models: pd.Series) -> pd.DataFrame:
        found: list[tuple | None] = [None] * len(values)
        size = values.map(len)
        for (n, kind), group in pd.DataFrame({"n": size.to_numpy(), "kind": models.to_numpy()}).groupby(["n", "kind"]).groups.items():
            step = max(1, CELLS // (n + 1) ** 2)
            for part in (group[k : k + step] for k in range(0, len(group), step)):
                if kind != "none":
                    for i, x in zip(part, best_breaks(np.stack([np.asarray(values.iloc[i], float) for i in part]), share, most, kind == "trend"), strict=True):
                        found[i] = x
                else:
                    for i in part:
                        found[i] = (0, [], None, None)
        names = ["n_breaks", "breaks", "rss", "bic"]
        whole = [x or (None,) * 4 for x in found]
        kinds = ["Int32", object, float, float]
        return pd.DataFrame({c: pd.Series([x[k] for x in whole], dtype=kinds[k]) for k, c in enumerate(names)})

    years = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("year", "value"))))
    s = series.groupBy("series_id").agg(F.transform(years, lambda x: x["value"]).alias("values"))
    s = s.withColumn("n", F.size("values")).withColumn("h", F.floor(F.col("n") * share)).where("n >= 5").withColumn("model", model)
    return s.withColumn("f", search("values", "model")).where("f.n_breaks IS NOT NULL").select("series_id", "model", "f")


def breakpoints(series: DataFrame, share: float = 0.15, most: int = MOST, trend: bool = True) -> DataFrame:
    """(series_id, n_breaks, breaks, rss, bic): places after which a new segment begins, their number by BIC (B1).

    Series of fewer than five years have no row.
    """
    return _searched(series, share, most, F.lit("trend" if trend else "mean")).select("series_id", "f.*")


def chosen_breaks(series: DataFrame, share: float = 0.15, most: int = MOST) -> DataFrame:
    """As breakpoints, with the model of each series (B1).

    A segment has share * n years. A line needs more than two of them: where they aren't
    there, the series falls back to a mean, which needs more than one; where that fails too,
    it has no break and model is `none`. Series of fewer than five years have no row.
    """
    model = F.when(F.col("h") > 2, "trend").when(F.col("h") == 2, "mean").otherwise("none")
    return _searched(series, share, most, model).select("series_id", "f.*", "model")


def segments(series: DataFrame, found: DataFrame) -> DataFrame:
    """First and last year, length, mean and slope of each segment (B2); break_year is the last year before the next."""
    w = Window.partitionBy("series_id").orderBy("year")
    t = series.withColumn("t", F.row_number().over(w)).join(found.select("series_id", "breaks"), "series_id")
    t = t.withColumn("segment", F.size(F.filter("breaks", lambda b: b < F.col("t"))) + 1).withColumn("_last", F.size("breaks") + 1)
    g = t.groupBy("series_id", "segment").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("length"), F.avg("value").alias("mean"), F.regr_slope("value", "year").alias("slope"), F.max("_last").alias("_last")
    )
    return g.withColumn("break_year", F.when(F.col("segment") < F.col("_last"), F.col("last_year"))).drop("_last")


def on_seams(segment_table: DataFrame, seams: DataFrame) -> DataFrame:
    """Breaks at a seam of the population, or the year before it."""
    b = segment_table.where("break_year IS NOT NULL").select("series_id", "break_year")
    near = F.broadcast(seams.select("seam", F.explode(F.array(F.col("seam") - 1, F.col("seam"))).alias("break_year")))
    return b.join(near, "break_year").select("series_id", "break_year", "seam")


def break_class(n_breaks: Column) -> Column:
    """none, one or many (B4); the model used stands beside it in chosen_breaks."""
    return F.when(n_breaks == 0, "none").when(n_breaks == 1, "one").otherwise("many")
