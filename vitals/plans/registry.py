"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.demo import SQL, Facts

Build = Callable[[Facts], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, build: Build, sql: str | None = None) -> None:
    """A query over the derived facts. sql: a SELECT, after any further tables as `x AS (...)` and `---`."""
    if name in QUERIES:
        raise ValueError(f"two queries named {name}")
    QUERIES[name] = lambda spark, sf_dir: build(Facts(spark, sf_dir))
    if sql:
        more, _, last = sql.rpartition("---")
        ORACLE_SQL[name] = f"WITH RECURSIVE {SQL}{',' + more if more else ''} {last}"


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to six places, so that the order of a sum doesn't show."""
    return df.withColumns({c: _six(F.col(c)) for c in columns})


def _six(c: Column) -> Column:
    return F.round(c, 6) + 0.0


def limits_sql(counts: str, z: str = "0.975") -> str:
    """Tables `poisson` (k, lo, hi): exact limits of the counts `k` that a SELECT names, by halving on the sum of the probabilities."""
    at_most = "coalesce(list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: exp(i * ln(m) - m - lgamma(i + 1)))), 0)"
    return f"""pk AS (SELECT DISTINCT round_even(k, 0) AS k FROM ({counts}) WHERE k >= 0),
 ph AS (SELECT k, CAST(side AS INTEGER) AS side, CAST(0 AS DOUBLE) AS a, CAST(k + 1 + 12 * sqrt(k + 1) + 30 AS DOUBLE) AS b, 0 AS step FROM pk, (VALUES (0), (1)) AS v(side)
  UNION ALL SELECT k, side, CASE WHEN p > CASE side WHEN 1 THEN 1 - {z} ELSE {z} END THEN m ELSE a END, CASE WHEN p > CASE side WHEN 1 THEN 1 - {z} ELSE {z} END THEN b ELSE m END, step + 1
  FROM (SELECT *, CASE side WHEN 1 THEN {at_most.format(k="k")} ELSE {at_most.format(k="k - 1")} END AS p FROM (SELECT *, (a + b) / 2 AS m FROM ph WHERE step < 60))),
 poisson AS (SELECT k, coalesce(max(CASE WHEN side = 0 THEN CASE WHEN k = 0 THEN 0 ELSE (a + b) / 2 END END), 0) AS lo, max(CASE WHEN side = 1 THEN (a + b) / 2 END) AS hi FROM ph WHERE step = 60 GROUP BY k)"""


def r3(df: DataFrame, *columns: str) -> DataFrame:
    """Columns to three places: exact limits are found by halving, in another way in SQL."""
    return df.withColumns({c: F.round(F.col(c), 3) + 0.0 for c in columns})
