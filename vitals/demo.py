"""Facts for the registered queries, derived by Spark from the given tables, and the same in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ten bands of five years; the last three stand for "75 and over"; the first ten standard weights.
BANDS = [(k, f"{5 * k} - {5 * k + 4}", 5.0 * k + 2, w, k < 7) for k, w in enumerate([5000.0, 5500.0, 5500.0, 5500.0, 6000.0, 6000.0, 6500.0, 7000.0, 7000.0, 7000.0])]
GROUPS = [("LARGE", "preventable", None), ("MEDIUM", "preventable", None), ("SMALL", "treatable", None), ("PROMO", "treatable", None), ("ECONOMY", "unresolved", "cannot be split")]
SEAMS = [(1998, "first seam"), (2000, "second seam")]
PRIORITY = [("S1", 1), ("S2", 2)]
#: Years of life lost count up to this age.
CUTOFF = 35.0
THIN_BIRTHS = 250.0
#: Line items that a task joins at once.
LINES = 1_000_000


class Facts:
    """DataFrames over the tables of a folder; nothing is read before a query uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def bands(self) -> DataFrame:
        return self.spark.createDataFrame(BANDS, "band_idx int, age_band string, mid double, weight double, under boolean")

    @cached_property
    def groups(self) -> DataFrame:
        return self.spark.createDataFrame(GROUPS, "cause string, `group` string, reason string")

    @cached_property
    def seams(self) -> DataFrame:
        return self.spark.createDataFrame(SEAMS, "seam int, effect string")

    @cached_property
    def priority(self) -> DataFrame:
        return self.spark.createDataFrame(PRIORITY, "source_indicator string, priority int")

    @cached_property
    def parts(self) -> int:
        """In how many parts joins of the line items are dealt: one for LINES of them, so that a task's share doesn't grow with the tables."""
        return -(-self.table("lineitem").count() // LINES)

    def _dealt(self, df: DataFrame, key: str) -> DataFrame:
        """The keyed side of a join, dealt in enough parts; the line items follow it, unless it is small enough to broadcast.

        The number is given even where it is the usual one, as adaptive execution would put parts
        together until a task has 64 MB of compressed rows.
        """
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(max(self.parts, usual), key) if self.parts > 1 else df

    @cached_property
    def base(self) -> DataFrame:
        nation = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        placed = self.table("orders").join(self._dealt(self.table("customer"), "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        # orders come last, so that what is counted by order needs no further shuffle
        return (
            self.table("lineitem")
            .join(self._dealt(self.table("part"), "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self._dealt(placed, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.year("l_shipdate").alias("year"),
                F.col("n_name").alias("area"),
                F.when(F.col("l_linestatus") == "O", "H").otherwise("M").alias("sex"),
                F.col("p_type").alias("cause"),
                F.least(F.floor((F.col("p_size") - 1) / 5), F.lit(9)).cast("int").alias("band_idx"),
                (F.col("l_returnflag") == "R").alias("dead"),
                "l_quantity",
                "l_linenumber",
                "o_orderkey",
                "p_size",
            )
        )

    def _both(self, df: DataFrame, cause: bool) -> DataFrame:
        """Rows for both sexes, and for all causes, beside the parts."""
        df = df.withColumn("sex", F.explode(F.array("sex", F.lit("HM"))))
        return df.withColumn("cause", F.explode(F.array("cause", F.lit("ALL")))) if cause else df

    @cached_property
    def cells(self) -> DataFrame:
        """Every count by year, area, sex, cause and band, from one pass over the line items.

        As many rows as there are cells, whatever the tables hold; kept, as deaths and
        population are both read from it.
        """
        one, two, dead = F.col("l_linenumber") <= 3, F.col("l_linenumber") >= 3, F.col("dead")
        count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
        size = lambda c: F.sum(F.when(c, F.col("l_quantity")).otherwise(0.0))
        sums = {"deaths": count(dead), "pop": F.sum("l_quantity"), "infant": count(dead & (F.col("p_size") == 1))}
        for name, lines in (("S1", one), ("S2", two)):
            sums |= {f"deaths_{name}": count(dead & lines), f"n_{name}": count(lines), f"pop_{name}": size(lines)}
        return self.base.groupBy("year", "area", "sex", "cause", "band_idx").agg(*(v.alias(k) for k, v in sums.items())).persist()

    @cached_property
    def deaths(self) -> DataFrame:
        parts = self.cells.where("deaths > 0").select("year", "area", "sex", "cause", "band_idx", "deaths")
        both = self._both(parts, True).groupBy("year", "area", "sex", "cause", "band_idx").agg(F.sum("deaths").alias("deaths"))
        return both.join(F.broadcast(self.bands.select("band_idx", "age_band")), "band_idx")

    @cached_property
    def pop(self) -> DataFrame:
        both = self._both(self.cells.select("year", "area", "sex", "band_idx", "pop"), False).groupBy("year", "area", "sex", "band_idx").agg(F.sum("pop").alias("pop"))
        return both.join(F.broadcast(self.bands.select("band_idx", "age_band")), "band_idx")

    def _sourced(self, cells: DataFrame, keys: list[str], value: str, some: str) -> DataFrame:
        """Two sources that overlap: S1 has lines 1 to 3, S2 has 3 and more."""
        each = F.array(*(F.struct(F.lit(s).alias("s"), F.col(f"{value}_{s}").alias("v"), F.col(f"{some}_{s}").alias("n")) for s in ("S1", "S2")))
        return cells.select(*keys, F.explode(each).alias("x")).where("x.n > 0").select(*keys, F.col("x.s").alias("source_indicator"), F.col("x.v").alias(value))

    @cached_property
    def source_deaths(self) -> DataFrame:
        return self._sourced(self.cells, ["year", "area", "sex", "cause", "band_idx"], "deaths", "deaths")

    @cached_property
    def source_pop(self) -> DataFrame:
        keys = ["year", "area", "sex", "band_idx"]
        summed = self.cells.groupBy(*keys).agg(*(F.sum(f"{c}_{s}").alias(f"{c}_{s}") for c in ("pop", "n") for s in ("S1", "S2")))
        return self._sourced(summed, keys, "pop", "n")

    @cached_property
    def births(self) -> DataFrame:
        # a row per year and area, read more than once by some queries: kept
        return self.base.groupBy("year", "area").agg(F.count_distinct("o_orderkey").cast("double").alias("births")).persist()

    @cached_property
    def infant(self) -> DataFrame:
        parts = self.cells.where("infant > 0").groupBy("year", "area", "sex", "cause").agg(F.sum("infant").alias("deaths"))
        return self._both(parts, True).groupBy("year", "area", "sex", "cause").agg(F.sum("deaths").alias("deaths"))

    @cached_property
    def lookup(self) -> DataFrame:
        """One row per municipality and vintage."""
        n = self.table("nation").join(F.broadcast(self.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
        code = F.concat(F.col("n_regionkey").cast("string"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
        vintage = F.explode(F.array(F.lit("A"), F.lit("B")))
        n = n.select(F.col("n_name").alias("municipality"), code.alias("municipality_code"), "n_nationkey", "n_regionkey", "r_name", vintage.alias("vintage"))
        return n.select(
            "municipality",
            "municipality_code",
            F.when(F.col("n_regionkey") < 3, "MAINLAND").otherwise(F.col("r_name")).alias("nuts1"),
            F.when(F.col("vintage") == "A", F.col("r_name")).otherwise(F.concat(F.lit("G"), (F.col("n_nationkey") % 4).cast("string"))).alias("nuts2"),
            F.concat(F.lit("T"), (F.col("n_nationkey") % 8).cast("string")).alias("nuts3"),
            "vintage",
        )

    @cached_property
    def full(self) -> DataFrame:
        from vitals.operators.rates import joined

        return joined(self.deaths, self.pop)

    @cached_property
    def series(self) -> DataFrame:
        """Yearly crude rates by area and cause, both sexes: series_id, year, value."""
        r = self.full.where("sex = 'HM'").groupBy("area", "cause", "year").agg(F.sum("deaths").alias("d"), F.sum("pop").alias("p"))
        # one number per area, cause and year, read by every model and origin: kept
        return r.select(F.concat_ws("|", "area", "cause").alias("series_id"), "year", (F.col("d") / F.col("p") * 1e5).alias("value")).persist()

    @cached_property
    def daily(self) -> DataFrame:
        """Daily counts of events by type: series_id, year (the day's number), value."""
        e = self.table("events").select(F.col("event_type").alias("series_id"), F.datediff("ts", F.lit("2024-01-01")).alias("year"))
        return e.groupBy("series_id", "year").agg(F.count(F.lit(1)).cast("double").alias("value")).persist()


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v)
    return ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


#: The same facts as common table expressions of DuckDB.
SQL = f"""
base AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, n_name AS area, CASE l_linestatus WHEN 'O' THEN 'H' ELSE 'M' END AS sex, p_type AS cause,
    least((p_size - 1) // 5, 9) AS band_idx, l_returnflag = 'R' AS dead, l_quantity, l_linenumber, o_orderkey, p_size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
bands(band_idx, age_band, mid, weight, under) AS (VALUES {_values(BANDS)}),
groups(cause, grp, reason) AS (VALUES {_values(GROUPS)}),
seams(seam, effect) AS (VALUES {_values(SEAMS)}),
priority(source_indicator, priority) AS (VALUES {_values(PRIORITY)}),
deaths AS (SELECT year, area, s.sex, c.cause, band_idx, age_band, CAST(count(*) AS DOUBLE) AS deaths
  FROM base JOIN bands USING (band_idx), unnest([base.sex, 'HM']) AS s(sex), unnest([base.cause, 'ALL']) AS c(cause) WHERE dead GROUP BY ALL),
pop AS (SELECT year, area, s.sex, band_idx, age_band, sum(l_quantity) AS pop FROM base JOIN bands USING (band_idx), unnest([base.sex, 'HM']) AS s(sex) GROUP BY ALL),
source_deaths AS (SELECT year, area, sex, cause, band_idx, source_indicator, CAST(count(*) AS DOUBLE) AS deaths FROM base, (VALUES ('S1'), ('S2')) AS v(source_indicator)
  WHERE dead AND ((source_indicator = 'S1' AND l_linenumber <= 3) OR (source_indicator = 'S2' AND l_linenumber >= 3)) GROUP BY ALL),
source_pop AS (SELECT year, area, sex, band_idx, source_indicator, sum(l_quantity) AS pop FROM base, (VALUES ('S1'), ('S2')) AS v(source_indicator)
  WHERE (source_indicator = 'S1' AND l_linenumber <= 3) OR (source_indicator = 'S2' AND l_linenumber >= 3) GROUP BY ALL),
births AS (SELECT year, area, CAST(count(DISTINCT o_orderkey) AS DOUBLE) AS births FROM base GROUP BY ALL),
infant AS (SELECT year, area, s.sex, c.cause, CAST(count(*) AS DOUBLE) AS deaths FROM base, unnest([base.sex, 'HM']) AS s(sex), unnest([base.cause, 'ALL']) AS c(cause) WHERE dead AND p_size = 1 GROUP BY ALL),
lookup AS (SELECT n_name AS municipality, CAST(n_regionkey AS VARCHAR) || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS municipality_code,
    CASE WHEN n_regionkey < 3 THEN 'MAINLAND' ELSE r_name END AS nuts1, CASE vintage WHEN 'A' THEN r_name ELSE 'G' || (n_nationkey % 4) END AS nuts2, 'T' || (n_nationkey % 8) AS nuts3, vintage
  FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('A'), ('B')) AS v(vintage)),
members AS (SELECT DISTINCT vintage, region, municipality FROM lookup, unnest([nuts1, nuts2, nuts3]) AS u(region)),
fullf AS (SELECT d.*, p.pop FROM deaths d JOIN pop p USING (year, area, sex, band_idx, age_band)),
series AS (SELECT area || '|' || cause AS series_id, year, sum(deaths) / sum(pop) * 1e5 AS value FROM fullf WHERE sex = 'HM' GROUP BY area, cause, year),
daily AS (SELECT event_type AS series_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL)
"""
