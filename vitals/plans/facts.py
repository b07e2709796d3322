"""Queries of scans, normalisation, merging, geography and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.demo import Facts
from vitals.functions import labels as L
from vitals.operators import geo, merge, quality
from vitals.plans.registry import add, r6
from vitals.sources import facts as S

YEARS, AREAS, CAUSES = [1996, 1997, 1998], ["NATION_1", "NATION_2", "NATION_3"], ["LARGE", "SMALL"]
DK, PK = ["year", "area", "sex", "cause", "band_idx"], ["year", "area", "sex", "band_idx"]
_Y, _A, _C = "(1996, 1997, 1998)", "('NATION_1', 'NATION_2', 'NATION_3')", "('LARGE', 'SMALL')"

# ---- scans

add("S1_population_scan", lambda f: S.scan_population(f.source_pop, YEARS, AREAS, "band_idx"), f"SELECT year, area, sex, band_idx, source_indicator, sum(pop) AS pop FROM source_pop WHERE year IN {_Y} AND area IN {_A} GROUP BY ALL")
add("S2_deaths_scan", lambda f: S.scan_deaths(f.source_deaths, YEARS, AREAS, CAUSES, "band_idx"), f"SELECT year, area, sex, cause, band_idx, source_indicator, sum(deaths) AS deaths FROM source_deaths WHERE year IN {_Y} AND area IN {_A} AND cause IN {_C} GROUP BY ALL")
add(
    "S3_chunk_scan",
    lambda f: S.scan_chunks(f.source_deaths, f.priority, YEARS, CAUSES, AREAS).groupBy("source_indicator", "priority", "year", "cause").agg(F.sum("deaths").alias("deaths"), F.count(F.lit(1)).alias("n_rows")),
    f"SELECT source_indicator, priority, year, cause, sum(deaths) AS deaths, count(*) AS n_rows FROM source_deaths s JOIN priority USING (source_indicator) WHERE year IN {_Y} AND cause IN {_C} AND EXISTS (SELECT 1 FROM source_deaths t WHERE t.source_indicator = s.source_indicator AND t.year = s.year AND t.cause = s.cause AND t.area IN {_A}) GROUP BY ALL",
)
add("S4_population_chunks", lambda f: S.scan_population_chunks(f.source_pop, YEARS, AREAS), f"SELECT year, area, sex, band_idx, source_indicator, pop FROM source_pop WHERE year IN {_Y} AND area IN {_A}")
add("S5_births_scan", lambda f: S.scan_births(f.births, YEARS, AREAS), f"SELECT * FROM births WHERE year IN {_Y} AND area IN {_A}")
add("S6_infant_scan", lambda f: S.scan_infant_deaths(f.infant, YEARS, None, "ALL", "HM"), f"SELECT * FROM infant WHERE year IN {_Y} AND cause = 'ALL' AND sex = 'HM'")
add("S7_lookup_scan", lambda f: S.scan_lookup(f.lookup, "B"), "SELECT * FROM lookup WHERE vintage = 'B'")


def _batch(f: Facts) -> tuple[DataFrame, DataFrame]:
    cols = ["year", "cause", "area", "sex", "band_idx", "deaths"]
    one = f.source_deaths.where("source_indicator = 'S1'").select(cols)
    return one, f.source_deaths.where("source_indicator = 'S2' AND year >= 1998 AND cause IN ('LARGE', 'PROMO')").select(cols)


add(
    "S9_chunk_upsert",
    lambda f: S.upserted(*_batch(f)),
    "n AS (SELECT year, cause, area, sex, band_idx, deaths FROM source_deaths WHERE source_indicator = 'S2' AND year >= 1998 AND cause IN ('LARGE', 'PROMO')) --- SELECT year, cause, area, sex, band_idx, deaths FROM source_deaths s WHERE source_indicator = 'S1' AND NOT EXISTS (SELECT 1 FROM n WHERE n.year = s.year AND n.cause = s.cause AND n.area = s.area) UNION ALL SELECT * FROM n",
)
add(
    "S10_population_merge",
    lambda f: S.merged_population(f.source_pop.where("source_indicator = 'S2'"), f.source_pop.where("source_indicator = 'S1' AND year < 1999"), f.priority, PK),
    "SELECT coalesce(n.year, o.year) AS year, coalesce(n.area, o.area) AS area, coalesce(n.sex, o.sex) AS sex, coalesce(n.band_idx, o.band_idx) AS band_idx, coalesce(n.pop, o.pop) AS pop, CASE WHEN n.pop IS NULL THEN 'stored' ELSE 'S1' END AS source_indicator FROM (SELECT * FROM source_pop WHERE source_indicator = 'S2') o FULL JOIN (SELECT * FROM source_pop WHERE source_indicator = 'S1' AND year < 1999) n ON o.year = n.year AND o.area = n.area AND o.sex = n.sex AND o.band_idx = n.band_idx",
)
add(
    "S11_snapshot_summary",
    lambda f: S.snapshot(f.source_pop, f.source_deaths, f.priority, PK, DK)[2],
    "SELECT 'population' AS dataset, count(*) AS n_rows, min(year) AS first_year, max(year) AS last_year FROM (SELECT DISTINCT year, area, sex, band_idx FROM source_pop) UNION ALL SELECT 'deaths', count(*), min(year), max(year) FROM (SELECT DISTINCT year, area, sex, cause, band_idx FROM source_deaths)",
)

# ---- normalisation


def _raw(f: Facts) -> DataFrame:
    """Line items dressed as raw indicator rows: codes, labels, roll-up bands, local numbers."""
    i = F.col("l_linenumber")
    band = F.element_at(F.array(*(F.lit(x) for x in ("Menos de 1 ano", "1 - 4 anos", "5 - 9 anos", "Total", "Idade ignorada", "85 e mais anos", "10 - 14 anos"))), ((i - 1) % 7 + 1).cast("int"))
    value = F.replace(F.regexp_replace(F.format_number("l_extendedprice", 2), ",", " "), F.lit("."), F.lit(","))
    return f.table("lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.when(i == 1, "T").when(i == 2, "1").when(i == 3, "2").alias("sex_code"),
        F.when(i % 3 == 0, "Mulheres").when(i % 3 == 1, "Homens").otherwise("other").alias("sex_label"),
        band.alias("age_band"),
        F.when(i == 5, "x").when(i == 6, "...").otherwise(value).alias("number"),
        F.when(i == 7, "Total").otherwise(F.col("l_returnflag")).alias("area"),
        F.lit("S1").alias("source_indicator"),
        F.col("l_quantity").alias("value"),
    )


_RAW = """raw AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CASE l_linenumber WHEN 1 THEN 'T' WHEN 2 THEN '1' WHEN 3 THEN '2' END AS sex_code,
 CASE l_linenumber % 3 WHEN 0 THEN 'Mulheres' WHEN 1 THEN 'Homens' ELSE 'other' END AS sex_label,
 ['Menos de 1 ano', '1 - 4 anos', '5 - 9 anos', 'Total', 'Idade ignorada', '85 e mais anos', '10 - 14 anos'][(l_linenumber - 1) % 7 + 1] AS age_band,
 CASE WHEN l_linenumber IN (5, 6) THEN NULL ELSE round(l_extendedprice, 2) END AS number, CASE l_linenumber WHEN 7 THEN 'Total' ELSE l_returnflag END AS area, l_quantity AS value FROM lineitem) --- """

add("N1_sex_recode", lambda f: _raw(f).groupBy(L.sex_code(F.col("sex_code"), F.col("sex_label")).alias("sex")).agg(F.count(F.lit(1)).alias("n")), _RAW + "SELECT coalesce(CASE sex_code WHEN 'T' THEN 'HM' WHEN '1' THEN 'H' WHEN '2' THEN 'M' END, CASE sex_label WHEN 'Mulheres' THEN 'M' WHEN 'Homens' THEN 'H' ELSE sex_label END) AS sex, count(*) AS n FROM raw GROUP BY ALL")
add("N2_band_fold", lambda f: _raw(f).groupBy(L.folded_band(F.col("age_band")).alias("age_band")).agg(F.sum("value").alias("value")), _RAW + "SELECT CASE WHEN age_band IN ('Menos de 1 ano', '1 - 4 anos') THEN '0 - 4 anos' ELSE age_band END AS age_band, sum(value) AS value FROM raw GROUP BY 1")
add("N3_no_roll_ups", lambda f: L.no_roll_ups(_raw(f)).groupBy("age_band").agg(F.count(F.lit(1)).alias("n")), _RAW + "SELECT age_band, count(*) AS n FROM raw WHERE age_band NOT IN ('Total', 'Idade ignorada') GROUP BY ALL")
add("N4_real_areas", lambda f: L.real_areas(_raw(f)).groupBy("area").agg(F.count(F.lit(1)).alias("n")), _RAW + "SELECT area, count(*) AS n FROM raw WHERE area NOT IN ('Total', 'Ignorado', 'Estrangeiro') GROUP BY ALL")
add("N5_population_refold", lambda f: S.refolded(_raw(f), ["year", "area"], "value"), _RAW + "SELECT year, area, CASE WHEN age_band IN ('Menos de 1 ano', '1 - 4 anos') THEN '0 - 4 anos' ELSE age_band END AS age_band, sum(value) AS value FROM raw WHERE age_band NOT IN ('Total', 'Idade ignorada') GROUP BY ALL")
add("N6_deaths_refold", lambda f: S.refolded(_raw(f), ["year", "area", "sex_label"], "value"), _RAW + "SELECT year, area, sex_label, CASE WHEN age_band IN ('Menos de 1 ano', '1 - 4 anos') THEN '0 - 4 anos' ELSE age_band END AS age_band, sum(value) AS value FROM raw WHERE age_band NOT IN ('Total', 'Idade ignorada') GROUP BY ALL")
add("N7_local_numbers", lambda f: r6(_raw(f).groupBy("age_band").agg(F.sum(L.local_number(F.col("number"))).alias("total"), F.count(L.local_number(F.col("number"))).alias("n")), "total"), _RAW + "SELECT age_band, round(sum(number), 6) AS total, count(number) AS n FROM raw GROUP BY ALL")
add("N8_plain_label", lambda f: f.table("part").select(L.plain_label(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" /("), F.col("p_type"), F.lit("): "))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "SELECT trim(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_type), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS label, count(*) AS n FROM part GROUP BY ALL")
add("N9_token", lambda f: f.table("part").select(L.token(F.concat(F.lit("Ção "), F.col("p_brand"), F.lit(" - "), F.col("p_type"), F.lit("!"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "SELECT 'cao_' || trim(regexp_replace(lower(p_brand || '_' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS token, count(*) AS n FROM part GROUP BY ALL")


def _categories(f: Facts) -> DataFrame:
    return f.table("nation").select(F.concat(F.lit("Nation: "), F.col("n_name")).alias("label"), F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("code"), F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("id"))


def _asked(f: Facts) -> DataFrame:
    return f.table("customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("requested")).unionByName(f.table("supplier").select(F.concat(F.lit("nation nation_"), F.col("s_nationkey").cast("string")).alias("requested"))).distinct()


add("N10_category_match", lambda f: L.matched_categories(_asked(f), _categories(f)), "SELECT DISTINCT 'c' || c_nationkey AS requested, 'c' || c_nationkey AS code FROM customer UNION SELECT 'nation nation_' || s_nationkey, 'c' || s_nationkey FROM supplier")


def _indicator_categories(f: Facts) -> DataFrame:
    return f.source_deaths.where("NOT (source_indicator = 'S2' AND cause = 'PROMO')").select(F.col("source_indicator").alias("indicator"), F.col("cause").alias("code"), F.concat_ws(" ", "source_indicator", "cause").alias("label")).distinct()


add("N11_common_causes", lambda f: L.common_categories(_indicator_categories(f), "S2"), "c AS (SELECT DISTINCT source_indicator AS indicator, cause AS code, source_indicator || ' ' || cause AS label FROM source_deaths WHERE NOT (source_indicator = 'S2' AND cause = 'PROMO')) --- SELECT code, coalesce(max(label) FILTER (indicator = 'S2'), min(label)) AS label FROM c GROUP BY code HAVING count(DISTINCT indicator) = (SELECT count(DISTINCT indicator) FROM c)")
add("N12_dimension_pins", lambda f: L.pinned(f.deaths, {"sex": "HM", "cause": "ALL"}, ["year", "area"], "deaths"), "SELECT year, area, sum(deaths) AS deaths FROM deaths WHERE sex = 'HM' AND cause = 'ALL' GROUP BY ALL")
add(
    "N13_catalogue",
    lambda f: L.catalogue(f.source_deaths.withColumns({"cause_order": F.length("cause").cast("string"), "cause_level": F.when(F.col("cause") == "LARGE", "1").otherwise("x")}), "cause"),
    "SELECT source_indicator, cause AS category, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS n_years, CAST(length(cause) AS DOUBLE) AS \"order\", CASE cause WHEN 'LARGE' THEN 1.0 END AS level FROM source_deaths GROUP BY ALL",
)
add("N14_midpoints", lambda f: f.pop.groupBy("age_band").agg(F.count(F.lit(1)).alias("n")).select("age_band", "n", L.band_midpoint(F.col("age_band")).alias("mid")), "SELECT age_band, count(*) AS n, CASE WHEN age_band LIKE '0 - 4%' THEN 2.5 ELSE (5 * band_idx + 5 * band_idx + 4) / 2 END AS mid FROM pop GROUP BY age_band, band_idx")
add("N15_period_label", lambda f: f.deaths.groupBy("cause", "area").agg(L.period(F.min("year"), F.max("year")).alias("period")), "SELECT cause, area, CASE WHEN min(year) = max(year) THEN CAST(min(year) AS VARCHAR) ELSE min(year) || '-' || max(year) END AS period FROM deaths GROUP BY ALL")


def _metrics(f: Facts) -> DataFrame:
    m = F.explode(F.array(*(F.lit(x) for x in ("deaths", "smr", "crude")))).alias("metric")
    return f.full.where("sex = 'HM'").groupBy("area", "cause").agg((F.sum("deaths") / F.sum("pop") * 1000).alias("value")).select("area", "cause", "value", m)


add(
    "N16_metric_rounding",
    lambda f: _metrics(f).select("area", "cause", "metric", L.rounded_metric(F.col("metric"), F.col("value")).alias("value")),
    "SELECT area, cause, metric, CASE metric WHEN 'deaths' THEN round_even(v, 0) WHEN 'smr' THEN round_even(v, 1) ELSE round_even(v, 2) END AS value FROM (SELECT area, cause, sum(deaths) / sum(pop) * 1000 AS v FROM fullf WHERE sex = 'HM' GROUP BY ALL), unnest(['deaths', 'smr', 'crude']) AS u(metric)",
)
add(
    "N17_interval_text",
    lambda f: f.pop.groupBy("area").agg(F.sum("pop").alias("v")).select("area", L.interval_text(F.col("v"), F.when(F.col("v") % 2 == 0, F.col("v") - 1), F.col("v") + 1, 0).alias("text")),
    "SELECT area, CASE WHEN v % 2 = 0 THEN format('{:.0f} ({:.0f}; {:.0f})', v, v - 1, v + 1) ELSE format('{:.0f}', v) END AS text FROM (SELECT area, sum(pop) AS v FROM pop GROUP BY ALL)",
)
add("N18_source_list", lambda f: f.source_deaths.groupBy("year", "area").agg(L.source_list(F.col("source_indicator")).alias("sources")), "SELECT year, area, string_agg(DISTINCT source_indicator, ', ' ORDER BY source_indicator) AS sources FROM source_deaths GROUP BY ALL")
add(
    "N19_list_overflow",
    lambda f: f.deaths.groupBy("year", "cause").agg(L.list_with_overflow(F.col("area"), 3).alias("areas")),
    "SELECT year, cause, array_to_string(a[1:3], ', ') || CASE WHEN len(a) > 3 THEN ' +' || (len(a) - 3) ELSE '' END AS areas FROM (SELECT year, cause, list_sort(list_distinct(list(area))) AS a FROM deaths GROUP BY ALL)",
)
add("N20_year_span", lambda f: f.deaths.groupBy("area").agg(L.year_span(F.col("year")).alias("span")), "SELECT area, min(year) || ' - ' || max(year) || ' (' || count(DISTINCT year) || ')' AS span FROM deaths GROUP BY ALL")
add(
    "N21_year_selection",
    lambda f: f.deaths.where("year <> 1998 OR area > 'NATION_2'").groupBy("area").agg(L.year_selection(F.col("year")).alias("years")),
    "SELECT area, CASE WHEN max(year) - min(year) + 1 = count(DISTINCT year) THEN min(year) || ' - ' || max(year) ELSE string_agg(DISTINCT CAST(year AS VARCHAR), ', ' ORDER BY CAST(year AS VARCHAR)) END AS years FROM deaths WHERE year <> 1998 OR area > 'NATION_2' GROUP BY ALL",
)
add(
    "N22_selection_label",
    lambda f: f.lookup.groupBy("vintage", "nuts3").agg(F.sort_array(F.collect_set("municipality")).alias("a")).select("vintage", "nuts3", L.selection_label(F.col("a"), F.when(F.col("nuts3") == "T0", "mine")).alias("label")),
    "SELECT vintage, nuts3, CASE WHEN max(nuts3) = 'T0' THEN 'mine' WHEN count(*) = 1 THEN min(municipality) ELSE 'sum of ' || count(*) || ' places' END AS label FROM lookup GROUP BY vintage, nuts3",
)

# ---- merging

_BEST = "row_number() OVER (PARTITION BY {k} ORDER BY priority DESC, source_indicator) = 1"
add("M1_priority_merge", lambda f: merge.by_priority(f.source_deaths, f.priority, DK, "deaths"), "SELECT year, area, sex, cause, band_idx, deaths, source_indicator FROM source_deaths JOIN priority USING (source_indicator) QUALIFY " + _BEST.format(k="year, area, sex, cause, band_idx"))
add("M1_priority_population", lambda f: merge.by_priority(f.source_pop, f.priority, PK, "pop"), "SELECT year, area, sex, band_idx, pop, source_indicator FROM source_pop JOIN priority USING (source_indicator) QUALIFY " + _BEST.format(k="year, area, sex, band_idx"))
add("M2_source_plan", lambda f: merge.source_plan(f.source_pop.where("source_indicator = 'S1' OR year > 1997"), f.priority), "SELECT year, arg_max(source_indicator, priority) AS source_indicator FROM source_pop JOIN priority USING (source_indicator) WHERE source_indicator = 'S1' OR year > 1997 GROUP BY year")
add("M3_infant_plan", lambda f: merge.with_fallback(f.source_deaths.where("year < 2000").select("year", "source_indicator").distinct(), f.source_deaths.where("source_indicator = 'S1'").select("year", "source_indicator").distinct(), f.priority), "SELECT DISTINCT year, CASE WHEN year < 2000 THEN 'S2' ELSE 'S1' END AS source_indicator FROM source_deaths")


def _ranges(f: Facts) -> DataFrame:
    return f.spark.createDataFrame([("S1", 1990, 1997), ("S2", 1998, 2010)], "source_indicator string, first int, last int")


add("M4_year_ranges", lambda f: merge.by_year_range(f.source_pop, _ranges(f)).groupBy("year", "source_indicator").agg(F.sum("pop").alias("pop")), "SELECT year, source_indicator, sum(pop) AS pop FROM source_pop WHERE (source_indicator = 'S1' AND year <= 1997) OR (source_indicator = 'S2' AND year >= 1998) GROUP BY ALL")
add(
    "M5_provenance",
    lambda f: merge.with_sources(merge.by_priority(f.source_deaths, f.priority, DK, "deaths"), merge.by_priority(f.source_pop, f.priority, PK, "pop"), PK).groupBy("death_source", "population_source").agg(F.sum("deaths").alias("deaths"), F.sum("pop").alias("pop")),
    f"d AS (SELECT * FROM source_deaths JOIN priority USING (source_indicator) QUALIFY {_BEST.format(k='year, area, sex, cause, band_idx')}), p AS (SELECT * FROM source_pop JOIN priority USING (source_indicator) QUALIFY {_BEST.format(k='year, area, sex, band_idx')}) --- SELECT d.source_indicator AS death_source, p.source_indicator AS population_source, sum(deaths) AS deaths, sum(pop) AS pop FROM d JOIN p USING (year, area, sex, band_idx) GROUP BY ALL",
)
add("M6_seam_crossing", lambda f: merge.seams_crossed(f.full.where("sex = 'HM' AND (cause <> 'LARGE' OR year > 1998)"), f.seams, ["area", "cause"]), "SELECT area, cause, seam, effect FROM (SELECT area, cause, min(year) a, max(year) b FROM fullf WHERE sex = 'HM' AND (cause <> 'LARGE' OR year > 1998) GROUP BY ALL) JOIN seams ON a < seam AND b >= seam")
add("M7_seam_note", lambda f: merge.seam_note(f.full.where("sex = 'HM' AND (cause <> 'LARGE' OR year > 1998)"), f.seams, ["area", "cause"]), "SELECT area, cause, string_agg((seam - 1) || '/' || seam || ' (' || effect || ')', '; ' ORDER BY seam) AS note FROM (SELECT area, cause, min(year) a, max(year) b FROM fullf WHERE sex = 'HM' AND (cause <> 'LARGE' OR year > 1998) GROUP BY ALL) JOIN seams ON a < seam AND b >= seam GROUP BY ALL")



def _metric_series(f: Facts) -> DataFrame:
    """The same years as counts and as rates."""
    own = f.full.where("sex = 'HM'").select("area", "cause", "year").distinct()
    return own.withColumn("metric", F.explode(F.array(F.lit("deaths"), F.lit("crude"), F.lit("dsr"))))


add(
    "M7_seam_note_metrics",
    lambda f: merge.seam_note(_metric_series(f), f.seams, ["area", "cause", "metric"], "metric"),
    "SELECT area, cause, metric, string_agg((seam - 1) || '/' || seam || ' (' || effect || ')', '; ' ORDER BY seam) AS note FROM (SELECT area, cause, min(year) a, max(year) b FROM fullf WHERE sex = 'HM' GROUP BY ALL) JOIN seams ON a < seam AND b >= seam, (VALUES ('crude'), ('dsr')) AS v(metric) GROUP BY ALL",
)
add("M8_year_sets", lambda f: merge.year_sets(f.pop.where("year > 1995"), f.deaths.where("year < 2001")), "SELECT year, bool_or(p) AS has_pop, bool_or(NOT p) AS has_deaths, bool_or(p) AND bool_or(NOT p) AS usable FROM (SELECT year, true AS p FROM pop WHERE year > 1995 UNION SELECT year, false FROM deaths WHERE year < 2001) GROUP BY year")


def _year_grid(f: Facts) -> DataFrame:
    return f.births.select("area", F.explode(F.sequence(F.lit(1994), F.lit(2002))).alias("year")).distinct()


add("M9_gap_note", lambda f: merge.gaps(_year_grid(f), f.births, ["area"]), "SELECT area, string_agg(CAST(year AS VARCHAR), ', ' ORDER BY year) AS missing_years, count(*) AS n_missing FROM (SELECT DISTINCT area FROM births), (SELECT CAST(unnest(range(1994, 2003)) AS INTEGER) AS year) WHERE (area, year) NOT IN (SELECT area, year FROM births) GROUP BY ALL")
add("M10_detail_check", lambda f: merge.detail_check(f.deaths, f.infant.where("area = 'NATION_1'"), "LARGE", "H"), "SELECT DISTINCT year, year IN (SELECT year FROM infant WHERE area = 'NATION_1' AND cause = 'LARGE' AND sex = 'H') AS held FROM deaths")

# ---- geography

add("G1_region_rollup", lambda f: geo.rolled_up(f.deaths, geo.members(f.lookup).where("vintage = 'A'"), ["year", "sex", "cause"], "deaths"), "SELECT region, year, sex, cause, sum(deaths) AS deaths FROM deaths JOIN members ON area = municipality AND vintage = 'A' GROUP BY ALL")
_CHOSEN = "ch AS (SELECT DISTINCT nuts2 AS area FROM lookup WHERE vintage = 'A' UNION SELECT n_name FROM nation WHERE n_nationkey < 3)"
add(
    "G1_chosen_areas",
    lambda f: geo.rolled_up(f.deaths, geo.members(f.lookup).where("vintage = 'A'"), ["year", "sex", "cause"], "deaths", chosen=f.lookup.where("vintage = 'A'").select(F.col("nuts2").alias("area")).unionByName(f.table("nation").where("n_nationkey < 3").select(F.col("n_name").alias("area")))),
    _CHOSEN + ", rs AS (SELECT ch.area AS region, coalesce(municipality, ch.area) AS area FROM ch LEFT JOIN (SELECT * FROM members WHERE vintage = 'A') ON region = ch.area) --- SELECT region, year, sex, cause, sum(deaths) AS deaths FROM deaths JOIN rs USING (area) GROUP BY ALL",
)
add("G2_members", lambda f: geo.members(f.lookup), "SELECT * FROM members")


def _selections(f: Facts) -> DataFrame:
    n = f.table("nation")
    return n.where("n_nationkey % 2 = 0").select(F.lit("even").alias("label"), F.col("n_name").alias("area")).unionByName(n.where("n_nationkey < 5").select(F.lit("low").alias("label"), F.col("n_name").alias("area")))


_SEL = "sel AS (SELECT 'even' AS label, n_name AS area FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'low', n_name FROM nation WHERE n_nationkey < 5) --- "
add("G3_combined", lambda f: geo.combined(f.deaths, _selections(f), ["year", "sex", "cause"], "deaths"), _SEL + "SELECT label, year, sex, cause, sum(deaths) AS deaths FROM deaths JOIN sel USING (area) GROUP BY ALL")
add("G4_vintages", lambda f: geo.rolled_up_by_vintage(f.pop, geo.members(f.lookup), ["year", "sex"], "pop"), "SELECT vintage, region, year, sex, sum(pop) AS pop FROM pop JOIN members ON area = municipality GROUP BY ALL")
add("G5_coverage", lambda f: geo.coverage(geo.members(f.lookup), f.infant.where("year = 1996").select("area")), "have AS (SELECT DISTINCT area FROM infant WHERE year = 1996) --- SELECT vintage, region, count(*) AS expected, count(area) AS found, coalesce(string_agg(municipality, ', ' ORDER BY municipality) FILTER (area IS NULL), '') AS missing, count(*) = count(area) AS complete FROM members LEFT JOIN have ON area = municipality GROUP BY ALL")


def _overlapping(f: Facts) -> DataFrame:
    r = f.table("region").select(F.lit("regions").alias("label"), F.col("r_name").alias("area"))
    mix = f.lookup.where("vintage = 'A'").select(F.lit("mixed").alias("label"), F.explode(F.array("nuts1", "nuts2", "municipality")).alias("area"))
    return r.unionByName(mix).unionByName(f.table("region").select(F.lit("mixed").alias("label"), F.lit("NATION").alias("area"))).distinct()


add(
    "G6_overlap",
    lambda f: geo.overlaps(_overlapping(f), geo.members(f.lookup).where("vintage = 'A'"), "NATION"),
    """sel AS (SELECT 'regions' AS label, r_name AS area FROM region UNION SELECT 'mixed', unnest([nuts1, nuts2, municipality]) FROM lookup WHERE vintage = 'A' UNION SELECT 'mixed', 'NATION'),
    ex AS (SELECT label, area, coalesce(municipality, area) AS m FROM sel LEFT JOIN (SELECT * FROM members WHERE vintage = 'A') ON region = area),
    sets AS (SELECT label, area, list(m) AS s FROM ex GROUP BY ALL) ---
    SELECT a.label, a.area AS outer, b.area AS inner, 'absorbed' AS kind FROM sets a JOIN sets b ON a.label = b.label AND a.area <> b.area AND len(list_intersect(b.s, a.s)) = len(b.s)
    UNION ALL SELECT a.label, a.area, b.area, 'national' FROM sel a JOIN sel b ON a.label = b.label AND a.area = 'NATION' AND b.area <> 'NATION'""".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'),
)
add("G7_unknown_region", lambda f: geo.unknown_regions(geo.members(f.lookup).select(F.col("region").alias("area")).distinct(), geo.members(f.lookup), "B"), "SELECT DISTINCT region AS area FROM members WHERE vintage = 'A' AND region NOT IN (SELECT region FROM members WHERE vintage = 'B')")
add("G8_reconcile", lambda f: geo.reconciled(geo.members(f.lookup).where("vintage = 'A'").select(F.col("region").alias("area")), geo.members(f.lookup).where("vintage = 'B'").select(F.col("region").alias("area"))), "SELECT DISTINCT region AS area, CASE WHEN region IN (SELECT region FROM members WHERE vintage = 'B') THEN 'kept' ELSE 'dropped' END AS status FROM members WHERE vintage = 'A'")
add(
    "G9_vocabulary",
    lambda f: geo.vocabulary(f.lookup, "NATION"),
    "SELECT DISTINCT vintage, 'NATION' AS area, 0 AS kind, '' AS key FROM lookup UNION ALL SELECT vintage, area, min(level), min(municipality_code) FROM (SELECT vintage, nuts1 AS area, 1 AS level, municipality_code FROM lookup UNION ALL SELECT vintage, nuts2, 2, municipality_code FROM lookup) GROUP BY ALL UNION ALL SELECT vintage, municipality, 3, municipality FROM lookup",
)
add("G10_definition_break", lambda f: geo.definition_breaks(f.infant.where("cause = 'LARGE' AND sex = 'H'"), f.table("nation").select(F.col("n_name").alias("area"), (F.col("n_nationkey") % 4 + 1996).cast("int").alias("break_year"))), "SELECT area, break_year FROM (SELECT area, min(year) a, max(year) b FROM infant WHERE cause = 'LARGE' AND sex = 'H' GROUP BY ALL) JOIN (SELECT n_name AS area, CAST(n_nationkey % 4 + 1996 AS INTEGER) AS break_year FROM nation) USING (area) WHERE a < break_year AND b >= break_year")


def _code_regions(f: Facts) -> DataFrame:
    r = f.table("region").select(F.lit("one").alias("level"), F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("label"))
    return r.unionByName(f.table("region").select(F.lit("one").alias("level"), F.concat(F.col("r_regionkey").cast("string"), F.lit("1")).alias("code"), F.concat(F.col("r_name"), F.lit(" tens")).alias("label")))


add("G11_lookup_build", lambda f: geo.parents(f.lookup.where("vintage = 'A'").select(F.col("municipality_code").alias("code"), F.col("municipality").alias("label")), _code_regions(f)), "SELECT municipality_code AS code, municipality AS label, 'one' AS level, CASE WHEN municipality_code[2] = '1' THEN r_name || ' tens' ELSE r_name END AS region FROM lookup JOIN region ON municipality_code[1] = CAST(r_regionkey AS VARCHAR) WHERE vintage = 'A'")


def _named(f: Facts) -> tuple[DataFrame, DataFrame]:
    n = f.table("nation")
    rows = n.select(F.when(F.col("n_nationkey") % 3 == 0, "?").otherwise(F.col("n_nationkey").cast("string")).alias("code"), F.when(F.col("n_nationkey") % 6 == 0, F.lit("NATION_0")).otherwise(F.col("n_name")).alias("label"))
    return rows, n.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))


add("G12_canonical", lambda f: geo.canonical(*_named(f)), "SELECT CASE WHEN n_nationkey % 3 = 0 THEN '?' ELSE CAST(n_nationkey AS VARCHAR) END AS code, CASE WHEN n_nationkey % 6 = 0 THEN 'NATION_0' ELSE n_name END AS label, CASE WHEN n_nationkey % 6 = 0 THEN 'NATION_0' ELSE n_name END AS canonical FROM nation")
add("G13_ambiguous", lambda f: geo.ambiguous_labels(f.lookup.select(F.col("municipality_code").alias("code"), F.col("nuts2").alias("label"))), "SELECT nuts2 AS label, count(DISTINCT municipality_code) AS n_codes, string_agg(DISTINCT municipality_code, ', ' ORDER BY municipality_code) AS codes FROM lookup GROUP BY ALL HAVING count(DISTINCT municipality_code) > 1")


def _repairs(f: Facts) -> DataFrame:
    return f.table("nation").where("n_nationkey IN (3, 4, 5)").select(F.col("n_name").alias("stored_label"), F.when(F.col("n_nationkey") == 5, F.col("n_name")).otherwise(F.concat(F.col("n_name"), F.lit(" town"))).alias("label"), F.lit(1996).alias("year_min"), F.lit(1998).alias("year_max"))


add(
    "G14_repair",
    lambda f: geo.repaired(f.births, _repairs(f), f.births.where("area IN ('NATION_3', 'NATION_4')").withColumn("area", F.concat(F.col("area"), F.lit(" town")))),
    "SELECT year, area, births FROM births WHERE NOT (area IN ('NATION_3', 'NATION_4') AND year BETWEEN 1996 AND 1998) UNION ALL SELECT year, area || ' town', births FROM births WHERE area IN ('NATION_3', 'NATION_4') AND year BETWEEN 1996 AND 1998",
)
add("G15_crosswalk", lambda f: geo.crosswalk(f.lookup, "A", "B"), "SELECT a.nuts2 AS old_region, b.nuts2 AS new_region, count(*) AS n FROM lookup a JOIN lookup b USING (municipality) WHERE a.vintage = 'A' AND b.vintage = 'B' AND a.nuts2 <> b.nuts2 GROUP BY ALL")
add(
    "G16_closure",
    lambda f: geo.closure(geo.rolled_up(f.pop, f.lookup.where("vintage = 'A'").select("municipality", F.col("nuts2").alias("region")), ["year", "sex"], "pop"), f.pop.groupBy("year", "sex").agg(F.sum("pop").alias("pop")), ["year", "sex"], "pop"),
    "parts AS (SELECT nuts2, year, sex, sum(pop) AS pop FROM pop JOIN lookup ON area = municipality AND vintage = 'A' GROUP BY ALL), p AS (SELECT year, sex, sum(pop) AS parts FROM parts GROUP BY ALL), w AS (SELECT year, sex, sum(pop) AS whole FROM pop GROUP BY ALL) --- SELECT year, sex, parts, whole, parts - whole AS difference FROM p JOIN w USING (year, sex)",
)

# ---- quality

add(
    "Q1_inventory",
    lambda f: quality.inventory(f.source_deaths, "deaths", f.priority.where("source_indicator = 'S2'")).select("dataset", "priority", "source_indicator", "year", "cause", "n_rows", F.size("areas").alias("n_areas"), F.array_join("sexes", ",").alias("sexes"), F.size("bands").alias("n_bands")),
    "SELECT 'deaths' AS dataset, coalesce(max(priority) FILTER (source_indicator = 'S2'), 0) AS priority, source_indicator, year, cause, count(*) AS n_rows, count(DISTINCT area) AS n_areas, string_agg(DISTINCT sex, ',' ORDER BY sex) AS sexes, count(DISTINCT band_idx) AS n_bands FROM source_deaths LEFT JOIN priority USING (source_indicator) GROUP BY source_indicator, year, cause",
)


def _status(f: Facts) -> DataFrame:
    grid = f.infant.select("cause").distinct().withColumn("year", F.explode(F.sequence(F.lit(1994), F.lit(2002))))
    return quality.availability(grid, f.infant.where("sex = 'H'").withColumn("source_indicator", F.lit("S1")), ["year", "cause"], f.table("nation").where("n_nationkey < 10").select(F.col("n_name").alias("area")))


_STATUS = """need AS (SELECT n_name AS area FROM nation WHERE n_nationkey < 10),
 grid AS (SELECT DISTINCT cause, CAST(y AS INTEGER) AS year FROM infant, unnest(range(1994, 2003)) AS u(y)),
 st AS (SELECT g.year, g.cause, count(DISTINCT i.area) AS covered, count(i.area) AS n_rows, coalesce(max(CASE WHEN i.area IS NOT NULL THEN 'S1' END), 'N/D') AS sources,
   coalesce(string_agg(n.area, ', ' ORDER BY n.area) FILTER (i.area IS NULL), '') AS missing FROM grid g CROSS JOIN need n LEFT JOIN (SELECT * FROM infant WHERE sex = 'H') i ON i.year = g.year AND i.cause = g.cause AND i.area = n.area GROUP BY ALL),
 status AS (SELECT year, cause, CASE WHEN covered = 0 THEN 'unavailable' WHEN missing <> '' THEN 'partial' ELSE 'available' END AS status, covered, missing, sources, n_rows FROM st) --- """
add("Q2_availability", _status, _STATUS + "SELECT * FROM status")
add("Q3_missing_combinations", lambda f: quality.missing_combinations(_year_grid(f).join(f.groups.select("cause")), f.infant, ["year", "area", "cause"]).groupBy("cause", "year").agg(F.count(F.lit(1)).alias("n")), "SELECT cause, year, count(*) AS n FROM (SELECT DISTINCT area FROM births), (SELECT CAST(unnest(range(1994, 2003)) AS INTEGER) AS year), (SELECT cause FROM groups) WHERE (area, year, cause) NOT IN (SELECT area, year, cause FROM infant) GROUP BY ALL")
add("Q4_issue_summary", lambda f: quality.issue_summary(_status(f), 3, ["cause", "year"]), _STATUS + "SELECT status, count(*) AS n, array_to_string(list_sort(list(cause || ' ' || year))[1:3], '; ') AS examples FROM status GROUP BY ALL")
add("Q5_inventory_summary", lambda f: quality.inventory_summary(quality.inventory(f.source_deaths, "deaths")), "SELECT 'deaths' AS dataset, count(*) AS n_slices, min(year) AS first_year, max(year) AS last_year, count(DISTINCT cause) AS n_causes, max(n) AS most_areas FROM (SELECT source_indicator, year, cause, count(DISTINCT area) AS n FROM source_deaths GROUP BY ALL)")
add("Q6_to_ingest", lambda f: quality.to_ingest(f.deaths.select("year", "cause", "area").distinct(), f.infant), "SELECT year, cause, count(*) AS n_areas FROM (SELECT DISTINCT year, cause, area FROM deaths) WHERE (year, cause, area) NOT IN (SELECT year, cause, area FROM infant) GROUP BY ALL")
add("Q7_sexes_add_up", lambda f: quality.sexes_add_up(f.pop.where("sex <> 'M' OR area <> 'NATION_7'"), ["year", "area"], "pop"), "SELECT year, area, sum(pop) FILTER (sex = 'HM') AS both, sum(pop) FILTER (sex <> 'HM') AS parts, abs(sum(pop) FILTER (sex = 'HM') - sum(pop) FILTER (sex <> 'HM')) <= 1 AS agrees FROM pop WHERE sex <> 'M' OR area <> 'NATION_7' GROUP BY ALL")
add("Q8_plausible", lambda f: quality.plausible_totals(f.births, "births", 100.0, 7000.0), "SELECT year, sum(births) AS total, sum(births) BETWEEN 100 AND 7000 AS plausible FROM births GROUP BY ALL")
add("Q9_schema_check", lambda f: quality.require_columns(f.deaths, ["year", "area", "cause", "deaths"]).groupBy("year").agg(F.sum("deaths").alias("deaths")), "SELECT year, sum(deaths) AS deaths FROM deaths GROUP BY ALL")
add(
    "Q10_seam_scan",
    lambda f: r6(quality.seam_scan(f.pop.where("sex = 'HM'").groupBy("area", "year").agg(F.sum("pop").alias("value")), 0.1), "median", "iqr"),
    "s AS (SELECT area, year, sum(pop) AS value FROM pop WHERE sex = 'HM' GROUP BY ALL) --- SELECT b.year, count(*) AS n, round(quantile_cont(b.value / a.value - 1, 0.5), 6) AS median, round(quantile_cont(b.value / a.value - 1, 0.75) - quantile_cont(b.value / a.value - 1, 0.25), 6) AS iqr, count(*) FILTER (abs(b.value / a.value - 1) > 0.1) AS n_over FROM s a JOIN s b ON a.area = b.area AND b.year = a.year + 1 GROUP BY ALL",
)
add("Q11_disjoint_groups", lambda f: quality.causes_in_two_groups(f.source_deaths.select("cause", F.when(F.col("cause") == "LARGE", F.col("source_indicator")).otherwise("S").alias("group"))), "SELECT cause, count(DISTINCT CASE cause WHEN 'LARGE' THEN source_indicator ELSE 'S' END) AS n_groups FROM source_deaths GROUP BY cause HAVING n_groups > 1")
