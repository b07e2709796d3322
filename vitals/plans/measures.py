"""Queries of joins, rates, pooling, indirect standardisation, avoidable mortality, comparisons, forecasts and breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.demo import CUTOFF, THIN_BIRTHS, Facts
from vitals.functions.intervals import Z95
from vitals.operators import annual, avoidable, breaks, geo, pooling, quality, rates
from vitals.operators import forecast as fc
from vitals.plans.registry import add, limits_sql, r3, r6

KEYS = ["year", "area", "sex", "cause"]
_K = "year, area, sex, cause"

# ---- joins

add("J1_population_join", lambda f: rates.joined(f.deaths, f.pop).groupBy(*KEYS).agg(F.sum("deaths").alias("deaths"), F.sum("pop").alias("pop"), F.count(F.lit(1)).alias("n")), f"SELECT {_K}, sum(deaths) AS deaths, sum(pop) AS pop, count(*) AS n FROM fullf GROUP BY ALL")
add("J1_zero_bands", lambda f: rates.joined(f.deaths, f.pop, keep_zero_bands=True, causes=f.deaths.select("cause")).groupBy("year", "sex", "cause").agg(F.sum("deaths").alias("deaths"), F.sum("pop").alias("pop"), F.count(F.lit(1)).alias("n")), "SELECT year, sex, cause, sum(coalesce(deaths, 0)) AS deaths, sum(pop) AS pop, count(*) AS n FROM pop CROSS JOIN (SELECT DISTINCT cause FROM deaths) LEFT JOIN (SELECT year, area, sex, band_idx, cause, deaths FROM deaths) USING (year, area, sex, band_idx, cause) GROUP BY ALL")
add("J2_weights", lambda f: rates.with_weights(f.full, f.bands).groupBy(*KEYS).agg(F.sum("weight").alias("weight")), f"SELECT {_K}, sum(weight) AS weight FROM fullf JOIN bands USING (age_band) GROUP BY ALL")
_EXPECTED = """ref AS (SELECT year, sex, cause, band_idx, sum(deaths) AS rd, sum(pop) AS rp FROM fullf WHERE area = 'NATION_1' GROUP BY ALL HAVING sum(pop) > 0),
 ex AS (SELECT year, area, sex, cause, coalesce(sum(deaths) FILTER (rp IS NOT NULL), 0) AS observed, coalesce(sum(pop * rd / rp), 0) AS expected, sum(rd) / sum(rp) AS ref_rate, count(rp) AS bands_used,
   coalesce(string_agg(age_band, ', ' ORDER BY age_band) FILTER (rp IS NULL), '') AS missing_bands FROM fullf f LEFT JOIN ref USING (year, sex, cause, band_idx) GROUP BY ALL) --- """


def _expected(f: Facts) -> DataFrame:
    return pooling.expected(f.full, f.full.where("area = 'NATION_1'"), KEYS, ["year", "sex", "cause"])


add("J3_reference_bands", lambda f: _expected(f).select(*KEYS, "bands_used", "missing_bands"), _EXPECTED + f"SELECT {_K}, bands_used, missing_bands FROM ex")
add("J4_window_join", lambda f: pooling.windows(f.pop, 3), "SELECT a.year, b.year AS source_year FROM (SELECT DISTINCT year FROM pop) a JOIN (SELECT DISTINCT year FROM pop) b ON b.year BETWEEN a.year - 1 AND a.year + 1")
add("J5_semi_join", lambda f: f.deaths.join(f.infant.select("year", "area", "cause", "sex").distinct(), KEYS, "left_semi").groupBy("year", "cause").agg(F.sum("deaths").alias("deaths")), "SELECT year, cause, sum(deaths) AS deaths FROM deaths d WHERE (year, area, cause, sex) IN (SELECT year, area, cause, sex FROM infant) GROUP BY ALL")
add("J6_anti_join", lambda f: quality.missing_combinations(f.deaths.select("year", "area", "cause").distinct(), f.infant, ["year", "area", "cause"]), "SELECT DISTINCT year, area, cause FROM deaths WHERE (year, area, cause) NOT IN (SELECT year, area, cause FROM infant)")

# ---- rates

add("R1_band_collapse", lambda f: rates.collapsed(f.full, ["year", "sex", "cause", "age_band"]), "SELECT year, sex, cause, age_band, sum(deaths) AS deaths, sum(pop) AS pop FROM fullf GROUP BY ALL")


def _regions(f: Facts) -> DataFrame:
    """Deaths and population of regions, joined after the roll-up."""
    m = geo.members(f.lookup).where("vintage = 'A'")
    cell = ["year", "sex", "band_idx", "age_band"]
    d, p = geo.rolled_up(f.deaths, m, [*cell, "cause"], "deaths"), geo.rolled_up(f.pop, m, cell, "pop")
    return rates.joined(d.withColumnRenamed("region", "area"), p.withColumnRenamed("region", "area"))


add(
    "R2_crude_rate",
    lambda f: r6(rates.crude_rate(_regions(f)), "rate"),
    "rd AS (SELECT region AS area, year, sex, cause, band_idx, sum(deaths) AS deaths FROM deaths JOIN members ON area = municipality AND vintage = 'A' GROUP BY ALL), rp AS (SELECT region AS area, year, sex, band_idx, sum(pop) AS pop FROM pop JOIN members ON area = municipality AND vintage = 'A' GROUP BY ALL) --- SELECT year, area, sex, cause, sum(deaths) AS deaths, sum(pop) AS pop, round(sum(deaths) / sum(pop) * 1e5, 6) AS rate FROM rd JOIN rp USING (area, year, sex, band_idx) GROUP BY ALL",
)
_CR = f"cr AS (SELECT {_K}, sum(deaths) AS deaths, sum(pop) AS pop FROM fullf GROUP BY ALL), " + limits_sql("SELECT deaths AS k FROM cr")
add("R3_poisson_limits", lambda f: r3(r6(rates.crude_rate_limits(f.full), "rate"), "lower", "upper"), _CR + f" --- SELECT {_K}, deaths, pop, round(deaths / pop * 1e5, 6) AS rate, round(lo * 1e5 / pop, 3) AS lower, round(hi * 1e5 / pop, 3) AS upper FROM cr JOIN poisson ON k = deaths")
_BIN = f"""cc AS (SELECT {_K}, sum(deaths) AS deaths FROM deaths GROUP BY ALL),
 pr AS (SELECT a.year, a.area, a.sex, a.cause, a.deaths, b.deaths AS all_deaths FROM cc a JOIN cc b ON a.year = b.year AND a.area = b.area AND a.sex = b.sex AND b.cause = 'ALL' WHERE a.cause <> 'ALL'),
 bk AS (SELECT DISTINCT deaths AS k, all_deaths AS n FROM pr),
 bh AS (SELECT k, n, CAST(side AS INTEGER) AS side, CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b, 0 AS step FROM bk, (VALUES (0), (1)) AS v(side)
  UNION ALL SELECT k, n, side, CASE WHEN p > CASE side WHEN 1 THEN 0.025 ELSE 0.975 END THEN m ELSE a END, CASE WHEN p > CASE side WHEN 1 THEN 0.025 ELSE 0.975 END THEN b ELSE m END, step + 1
  FROM (SELECT *, coalesce(list_sum(list_transform(range(0, CAST(k + side AS BIGINT)), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(m) + (n - i) * ln(1 - m)))), 0) AS p FROM (SELECT *, (a + b) / 2 AS m FROM bh WHERE step < 50))),
 binomial AS (SELECT k, n, max(CASE WHEN side = 0 THEN CASE WHEN k = 0 THEN 0 ELSE (a + b) / 2 END END) AS lo, max(CASE WHEN side = 1 THEN CASE WHEN k = n THEN 1 ELSE (a + b) / 2 END END) AS hi FROM bh WHERE step = 50 GROUP BY k, n) --- """
add("R4_binomial_limits", lambda f: r3(r6(rates.proportional_limits(f.deaths, "ALL"), "share"), "lower", "upper"), _BIN + f"SELECT {_K}, deaths, all_deaths, round(deaths / all_deaths * 100, 6) AS share, round(lo * 100, 3) AS lower, round(hi * 100, 3) AS upper FROM pr JOIN binomial ON k = deaths AND n = all_deaths")
_DSR = "SELECT {k}, d AS deaths, CASE WHEN d >= 10 THEN round(wr / w * 1e5, 6) END AS rate, CASE WHEN d >= 10 THEN round(v / w ^ 2 * 1e10, 6) END AS variance FROM (SELECT {k}, sum(deaths) AS d, sum(weight) AS w, sum(weight * deaths / pop) AS wr, sum(weight ^ 2 * deaths / pop ^ 2) AS v FROM {t} JOIN bands USING (age_band) WHERE pop > 0 GROUP BY ALL)"
add("R5_standardised_rate", lambda f: r6(rates.standardised_rate(f.full, f.bands), "rate", "variance"), _DSR.format(k=_K, t="fullf"))
_DW = "dw AS (SELECT {k}, sum(deaths) AS d, sum(weight) AS w, sum(weight * deaths / pop) AS wr, sum(weight ^ 2 * deaths / pop ^ 2) AS v FROM {t} JOIN bands USING (age_band) WHERE pop > 0 GROUP BY ALL), "
_DL = "CASE WHEN d >= 10 THEN round(wr / w * 1e5, 6) END AS rate, CASE WHEN d >= 10 THEN round(wr / w * 1e5 + sqrt(v / w ^ 2 * 1e10 / d) * (lo - d), 3) END AS lower, CASE WHEN d >= 10 THEN round(wr / w * 1e5 + sqrt(v / w ^ 2 * 1e10 / d) * (hi - d), 3) END AS upper"
add("R5_standardised_limits", lambda f: r3(r6(rates.standardised_rate_limits(f.full, f.bands), "rate"), "lower", "upper"), _DW.format(k=_K, t="fullf") + limits_sql("SELECT d AS k FROM dw") + f" --- SELECT {_K}, d AS deaths, {_DL} FROM dw JOIN poisson ON k = d")
_SCOPED = "sc AS (SELECT f.*, scope FROM fullf f JOIN bands b USING (age_band), unnest(CASE WHEN b.under THEN ['total', 'under75'] ELSE ['total'] END) AS u(scope)) --- "
add("R6_under75_rate", lambda f: r6(rates.standardised_rate(rates.scoped(f.full, f.bands), f.bands, [*KEYS, "scope"]), "rate", "variance"), _SCOPED + _DSR.format(k=_K + ", scope", t="sc"))
_BUNDLE = _SCOPED.replace(" --- ", ", ") + _DW.format(k=_K + ", scope", t="sc") + f"cs AS (SELECT {_K}, scope, sum(deaths) AS d, sum(pop) AS p FROM sc GROUP BY ALL), " + limits_sql("SELECT d AS k FROM dw UNION SELECT d FROM cs") + f", bundle AS (SELECT {_K}, scope, 'crude' AS rate_type, d AS deaths, round(d / p * 1e5, 6) AS rate, round(lo * 1e5 / p, 3) AS lower, round(hi * 1e5 / p, 3) AS upper FROM cs JOIN poisson ON k = d UNION ALL SELECT {_K}, scope, 'dsr', d, {_DL} FROM dw JOIN poisson ON k = d) --- "
add("R7_observed_bundle", lambda f: r3(r6(rates.observed_bundle(f.full, f.bands), "rate"), "lower", "upper"), _BUNDLE + "SELECT * FROM bundle")
add("R8_series_selection", lambda f: r3(r6(rates.selected_series(rates.observed_bundle(f.full, f.bands), "under75", "dsr", 1900, 1996), "rate"), "lower", "upper"), _BUNDLE + f"SELECT {_K}, deaths, rate, lower, upper FROM bundle WHERE scope = 'under75' AND rate_type = 'dsr' AND year BETWEEN 1900 AND 1996")
_LOST = f"SELECT {_K}, coalesce(sum(deaths * greatest({CUTOFF} - mid, 0)), 0) AS ypll, coalesce(sum(deaths) FILTER (mid < {CUTOFF}), 0) AS premature, coalesce(sum(deaths * greatest({CUTOFF} - mid, 0) ^ 2), 0) AS variance FROM deaths JOIN bands USING (age_band) GROUP BY ALL"
add("R9_years_lost", lambda f: rates.years_lost(f.deaths, f.bands, CUTOFF), _LOST)
add(
    "R10_infant_split",
    lambda f: rates.split_youngest(f.full.select(*KEYS, "age_band", "deaths", "pop"), f.infant, KEYS, "0 - 4"),
    f"i AS (SELECT {_K}, deaths AS u FROM infant), j AS (SELECT f.*, i.u FROM fullf f LEFT JOIN i USING ({_K})) --- SELECT {_K}, age_band, deaths, pop FROM j WHERE age_band <> '0 - 4' OR u IS NULL UNION ALL SELECT {_K}, '< 1 ano', greatest(least(u, deaths), 0), NULL FROM j WHERE age_band = '0 - 4' AND u IS NOT NULL UNION ALL SELECT {_K}, '1 - 4 anos', deaths - greatest(least(u, deaths), 0), NULL FROM j WHERE age_band = '0 - 4' AND u IS NOT NULL",
)
add(
    "R11_years_lost_limits",
    lambda f: r3(rates.years_lost_limits(f.deaths, f.bands, CUTOFF), "lower", "upper"),
    f"yl AS ({_LOST}), " + limits_sql("SELECT premature AS k FROM yl") + f" --- SELECT {_K}, ypll, CASE WHEN k > 0 AND variance > 0 THEN round(greatest(ypll + sqrt(variance / k) * (lo - k), 0), 3) ELSE 0 END AS lower, round(CASE WHEN k > 0 AND variance > 0 THEN ypll + sqrt(variance / k) * (hi - k) ELSE ypll END, 3) AS upper FROM yl JOIN poisson ON k = premature",
)
_DC = f"dc AS (SELECT {_K}, sum(deaths) AS deaths FROM deaths GROUP BY ALL), " + limits_sql("SELECT deaths AS k FROM dc")
add("R12_death_counts", lambda f: r3(rates.death_counts(f.deaths), "lower", "upper"), _DC + f" --- SELECT {_K}, deaths, round(lo, 3) AS lower, round(hi, 3) AS upper FROM dc JOIN poisson ON k = deaths")
add("R13_proportional", lambda f: r6(rates.proportional(f.deaths, "ALL"), "share"), f"c AS (SELECT {_K}, sum(deaths) AS deaths FROM deaths GROUP BY ALL) --- SELECT a.year, a.area, a.sex, a.cause, a.deaths, b.deaths AS all_deaths, round(a.deaths / b.deaths * 100, 6) AS share FROM c a JOIN c b ON a.year = b.year AND a.area = b.area AND a.sex = b.sex AND b.cause = 'ALL' WHERE a.cause <> 'ALL'")


def _infant_all(f: Facts) -> DataFrame:
    return f.infant.where("sex = 'HM' AND cause = 'ALL'")


add("R14_infant_rate", lambda f: r6(rates.infant_rate(_infant_all(f), f.births, ["year", "area"], THIN_BIRTHS), "rate"), f"SELECT year, area, i.deaths, b.births, round(i.deaths / b.births * 1000, 6) AS rate, CASE WHEN b.births < {THIN_BIRTHS} THEN '*' ELSE '' END AS flag, CAST(NULL AS VARCHAR) AS note FROM infant i LEFT JOIN births b USING (year, area) WHERE sex = 'HM' AND cause = 'ALL'")
_IR = "ir AS (SELECT year, area, i.deaths, b.births FROM infant i LEFT JOIN births b USING (year, area) WHERE sex = 'HM' AND cause = 'ALL'), " + limits_sql("SELECT deaths AS k FROM ir")
add("R14_infant_limits", lambda f: r3(r6(rates.infant_rate_limits(_infant_all(f), f.births, ["year", "area"], THIN_BIRTHS), "rate"), "lower", "upper"), _IR + f" --- SELECT year, area, deaths, births, round(deaths / births * 1000, 6) AS rate, CASE WHEN births < {THIN_BIRTHS} THEN '*' ELSE '' END AS flag, CAST(NULL AS VARCHAR) AS note, round(lo * 1000 / births, 3) AS lower, round(hi * 1000 / births, 3) AS upper FROM ir JOIN poisson ON k = deaths")
_WIN = "yrs AS (SELECT DISTINCT year FROM pop), win AS (SELECT a.year, b.year AS sy FROM yrs a JOIN yrs b ON b.year BETWEEN a.year - 1 AND a.year + 1), "
add(
    "R15_infant_count",
    lambda f: rates.infant_count(_infant_all(f), pooling.windows(f.pop, 3), ["area"]),
    _WIN + "n AS (SELECT year, count(*) AS n FROM win GROUP BY ALL) --- SELECT w.year, i.area, any_value(n.n) AS n_years, count(DISTINCT i.year) AS covered, CASE WHEN count(DISTINCT i.year) = any_value(n.n) THEN sum(i.deaths) END AS deaths FROM win w JOIN infant i ON i.year = w.sy AND i.sex = 'HM' AND i.cause = 'ALL' JOIN n ON n.year = w.year GROUP BY w.year, i.area",
)
add("R16_births_total", lambda f: rates.births_total(f.births, pooling.windows(f.pop, 3), ["area"]), _WIN.rstrip(", ") + " --- SELECT w.year, area, sum(births) AS births FROM births b JOIN win w ON b.year = w.sy GROUP BY ALL")
add("R17_thin_flag", lambda f: f.births.select("year", "area", rates.thin(F.col("births"), THIN_BIRTHS).alias("flag")), f"SELECT year, area, CASE WHEN births < {THIN_BIRTHS} THEN '*' ELSE '' END AS flag FROM births")

# ---- pooling and indirect standardisation

PK = ["area", "sex", "cause", "band_idx", "age_band"]
add(
    "P1_pooled",
    lambda f: pooling.pooled(f.full, 3, PK),
    _WIN.rstrip(", ") + " --- SELECT w.year, area, sex, cause, band_idx, age_band, sum(deaths) AS deaths, sum(pop) AS pop, min(f.year) AS period_start, max(f.year) AS period_end, count(DISTINCT f.year) AS n_years, CASE WHEN min(f.year) = max(f.year) THEN CAST(min(f.year) AS VARCHAR) ELSE min(f.year) || '-' || max(f.year) END AS period_label FROM fullf f JOIN win w ON f.year = w.sy GROUP BY w.year, area, sex, cause, band_idx, age_band",
)
add("P2_clipped_windows", lambda f: pooling.clipped_windows(f.pop, 5, f.births.where("year > 1996").select("year")), "SELECT a.year, b.year AS source_year FROM (SELECT DISTINCT year FROM pop) a JOIN (SELECT DISTINCT year FROM pop WHERE year > 1996) b ON b.year BETWEEN a.year - 2 AND a.year + 2")
add(
    "P3_annualised",
    lambda f: r6(pooling.pooled(f.full, 3, PK).groupBy("year", "area", "sex", "cause").agg(F.sum("deaths").alias("d"), F.max("n_years").alias("n")).select("year", "area", "sex", "cause", pooling.annualised(F.lit("deaths"), F.col("d"), F.col("n")).alias("deaths"), pooling.annualised(F.lit("infant_deaths"), F.col("d"), F.col("n")).alias("total")), "deaths"),
    _WIN + f"p AS (SELECT w.year, area, sex, cause, band_idx, sum(deaths) AS d, count(DISTINCT f.year) AS n FROM fullf f JOIN win w ON f.year = w.sy GROUP BY w.year, area, sex, cause, band_idx) --- SELECT {_K}, round(sum(d) / max(n), 6) AS deaths, sum(d) AS total FROM p GROUP BY ALL",
)
add("P4_expected", lambda f: r6(_expected(f), "expected", "ref_rate"), _EXPECTED + f"SELECT {_K}, observed, round(expected, 6) AS expected, round(ref_rate, 6) AS ref_rate, bands_used, missing_bands FROM ex")
_SMR = f"""CASE WHEN expected > 0 THEN round(observed / expected * 100, 6) END AS smr,
 CASE WHEN expected > 0 AND observed >= 10 THEN round(observed * (1 - 1 / (9 * observed) - {Z95} / (3 * sqrt(observed))) ^ 3 / expected * 100, 6) END AS smr_lower,
 CASE WHEN expected > 0 AND observed >= 10 THEN round((observed + 1) * (1 - 1 / (9 * (observed + 1)) + {Z95} / (3 * sqrt(observed + 1))) ^ 3 / expected * 100, 6) END AS smr_upper,
 CASE WHEN expected > 0 THEN round(observed / expected * ref_rate * 1e5, 6) END AS isr, CASE WHEN bands_used = 0 THEN 'no data' WHEN expected <= 0 THEN 'no deaths expected' END AS note"""
add("P5_smr", lambda f: r6(pooling.smr(_expected(f)).select(*KEYS, "observed", "smr", "smr_lower", "smr_upper", "isr", "note"), "smr", "smr_lower", "smr_upper", "isr"), _EXPECTED + f"SELECT {_K}, observed, {_SMR} FROM ex")
_EXACT = _EXPECTED.replace(" --- ", ", ") + limits_sql("SELECT observed AS k FROM ex") + f", xe AS (SELECT {_K}, observed, expected, lo, hi, {_SMR} FROM ex JOIN poisson ON k = observed) --- "
_SIDES = ", ".join(f"round(coalesce(smr_{a}, CASE WHEN expected > 0 THEN round({b} / expected * 100, 6) END), 3) AS {{{a}}}" for a, b in (("lower", "lo"), ("upper", "hi")))
add("P5_smr_exact", lambda f: r3(r6(pooling.smr_exact(_expected(f)).select(*KEYS, "observed", "smr", "smr_lower", "smr_upper"), "smr", "smr_lower", "smr_upper"), "smr_lower", "smr_upper"), _EXACT + f"SELECT {_K}, observed, smr, {_SIDES.format(lower='smr_lower', upper='smr_upper')} FROM xe")
_CLASS = "CASE WHEN smr_lower IS NULL THEN NULL WHEN smr_lower > 100 THEN 'above' WHEN smr_upper < 100 THEN 'below' ELSE 'no significant difference' END"
add("P6_smr_class", lambda f: pooling.smr_series(f.full, "NATION_1", KEYS).groupBy("class").agg(F.count(F.lit(1)).alias("n")), _EXPECTED + f"SELECT {_CLASS} AS class, count(*) AS n FROM (SELECT {_K}, {_SMR} FROM ex) GROUP BY ALL")
add("P7_smr_series", lambda f: r6(pooling.smr_series(f.full, "NATION_1", KEYS).select(*KEYS, "smr", "class"), "smr"), _EXPECTED + f"SELECT {_K}, smr, {_CLASS} AS class FROM (SELECT {_K}, {_SMR} FROM ex)")


def _region_reference(f: Facts, region: str) -> DataFrame:
    """Deaths and population of one region, built by the roll-up that areas have too."""
    m, cell = geo.members(f.lookup).where("vintage = 'A'"), ["year", "sex", "band_idx", "age_band"]
    chosen = f.lookup.where(F.col("nuts1") == region).select(F.col("nuts1").alias("area"))
    d = geo.rolled_up(f.deaths, m, [*cell, "cause"], "deaths", chosen=chosen)
    return d.join(geo.rolled_up(f.pop, m, cell, "pop", chosen=chosen), ["region", *cell])


add(
    "P8_region_reference",
    lambda f: r6(pooling.expected(f.full, _region_reference(f, "MAINLAND"), KEYS, ["year", "sex", "cause"]).select(*KEYS, "observed", "expected"), "expected"),
    f"rd AS (SELECT year, sex, cause, band_idx, sum(deaths) AS rd FROM deaths JOIN members ON area = municipality AND vintage = 'A' AND region = 'MAINLAND' GROUP BY ALL), rp AS (SELECT year, sex, band_idx, sum(pop) AS rp FROM pop JOIN members ON area = municipality AND vintage = 'A' AND region = 'MAINLAND' GROUP BY ALL), ref AS (SELECT * FROM rd JOIN rp USING (year, sex, band_idx)) --- SELECT {_K}, coalesce(sum(deaths) FILTER (rp IS NOT NULL), 0) AS observed, round(coalesce(sum(pop * rd / rp), 0), 6) AS expected FROM fullf LEFT JOIN ref USING (year, sex, cause, band_idx) GROUP BY ALL",
)

# ---- avoidable mortality

AK = ["year", "area", "sex"]
_GM = "gm AS (SELECT cause, u.g AS grp FROM groups, unnest(CASE WHEN grp IN ('preventable', 'treatable') THEN [grp, 'avoidable'] ELSE [grp] END) AS u(g)), "
add("A1_group_map", lambda f: avoidable.group_map(f.groups).join(f.deaths, "cause").groupBy("cause", "group").agg(F.sum("deaths").alias("deaths")), _GM.rstrip(", ") + ' --- SELECT cause, grp AS "group", sum(deaths) AS deaths FROM gm JOIN deaths USING (cause) GROUP BY ALL')
add("A2_group_deaths", lambda f: avoidable.group_deaths(f.deaths, f.groups, f.bands, AK), _GM.rstrip(", ") + ' --- SELECT year, area, sex, grp AS "group", sum(deaths) AS deaths FROM gm JOIN deaths USING (cause) JOIN bands USING (age_band) WHERE under GROUP BY ALL')
_PARTS = """s AS (SELECT year, area, sex, coalesce(sum(deaths) FILTER (grp = 'preventable'), 0) p, coalesce(sum(deaths) FILTER (grp = 'treatable'), 0) t, coalesce(sum(deaths) FILTER (grp = 'unresolved'), 0) u, coalesce(sum(deaths) FILTER (cause = 'ALL'), 0) a
 FROM deaths JOIN bands USING (age_band) LEFT JOIN groups USING (cause) WHERE under GROUP BY ALL),
 parts AS (SELECT year, area, sex, v.grp, v.deaths, v.deaths / a * 100 AS share FROM s, LATERAL (SELECT 'preventable' AS grp, p AS deaths UNION ALL SELECT 'treatable', t UNION ALL SELECT 'avoidable', p + t UNION ALL SELECT 'unresolved', u UNION ALL SELECT 'other', greatest(a - p - t - u, 0) UNION ALL SELECT 'total', a) AS v)"""
add("A3_breakdown", lambda f: r6(avoidable.breakdown(f.deaths, f.groups, f.bands, AK, "ALL"), "share"), _PARTS + ' --- SELECT year, area, sex, grp AS "group", deaths, round(share, 6) AS share FROM parts')
_GRATE = """pp AS (SELECT year, area, sex, age_band, pop FROM pop JOIN bands USING (age_band) WHERE under), dd AS (SELECT year, area, sex, grp, age_band, sum(deaths) AS deaths FROM deaths JOIN gm USING (cause) GROUP BY ALL),
 gr AS (SELECT year, area, sex, grp, sum(coalesce(deaths, 0)) AS d, sum(weight * coalesce(deaths, 0) / pop) / sum(weight) * 1e5 AS rate FROM pp CROSS JOIN (SELECT DISTINCT grp FROM gm) JOIN bands USING (age_band) LEFT JOIN dd USING (year, area, sex, grp, age_band) GROUP BY ALL)"""
add("A4_group_rate", lambda f: r6(avoidable.group_rate(f.deaths, f.pop, f.groups, f.bands, AK).select(*AK, "group", "deaths", "rate"), "rate"), _GM + _GRATE + ' --- SELECT year, area, sex, grp AS "group", d AS deaths, CASE WHEN d >= 10 THEN round(rate, 6) END AS rate FROM gr')
add("A5_group_table", lambda f: avoidable.group_table(f.deaths, f.pop, f.groups, f.bands, AK, "ALL", 1.0).select(*AK, "group", "deaths", F.when(F.col("rate").isNotNull(), 1).otherwise(0).alias("has_rate")), _GM + _GRATE + ", " + _PARTS + ' --- SELECT p.year, p.area, p.sex, p.grp AS "group", round_even(p.deaths, 0) AS deaths, CASE WHEN g.d >= 10 THEN 1 ELSE 0 END AS has_rate FROM parts p LEFT JOIN gr g USING (year, area, sex, grp)')
add("A6_cause_listing", lambda f: avoidable.cause_listing(f.groups).join(f.deaths.select("cause").distinct(), "cause", "left_semi"), "SELECT cause, grp AS \"group\", coalesce(reason, '') AS reason FROM groups WHERE cause IN (SELECT cause FROM deaths)")

# ---- comparisons


def _annual(f: Facts, metric: str, limits: bool = False) -> DataFrame:
    return annual.annual_metric(metric, f.full, f.bands, f.infant, f.births, "HM", "NATION_1", "ALL", CUTOFF, THIN_BIRTHS, limits)


_HM = "h AS (SELECT * FROM fullf WHERE sex = 'HM') --- "
_ROW = "SELECT area AS location, cause, '{m}' AS metric, year, {v} AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, {f} AS flag FROM {t}"
for _m, _v in (("deaths", "sum(deaths)"), ("crude", "round(sum(deaths) / sum(pop) * 1e5, 6)")):
    add(f"C1_annual_{_m}", lambda f, m=_m: r6(_annual(f, m), "value"), _HM + _ROW.format(m=_m, v=_v, f="''", t="h") + " GROUP BY ALL")
add("C1_annual_ypll", lambda f: _annual(f, "ypll"), _HM + _ROW.format(m="ypll", v=f"sum(deaths * greatest({CUTOFF} - mid, 0))", f="''", t="h JOIN bands USING (age_band)") + " GROUP BY ALL")
add("C1_annual_infant", lambda f: r6(_annual(f, "infant"), "value"), " --- " + _ROW.format(m="infant", v="round(deaths / births * 1000, 6)", f=f"CASE WHEN births < {THIN_BIRTHS} THEN '*' ELSE '' END", t="infant LEFT JOIN births USING (year, area) WHERE sex = 'HM'"))
add("C1_annual_infant_deaths", lambda f: _annual(f, "infant_deaths"), " --- " + _ROW.format(m="infant_deaths", v="deaths", f="''", t="infant WHERE sex = 'HM'"))
add("C1_annual_proportional", lambda f: r6(_annual(f, "proportional"), "value"), "c AS (SELECT year, area, cause, sum(deaths) AS d FROM fullf WHERE sex = 'HM' GROUP BY ALL), x AS (SELECT a.year, a.area, a.cause, a.d / b.d * 100 AS s FROM c a JOIN c b ON a.year = b.year AND a.area = b.area AND b.cause = 'ALL' AND a.cause <> 'ALL') --- " + _ROW.format(m="proportional", v="round(s, 6)", f="''", t="x"))
add("C1_annual_dsr_limits", lambda f: r3(r6(_annual(f, "dsr", True), "value"), "lower", "upper"), "hm AS (SELECT * FROM fullf WHERE sex = 'HM'), " + _DW.format(k="year, area, cause", t="hm") + limits_sql("SELECT d AS k FROM dw") + f" --- SELECT area AS location, cause, 'dsr' AS metric, year, rate AS value, lower, upper, '' AS flag FROM (SELECT year, area, cause, {_DL} FROM dw JOIN poisson ON k = d)")
_HMX = _EXACT.replace("FROM fullf", "FROM (SELECT * FROM fullf WHERE sex = 'HM')")
add("C1_annual_smr_limits", lambda f: r3(r6(_annual(f, "smr", True), "value", "lower", "upper"), "lower", "upper"), _HMX + f"SELECT area AS location, cause, 'smr' AS metric, year, smr AS value, {_SIDES.format(lower='lower', upper='upper')}, '' AS flag FROM xe")
_ISR_SIDES = ", ".join(f"round(CASE WHEN expected > 0 THEN CASE WHEN observed >= 10 THEN {b} ELSE {e} END / expected * ref_rate * 1e5 END, 3) AS {a}" for a, b, e in (("lower", f"observed * (1 - 1 / (9 * observed) - {Z95} / (3 * sqrt(observed))) ^ 3", "lo"), ("upper", f"(observed + 1) * (1 - 1 / (9 * (observed + 1)) + {Z95} / (3 * sqrt(observed + 1))) ^ 3", "hi"))) + ", ''"
add("C1_annual_isr_limits", lambda f: r3(r6(_annual(f, "isr", True), "value"), "lower", "upper"), _HMX.replace("expected, lo, hi,", "expected, ref_rate, lo, hi,") + f"SELECT area AS location, cause, 'isr' AS metric, year, isr AS value, {_ISR_SIDES} AS flag FROM xe")


def _annual_table(f: Facts) -> DataFrame:
    """The annual table over windows of 1, 3 and 5 years; each fact says which of two sources, by year, it is from."""
    source = lambda year: F.when(F.col("year") < year, "S1").otherwise("S2")
    full = f.full.withColumns({"death_source": source(1996), "population_source": source(1998)})
    return annual.annual_table(full, f.bands, f.infant, f.births, "HM", "NATION_1", "ALL", CUTOFF, THIN_BIRTHS, youngest=(YOUNGEST, 0.5, 3.0))


YOUNGEST = "0 - 4"
_LISTED = "string_agg(DISTINCT {c}, ', ' ORDER BY {c})"
_ANNUAL = (
    f"""yrs AS (SELECT DISTINCT year FROM fullf), iy AS (SELECT DISTINCT year FROM infant WHERE sex = 'HM'), ry AS (SELECT year FROM iy WHERE year IN (SELECT year FROM births)),
 w AS (SELECT win, a.year, b.year AS sy FROM (VALUES (1), (3), (5)) AS v(win), yrs a, yrs b WHERE abs(a.year - b.year) <= (win - 1) // 2),
 span AS (SELECT win, year, count(*) AS n_all, min(sy) AS a0, max(sy) AS b0, count(*) FILTER (sy IN (FROM iy)) AS ni, min(sy) FILTER (sy IN (FROM iy)) AS ai, max(sy) FILTER (sy IN (FROM iy)) AS bi, count(*) FILTER (sy IN (FROM ry)) AS nr, min(sy) FILTER (sy IN (FROM ry)) AS ar, max(sy) FILTER (sy IN (FROM ry)) AS br FROM w GROUP BY ALL),
 hm AS MATERIALIZED (SELECT *, CASE WHEN year < 1996 THEN 'S1' ELSE 'S2' END AS ds, CASE WHEN year < 1998 THEN 'S1' ELSE 'S2' END AS ps FROM fullf WHERE sex = 'HM'),
 pl AS MATERIALIZED (SELECT win, w.year, area, cause, age_band, mid, weight, sum(deaths) AS d, sum(pop) AS p FROM hm JOIN w ON w.sy = hm.year JOIN bands USING (band_idx, age_band) GROUP BY ALL),
 so AS MATERIALIZED (SELECT win, w.year, area, cause, {_LISTED.format(c="ds")} AS ds, {_LISTED.format(c="ps")} AS ps FROM hm JOIN w ON w.sy = hm.year GROUP BY ALL),
 rf AS (SELECT win, year, cause, age_band, d AS rd, p AS rp FROM pl WHERE area = 'NATION_1' AND p > 0),
 un AS MATERIALIZED (SELECT win, w.year, area, cause, sum(deaths) AS u, count(*) AS cov, sum(deaths) FILTER (i.year IN (FROM ry)) AS ur, count(*) FILTER (i.year IN (FROM ry)) AS covr FROM infant i JOIN w ON w.sy = i.year WHERE sex = 'HM' GROUP BY ALL),
 bo AS (SELECT win, w.year, area, sum(births) AS births FROM births b JOIN w ON w.sy = b.year WHERE b.year IN (FROM ry) GROUP BY ALL),
 sp AS MATERIALIZED (SELECT pl.*, un.u, coalesce(cov = n_all, false) AS split FROM pl LEFT JOIN un USING (win, year, area, cause) JOIN span USING (win, year)),
 pt AS (SELECT win, year, area, cause, d AS dd, mid AS m FROM sp WHERE NOT (split AND age_band = '{YOUNGEST}')
  UNION ALL SELECT win, year, area, cause, least(u, d), 0.5 FROM sp WHERE split AND age_band = '{YOUNGEST}' UNION ALL SELECT win, year, area, cause, d - least(u, d), 3.0 FROM sp WHERE split AND age_band = '{YOUNGEST}'),
 yl AS (SELECT win, year, area, cause, coalesce(sum(dd) FILTER (m < {CUTOFF}), 0) AS y0, sum(dd * greatest({CUTOFF} - m, 0)) AS y1, sum(dd * greatest({CUTOFF} - m, 0) ^ 2) AS y2 FROM pt GROUP BY ALL),
 hy AS (SELECT win, year, area, cause, bool_or(split AND age_band = '{YOUNGEST}') AS apart, any_value(u) AS uu FROM sp GROUP BY ALL),
 se AS MATERIALIZED (SELECT win, year, area, cause, sum(d) AS d, sum(p) AS p, sum(weight) AS sw, sum(weight * d / p) AS wr, sum(weight ^ 2 * d / p ^ 2) AS v, coalesce(sum(d) FILTER (rp IS NOT NULL), 0) AS o, coalesce(sum(p * rd / rp), 0) AS e, sum(rd) / sum(rp) AS rr FROM pl LEFT JOIN rf USING (win, year, cause, age_band) GROUP BY ALL),
 al AS MATERIALIZED (SELECT win, year, area, d AS ad, ds AS ads FROM se JOIN so USING (win, year, area, cause) WHERE cause = 'ALL'),
 ik AS MATERIALIZED (SELECT un.*, span.*, births, CASE WHEN cov = ni THEN u END AS ic, CASE WHEN covr = nr THEN ur END AS ir FROM un JOIN span USING (win, year) LEFT JOIN bo USING (win, year, area)),
 jo AS MATERIALIZED (SELECT se.*, y0, y1, y2, ds, ps, ad, ads, n_all, a0, b0, apart, uu FROM se JOIN yl USING (win, year, area, cause) JOIN so USING (win, year, area, cause) JOIN hy USING (win, year, area, cause) JOIN span USING (win, year) LEFT JOIN al USING (win, year, area)),
 bk AS (SELECT DISTINCT d AS k, ad AS n FROM jo WHERE ad > 0 AND cause <> 'ALL'),"""
    + _BIN.split("FROM pr),", 1)[1].replace("---", ", ")
    + limits_sql("SELECT d AS k FROM jo UNION SELECT o FROM jo UNION SELECT y0 FROM jo UNION SELECT ic FROM ik UNION SELECT ir FROM ik")
).replace("pk AS (", "pk AS MATERIALIZED (").replace("bk AS (", "bk AS MATERIALIZED (").replace("poisson AS (", "poisson AS MATERIALIZED (").replace("binomial AS (", "binomial AS MATERIALIZED (")


def _annual_rows(metric: str, value: str, lower: str, upper: str, detail: str, source: str, n: str = "n_all", a: str = "a0", b: str = "b0", flag: str = "''") -> str:
    return f"SELECT area AS location, cause, win AS \"window\", year, '{metric}' AS metric, CASE WHEN {a} = {b} THEN CAST({a} AS VARCHAR) ELSE {a} || '-' || {b} END AS period, CAST({n} AS INTEGER) AS n_years, round({value}, 6) AS value, round({lower}, 3) AS lower, round({upper}, 3) AS upper, {flag} AS flag, {detail} AS source_detail FROM {source}"


_POP, _BY = "'Pop.: ' || ps || '; deaths: ' || ds", "JOIN poisson ON k = round_even({c}, 0)"
_LOW = f"CASE WHEN o >= 10 THEN o * (1 - 1 / (9 * o) - {Z95} / (3 * sqrt(o))) ^ 3 ELSE lo END"
_HIGH = f"CASE WHEN o >= 10 THEN (o + 1) * (1 - 1 / (9 * (o + 1)) + {Z95} / (3 * sqrt(o + 1))) ^ 3 ELSE hi END"
_E, _S = "CASE WHEN e > 0 THEN e END", "CASE WHEN y0 > 0 AND y2 > 0 THEN sqrt(y2 / round_even(y0, 0)) END"
_SPREAD = "CASE WHEN d >= 10 THEN wr / sw * 1e5 + sqrt(v / sw ^ 2 * 1e10 / d) * ({c} - d) END"
_ANNUAL_SQL = " UNION ALL ".join(
    [
        _annual_rows("deaths", "d / n_all", "lo / n_all", "hi / n_all", "ds", "jo " + _BY.format(c="d")),
        _annual_rows("crude", "d / p * 1e5", "lo / p * 1e5", "hi / p * 1e5", _POP, "jo " + _BY.format(c="d")),
        _annual_rows("dsr", "CASE WHEN d >= 10 THEN wr / sw * 1e5 END", _SPREAD.format(c="lo"), _SPREAD.format(c="hi"), _POP, "jo " + _BY.format(c="d")),
        _annual_rows("smr", f"o / {_E} * 100", f"{_LOW} / {_E} * 100", f"{_HIGH} / {_E} * 100", _POP + " || '; ref.: NATION_1 (O=' || CAST(round_even(o, 0) AS BIGINT) || ', E=' || format('{:.1f}', round_even(e, 1)) || ')'", "jo " + _BY.format(c="o")),
        _annual_rows("isr", f"o / {_E} * rr * 1e5", f"{_LOW} / {_E} * rr * 1e5", f"{_HIGH} / {_E} * rr * 1e5", _POP + " || '; ref.: NATION_1'", "jo " + _BY.format(c="o")),
        _annual_rows("proportional", "d / ad * 100", "lo * 100", "hi * 100", "'deaths: ' || ds || '; of: ' || ads", "jo JOIN binomial ON k = d AND n = ad WHERE cause <> 'ALL'"),
        _annual_rows("ypll", "y1 / n_all", f"coalesce(greatest(y1 + {_S} * (lo - round_even(y0, 0)), 0), 0) / n_all", f"coalesce(y1 + {_S} * (hi - round_even(y0, 0)), y1) / n_all", "ds || CASE WHEN apart THEN '; under one apart (' || CAST(uu AS BIGINT) || ')' ELSE '; under one not apart' END", "jo " + _BY.format(c="y0")),
        _annual_rows("infant_deaths", "ic", "lo", "hi", "'deaths under one: ' || coalesce(CAST(CAST(ic AS BIGINT) AS VARCHAR), 'N/D')", "ik LEFT " + _BY.format(c="ic"), "ni", "ai", "bi"),
        _annual_rows("infant", "ir / births * 1000", "lo / births * 1000", "hi / births * 1000", "'deaths under one: ' || coalesce(CAST(CAST(ir AS BIGINT) AS VARCHAR), 'N/D') || '; births: ' || coalesce(CAST(CAST(births AS BIGINT) AS VARCHAR), 'N/D')", "ik LEFT " + _BY.format(c="ir"), "nr", "ar", "br", f"CASE WHEN births < {THIN_BIRTHS} THEN '*' ELSE '' END"),
    ]
)
add("C1_annual_pooled", lambda f: r3(r6(_annual_table(f), "value"), "lower", "upper"), _ANNUAL + " --- " + _ANNUAL_SQL)
add("C2_comparators", lambda f: annual.comparators(f.pop.select("area").distinct(), "NATION", "MAINLAND", geo.members(f.lookup).where("vintage = 'A'"), "selection"), "SELECT DISTINCT 'selection' AS label, area FROM pop UNION SELECT 'MAINLAND', municipality FROM members WHERE vintage = 'A' AND region = 'MAINLAND' UNION SELECT 'NATION', 'NATION'")


def _one_year(f: Facts, metric: str = "deaths", limits: bool = False) -> DataFrame:
    return _annual(f, metric, limits).where("year = 1997 AND location IN ('NATION_1', 'NATION_2', 'NATION_3')")


_MX = "h AS (SELECT area AS location, cause, sum(deaths) AS v FROM fullf WHERE sex = 'HM' AND year = 1997 AND area IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY ALL), o AS (SELECT cause, row_number() OVER (ORDER BY v DESC, cause) AS rank FROM h WHERE location = 'NATION_2') --- "
add("C3_cause_order", lambda f: annual.cause_order(_one_year(f), "NATION_2"), _MX + "SELECT cause, rank FROM o")
add("C4_matrix", lambda f: annual.matrix(_one_year(f), ["NATION_1", "NATION_2", "NATION_3"], "NATION_2"), _MX + "SELECT cause, max(format('{:.2f}', v)) FILTER (location = 'NATION_1') AS NATION_1, max(format('{:.2f}', v)) FILTER (location = 'NATION_2') AS NATION_2, max(format('{:.2f}', v)) FILTER (location = 'NATION_3') AS NATION_3, any_value(rank) AS rank FROM h JOIN o USING (cause) GROUP BY cause")
_ML = "h AS (SELECT area AS location, cause, sum(deaths) AS d, sum(pop) AS p FROM fullf WHERE sex = 'HM' AND year = 1997 AND area IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY ALL), " + limits_sql("SELECT d AS k FROM h") + ", t AS (SELECT *, format('{:.2f} ({:.2f}; {:.2f})', round_even(d / p * 1e5, 2), round_even(lo / p * 1e5, 2), round_even(hi / p * 1e5, 2)) AS v FROM h JOIN poisson ON k = d), o AS (SELECT cause, row_number() OVER (ORDER BY d / p DESC, cause) AS rank FROM h WHERE location = 'NATION_2') --- "
add("C4_matrix_limits", lambda f: annual.matrix(_one_year(f, "crude", True), ["NATION_1", "NATION_2", "NATION_3"], "NATION_2"), _ML + "SELECT cause, " + ", ".join(f"max(v) FILTER (location = 'NATION_{k}') AS NATION_{k}" for k in (1, 2, 3)) + ", any_value(rank) AS rank FROM t JOIN o USING (cause) GROUP BY cause")


def _sourced(f: Facts) -> DataFrame:
    d = f.source_deaths.where("year = 1997 AND area IN ('NATION_1', 'NATION_2')").groupBy("cause", F.col("area").alias("location"))
    return d.agg(F.array_join(F.sort_array(F.collect_set("source_indicator")), ", ").alias("source_detail"))


add("C5_sources_matrix", lambda f: annual.sources_matrix(_sourced(f), ["NATION_1", "NATION_2"]), "s AS (SELECT cause, area, string_agg(DISTINCT source_indicator, ', ' ORDER BY source_indicator) AS t FROM source_deaths WHERE year = 1997 AND area IN ('NATION_1', 'NATION_2') GROUP BY ALL) --- SELECT cause, max(t) FILTER (area = 'NATION_1') AS NATION_1, max(t) FILTER (area = 'NATION_2') AS NATION_2 FROM s GROUP BY cause")
add("C6_footnote", lambda f: annual.needs_footnote(_annual(f, "infant").unionByName(_annual(f, "deaths"))), f"SELECT 'infant' AS metric, bool_or(births < {THIN_BIRTHS}) AS footnote FROM infant JOIN births USING (year, area) WHERE sex = 'HM' UNION ALL SELECT 'deaths', false")
_FL = "fl AS (SELECT series_id, arg_min(value, year) AS f, arg_max(value, year) AS l, min(year) AS a, max(year) AS b FROM series GROUP BY ALL) --- "
add("C7_observed_summary", lambda f: r6(annual.observed_summary(f.series, ["series_id"]), "first", "last", "change", "percent"), _FL + "SELECT series_id, round(f, 6) AS first, round(l, 6) AS last, a AS first_year, b AS last_year, round(l - f, 6) AS change, CASE WHEN f <> 0 THEN round((l - f) / f * 100, 6) END AS percent FROM fl")



def _rated(f: Facts) -> DataFrame:
    rows = rates.crude_rate_limits(f.full.where("sex = 'HM'"), ["area", "cause", "year"])
    return rows.select("area", "cause", "year", F.col("rate").alias("value"), "lower", "upper")


def _named_sources(f: Facts) -> DataFrame:
    listed = lambda df, keys, name: df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("source_indicator")), ", ").alias(name))
    return listed(f.source_deaths, ["area", "cause"], "death_source").join(listed(f.source_pop, ["area"], "population_source"), "area")


add(
    "C7_summary_with_limits",
    lambda f: r3(r6(annual.observed_summary(_rated(f).where("cause <> 'ALL'"), ["area", "cause"], _named_sources(f)), "first", "last", "change", "percent"), "last_lower", "last_upper"),
    "h AS (SELECT area, cause, year, sum(deaths) AS d, sum(pop) AS p FROM fullf WHERE sex = 'HM' AND cause <> 'ALL' GROUP BY ALL), "
    + limits_sql("SELECT d AS k FROM h")
    + ", x AS (SELECT *, d / p * 1e5 AS v FROM h JOIN poisson ON k = d), sd AS (SELECT area, cause, string_agg(DISTINCT source_indicator, ', ' ORDER BY source_indicator) AS death_source FROM source_deaths GROUP BY ALL), sp AS (SELECT area, string_agg(DISTINCT source_indicator, ', ' ORDER BY source_indicator) AS population_source FROM source_pop GROUP BY ALL), s AS (SELECT area, cause, arg_min(v, year) AS f, arg_max(v, year) AS l, min(year) AS a, max(year) AS b, arg_max(lo / p * 1e5, year) AS ll, arg_max(hi / p * 1e5, year) AS lu FROM x GROUP BY ALL) --- "
    + "SELECT area, cause, round(ll, 3) AS last_lower, round(lu, 3) AS last_upper, round(f, 6) AS first, round(l, 6) AS last, a AS first_year, b AS last_year, round(l - f, 6) AS change, CASE WHEN f <> 0 THEN round((l - f) / f * 100, 6) END AS percent, population_source, death_source FROM s LEFT JOIN sd USING (area, cause) LEFT JOIN sp USING (area)",
)

# ---- forecasts

H, MODELS, QUICK = 5, ["naive", "drift", "theta", "holt", "holt_damped", "ets"], ["naive", "drift"]
BOUNDS = ("mean", "lower", "upper")
_LAST = "d AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY year) AS d FROM series), t AS (SELECT series_id, arg_max(value, year) AS l, arg_min(value, year) AS f, max(year) AS y, count(*) AS n, sqrt(sum(d ^ 2) / (count(*) - 1)) AS s, (arg_max(value, year) - arg_min(value, year)) / (count(*) - 1) AS dr FROM d GROUP BY ALL HAVING count(*) >= 3), sd AS (SELECT series_id, sqrt(sum((d - dr) ^ 2) / (max(n) - 2)) AS s2 FROM d JOIN t USING (series_id) WHERE d IS NOT NULL GROUP BY ALL), hz AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS h), nv AS (SELECT series_id, 'naive' AS model, CAST(y + h AS INTEGER) AS year, l AS m, s * sqrt(h) AS se FROM t, hz), dr AS (SELECT series_id, 'drift' AS model, CAST(y + h AS INTEGER) AS year, l + h * dr AS m, s2 * sqrt(h * (1 + h / (n - 1))) AS se FROM t JOIN sd USING (series_id), hz) --- "
_FC = f"SELECT series_id, model, year, round(m, 6) AS mean, round(m - {Z95} * se, 6) AS lower, round(m + {Z95} * se, 6) AS upper FROM "
add("F1_log_transform", lambda f: r6(fc.logged(f.daily), "offset", "log_value"), "o AS (SELECT series_id, coalesce(min(value) FILTER (value > 0) / 2, 1e-6) AS o, count(*) FILTER (value = 0) AS z FROM daily GROUP BY ALL) --- SELECT series_id, year, value, round(o, 6) AS \"offset\", z AS n_zero, false AS negative, round(ln(value + o), 6) AS log_value FROM daily JOIN o USING (series_id)")


def _log_forecast(f: Facts) -> DataFrame:
    logs = fc.logged(f.series)
    made = fc.naive(fc.arrays(logs.select("series_id", "year", F.col("log_value").alias("value"))), H)
    j = made.join(logs.select("series_id", "offset").distinct(), "series_id")
    mean, lower, upper = fc.back(F.col("mean"), F.col("lower"), F.col("upper"), F.col("offset"))
    return j.select("series_id", "model", "year", mean.alias("mean"), lower.alias("lower"), upper.alias("upper"))


add(
    "F2_back_transform",
    lambda f: r6(_log_forecast(f), *BOUNDS),
    f"o AS (SELECT series_id, coalesce(min(value) FILTER (value > 0) / 2, 1e-6) AS o FROM series GROUP BY ALL), d AS (SELECT series_id, year, ln(value + o) AS v, ln(value + o) - lag(ln(value + o)) OVER (PARTITION BY series_id ORDER BY year) AS d FROM series JOIN o USING (series_id)), t AS (SELECT series_id, arg_max(v, year) AS l, max(year) AS y, sqrt(sum(d ^ 2) / (count(*) - 1)) AS s FROM d GROUP BY ALL HAVING count(*) >= 3) --- SELECT series_id, 'naive' AS model, CAST(y + h AS INTEGER) AS year, round(greatest(exp(l + s ^ 2 * h / 2) - o, 0), 6) AS mean, round(greatest(exp(l - {Z95} * s * sqrt(h)) - o, 0), 6) AS lower, round(greatest(exp(l + {Z95} * s * sqrt(h)) - o, 0), 6) AS upper FROM t JOIN o USING (series_id), (SELECT unnest(range(1, 6)) AS h)",
)
add("F3_naive", lambda f: r6(fc.naive(fc.arrays(f.series), H), *BOUNDS), _LAST + _FC + "nv")
add("F4_drift", lambda f: r6(fc.drift(fc.arrays(f.series), H), *BOUNDS), _LAST + _FC + "dr")


def _fit_sql(model: str) -> str:
    """Tables r0, r1, ... of a model's runs over the grid and the finer points, and `fit_<model>`: series_id, v, n, y, al, be, ph, l, b, sse, aicc."""
    out, points = [], ", ".join(f"({a}, {b}, {p})" for a, b, p in fc.GRID[model])
    source = f"(SELECT sa.*, g.* FROM sa, (VALUES {points}) AS g(al, be, ph))"
    for k in range(len(fc.WIDTHS) + 1):
        run, best = f"{model}_r{k}", f"{model}_b{k}"
        out.append(
            f"{run} AS (SELECT series_id, v, n, y, CAST(al AS DOUBLE) AS al, CAST(be AS DOUBLE) AS be, CAST(ph AS DOUBLE) AS ph, 2 AS t, v[1] AS l, CASE WHEN ph > 0 THEN v[2] - v[1] ELSE 0.0 END AS b, CAST(0 AS DOUBLE) AS sse FROM {source}"
            f" UNION ALL SELECT series_id, v, n, y, al, be, ph, t + 1, lev, CASE WHEN ph > 0 THEN be * (lev - l) + (1 - be) * ph * b ELSE 0.0 END, sse + (v[t] - ah) * (v[t] - ah) FROM (SELECT *, al * v[t] + (1 - al) * ah AS lev FROM (SELECT *, l + ph * b AS ah FROM {run} WHERE t <= n)))"
        )
        out.append(f"{best} AS (SELECT * FROM {run} WHERE t = n + 1 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY sse, al, be, ph) = 1)")
        if k < len(fc.WIDTHS):
            moves = f"(VALUES ({-fc.WIDTHS[k]}), (0.0), ({fc.WIDTHS[k]}))"
            beta = "(VALUES (0.0))" if model == "ses" else moves
            phi = moves if model == "holt_damped" else "(VALUES (0.0))"
            new_be = "0.0" if model == "ses" else "least(greatest(be + CAST(e AS DOUBLE), 0.001), 0.99)"
            new_ph = "least(greatest(ph + CAST(f AS DOUBLE) / 4, 0.8), 0.98)" if model == "holt_damped" else "ph"
            source = f"(SELECT series_id, v, n, y, least(greatest(al + CAST(d AS DOUBLE), 0.01), 0.99) AS al, {new_be} AS be, {new_ph} AS ph FROM {best}, {moves} AS x(d), {beta} AS z(e), {phi} AS w(f))"
    free = fc._FREE[model]
    out.append(f"fit_{model} AS (SELECT *, '{model}' AS form, n * ln(greatest(sse, 1e-12) / n) + {2.0 * free} + CASE WHEN n - {free} - 1 > 0 THEN {2.0 * free * (free + 1)} / (n - {free} - 1) ELSE 1e6 END AS aicc FROM {model}_b{len(fc.WIDTHS)})")
    return ", ".join(out)


_SA = "sa AS (SELECT series_id, list(value ORDER BY year) AS v, count(*) AS n, max(year) AS y, regr_slope(value, i) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY year) AS i FROM series) GROUP BY series_id HAVING count(*) >= 3), hh AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS h), "
_SUM = "CASE WHEN ph = 1 THEN {j} WHEN ph = 0 THEN 0.0 ELSE ph * (1 - ph ^ {j}) / (1 - ph) END"
_AHEAD = f"SELECT series_id, '{{m}}' AS model, CAST(y + h AS INTEGER) AS year, l + {_SUM.format(j='h')} * b AS m, sqrt(sse / (n - 1)) * sqrt(1 + coalesce(list_sum(list_transform(range(1, h), lambda j: (al * (1 + be * ({_SUM.format(j='j')}))) ^ 2)), 0)) AS se FROM {{t}}, hh"
_THETA = "SELECT series_id, 'theta' AS model, CAST(y + h AS INTEGER) AS year, l + slope / 2 * (h - 1 + 1 / al - (1 - al) ^ n / al) AS m, sqrt(sse / (n - 1)) * sqrt(1 + (h - 1) * al * al) AS se FROM fit_ses JOIN (SELECT series_id, slope FROM sa) USING (series_id), hh"
_ETS = "fit_ets AS (SELECT * FROM (SELECT * FROM fit_ses UNION ALL SELECT * FROM fit_holt UNION ALL SELECT * FROM fit_holt_damped) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aicc, form) = 1)"
_FITS = _SA + ", ".join(_fit_sql(m) for m in ("ses", "holt", "holt_damped")) + ", " + _ETS
for _i, _m in ((5, "theta"), (6, "holt"), (7, "holt_damped"), (8, "ets")):
    _made = _THETA if _m == "theta" else _AHEAD.format(m=_m, t=f"fit_{_m}")
    add(f"F{_i}_{_m}", lambda f, m=_m: r6(fc.MODELS[m](fc.arrays(f.series), H), *BOUNDS), _FITS + f", made AS ({_made}) --- " + _FC + "made")
add("F9_horizon", lambda f: fc.horizon(fc.arrays(f.series), H).select("series_id", "h", "year"), "SELECT series_id, h, CAST(max(year) + h AS INTEGER) AS year FROM series, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS h) GROUP BY series_id, h")
add("F10_failures", lambda f: fc.failures(fc.arrays(f.series.where("year < 1997 OR series_id < 'NATION_2'"))), "SELECT series_id, 'too short' AS status FROM series WHERE year < 1997 OR series_id < 'NATION_2' GROUP BY ALL HAVING count(*) < 3")
_ERR = ("me", "rmse", "mae", "mape", "mase")
_PAIRS = "d AS (SELECT series_id, value AS actual, lag(value) OVER (PARTITION BY series_id ORDER BY year) AS predicted, count(*) OVER (PARTITION BY series_id) AS n FROM series), sc AS (SELECT series_id, avg(abs(actual - predicted)) AS sc FROM d GROUP BY ALL), p AS (SELECT * FROM d WHERE predicted IS NOT NULL AND n >= 3) --- "
_ERRSQL = "SELECT series_id, {m} round(avg(predicted - actual), 6) AS me, round(sqrt(avg((predicted - actual) ^ 2)), 6) AS rmse, round(avg(abs(predicted - actual)), 6) AS mae, round(avg(CASE WHEN abs(actual) > 1e-8 THEN abs((predicted - actual) / actual) END) * 100, 6) AS mape, CASE WHEN max(sc) > 0 THEN round(avg(abs(predicted - actual)) / max(sc), 6) END AS mase FROM p JOIN sc USING (series_id) GROUP BY ALL"


def _naive_pairs(f: Facts) -> DataFrame:
    return fc.fitted(fc.arrays(f.series), "naive").select("series_id", F.col("value").alias("actual"), F.col("fitted").alias("predicted"))


add("F11_errors", lambda f: r6(fc.errors(_naive_pairs(f), ["series_id"], fc.scale(f.series)), *_ERR), _PAIRS + _ERRSQL.format(m=""))
add("F12_insample", lambda f: r6(fc.insample(f.series, MODELS[:2] + ["holt"]), *_ERR))
add("F13_fitted", lambda f: r6(fc.fitted(fc.arrays(f.series), "drift"), "value", "fitted"), "t AS (SELECT series_id, (arg_max(value, year) - arg_min(value, year)) / (count(*) - 1) AS dr FROM series GROUP BY ALL HAVING count(*) >= 3) --- SELECT series_id, 'drift' AS model, year, round(value, 6) AS value, round(lag(value) OVER (PARTITION BY series_id ORDER BY year) + dr, 6) AS fitted FROM series JOIN t USING (series_id)")
add("F14_test_size", lambda f: fc.arrays(f.daily).select("series_id", "n", fc.test_size(F.col("n"), 0.25).alias("quarter"), fc.test_size(F.col("n"), 0.95).alias("most")), "SELECT series_id, CAST(count(*) AS INTEGER) AS n, CASE WHEN count(*) < 4 THEN 0 ELSE CAST(least(greatest(1, round_even(count(*) * 0.25, 0)), count(*) - 3) AS INTEGER) END AS quarter, CASE WHEN count(*) < 4 THEN 0 ELSE CAST(least(greatest(1, round_even(count(*) * 0.95, 0)), count(*) - 3) AS INTEGER) END AS most FROM daily GROUP BY ALL")
_HOLD = "s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY year) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM series), k AS (SELECT *, CASE WHEN n < 4 THEN 0 ELSE least(greatest(1, round_even(n * 0.3, 0)), n - 3) END AS k FROM s), "
add(
    "F15_holdout",
    lambda f: r6(fc.holdout(f.series, 0.3, QUICK), *_ERR),
    _HOLD + "tr AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY i) AS pv FROM k WHERE i <= n - k AND k > 0), e AS (SELECT series_id, arg_max(value, i) AS l, (arg_max(value, i) - arg_min(value, i)) / (count(*) - 1) AS dr, max(i) AS e FROM tr GROUP BY ALL), sc AS (SELECT series_id, avg(abs(value - pv)) AS sc FROM tr GROUP BY ALL), p AS (SELECT series_id, m.model, value AS actual, l + CASE m.model WHEN 'drift' THEN dr * (i - e) ELSE 0 END AS predicted FROM k JOIN e USING (series_id), (VALUES ('naive'), ('drift')) AS m(model) WHERE i > n - k AND k > 0) --- " + _ERRSQL.format(m="model,"),
)
add(
    "F16_rolling",
    lambda f: r6(fc.rolling(f.series, 0.3, QUICK), *_ERR),
    _HOLD + "w AS (SELECT *, lag(value) OVER x AS pv, first_value(value) OVER x AS fv FROM k WINDOW x AS (PARTITION BY series_id ORDER BY i)), sc AS (SELECT series_id, avg(abs(value - pv)) AS sc FROM w GROUP BY ALL), p AS (SELECT series_id, m.model, value AS actual, pv + CASE m.model WHEN 'drift' THEN (pv - fv) / (i - 2) ELSE 0 END AS predicted FROM w, (VALUES ('naive'), ('drift')) AS m(model) WHERE i > n - k AND k > 0) --- " + _ERRSQL.format(m="model,"),
)
add("F17_validated", lambda f: r6(fc.validated(f.series, "rolling", 0.3, MODELS), *_ERR))
add("F18_recommended", lambda f: fc.recommended(fc.rolling(f.series, 0.3, MODELS)))
add("F19_ranking", lambda f: fc.ranked(fc.insample(f.series, MODELS)).select("series_id", "model", "rank"))
add(
    "F20_projection",
    lambda f: r6(fc.projection(f.series, fc.naive(fc.arrays(f.series), H)), "observed", "projected", "lower", "upper", "change", "percent"),
    _LAST + f"SELECT series_id, 'naive' AS model, CAST(y AS INTEGER) AS observed_year, round(l, 6) AS observed, CAST(y + 5 AS INTEGER) AS projected_year, round(l, 6) AS projected, round(l - {Z95} * s * sqrt(5), 6) AS lower, round(l + {Z95} * s * sqrt(5), 6) AS upper, 0.0 AS change, CASE WHEN l <> 0 THEN 0.0 END AS percent FROM t",
)
add("F21_reliability", lambda f: r6(fc.reliability(f.series, fc.forecast(fc.arrays(f.series), H, MODELS), fc.recommended(fc.insample(f.series, MODELS))), "interval_ratio", "agreement_ratio"))
add("F22_trend_class", lambda f: annual.observed_summary(f.series, ["series_id"]).where("percent IS NOT NULL").select("series_id", fc.trend_class(F.col("percent")).alias("trend")), _FL + "SELECT series_id, CASE WHEN abs((l - f) / f * 100) < 5 THEN 'stable' WHEN l > f THEN 'up' ELSE 'down' END AS trend FROM fl WHERE f <> 0")
add("F23_observed_and_forecast", lambda f: r6(fc.observed_and_forecast(f.series, fc.naive(fc.arrays(f.series), H)), "observed", *BOUNDS), _LAST + f"SELECT series_id, year, round(value, 6) AS observed, model, round(m, 6) AS mean, round(m - {Z95} * se, 6) AS lower, round(m + {Z95} * se, 6) AS upper FROM series FULL JOIN nv USING (series_id, year)")
_ALL = _LAST.replace(" --- ", ", ") + _FITS + ", made AS (SELECT series_id, model, year, m, se FROM nv UNION ALL SELECT series_id, model, year, m, se FROM dr UNION ALL " + " UNION ALL ".join([_THETA, *(_AHEAD.format(m=m, t=f"fit_{m}") for m in ("holt", "holt_damped", "ets"))]) + ") --- "
add(
    "F23_wide",
    lambda f: r6(fc.wide_forecast(f.series, fc.forecast(fc.arrays(f.series), H, MODELS), MODELS), "observed", *MODELS),
    _ALL + "SELECT coalesce(s.series_id, w.series_id) AS series_id, coalesce(s.year, w.year) AS year, round(value, 6) AS observed, " + ", ".join(MODELS) + " FROM series s FULL JOIN (SELECT series_id, year, " + ", ".join(f"round(max(m) FILTER (model = '{m}'), 6) AS {m}" for m in MODELS) + " FROM made GROUP BY ALL) w ON s.series_id = w.series_id AND s.year = w.year",
)
_ACF = "s AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY year) AS t, value - avg(value) OVER (PARTITION BY series_id) AS c, count(*) OVER (PARTITION BY series_id) AS n FROM daily), q AS (SELECT series_id, sum(c ^ 2) AS s FROM s GROUP BY ALL), acf AS (SELECT a.series_id, a.n, a.t - b.t AS lag, sum(a.c * b.c) / any_value(q.s) AS acf FROM s a JOIN s b ON a.series_id = b.series_id AND a.t - b.t BETWEEN 1 AND least(20, a.n - 1) JOIN q ON q.series_id = a.series_id GROUP BY ALL) --- "


def _acf(f: Facts) -> DataFrame:
    rows = f.daily.select("series_id", F.row_number().over(fc.Window.partitionBy("series_id").orderBy("year")).alias("t"), F.col("value").alias("e"))
    return fc.autocorrelation(rows)


add("F24_acf", lambda f: r6(_acf(f).select("series_id", "lag", "acf"), "acf"), _ACF + "SELECT series_id, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf FROM acf")
add("F24_pacf", lambda f: r6(fc.partial_autocorrelation(_acf(f)), "pacf"))
add("F24_residual_acf", lambda f: r6(fc.autocorrelation(fc.residuals(fc.fitted(fc.arrays(f.daily), "holt"))), "acf"))
_BOX = _ACF.replace(" --- ", ", ") + "lg AS (SELECT DISTINCT series_id, n, least(l, n - 1) AS lags FROM acf, (VALUES (5), (10), (15)) AS v(l)), bx AS (SELECT g.series_id, g.lags, g.n * (g.n + 2) * sum(a.acf ^ 2 / (g.n - a.lag)) AS st FROM lg g JOIN acf a ON a.series_id = g.series_id AND a.lag <= g.lags GROUP BY g.series_id, g.n, g.lags) --- "
add(
    "F25_ljung_box",
    lambda f: r6(fc.ljung_box(_acf(f)), "statistic", "p_value"),
    _BOX + "SELECT series_id, CAST(lags AS INTEGER) AS lags, round(st, 6) AS statistic, round(1 - least(1, list_sum(list_transform(range(0, 1000), lambda i: exp((lags / 2.0 + i) * ln(st / 2) - st / 2 - lgamma(lags / 2.0 + i + 1))))), 6) AS p_value FROM bx",
)
add("J7_holdout_join", lambda f: r6(fc.holdout(f.series, 0.3, ["naive"]).select("series_id", "me"), "me"), _HOLD + "e AS (SELECT series_id, arg_max(value, i) AS l FROM k WHERE i <= n - k AND k > 0 GROUP BY ALL) --- SELECT series_id, round(avg(l - value), 6) AS me FROM k JOIN e USING (series_id) WHERE i > n - k AND k > 0 GROUP BY ALL")
add("J8_full_join", lambda f: fc.observed_and_forecast(f.series, fc.naive(fc.arrays(f.series), H)).groupBy("series_id").agg(F.count("observed").alias("n_observed"), F.count("mean").alias("n_forecast")), _LAST + "SELECT series_id, count(value) AS n_observed, count(m) AS n_forecast FROM series FULL JOIN nv USING (series_id, year) GROUP BY ALL")

# ---- structural breaks


def _found(f: Facts) -> DataFrame:
    return breaks.chosen_breaks(f.daily)


def _breaks_sql(table: str = "daily", share: str = "0.15", most: int = breaks.MOST, line: str = "{a}h > 2", some: str = "n >= 5 AND h >= 2") -> str:
    """Table `found`: the best breaks of each series of a table, level by level; line: where a line is fitted, else a mean; some: which series are searched."""
    of_a, of_x = line.format(a="a."), line.format(a="")
    out = [
        f"s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY year) AS t, count(*) OVER (PARTITION BY series_id) AS n, floor(count(*) OVER (PARTITION BY series_id) * {share}) AS h FROM {table})",
        f"co AS (SELECT a.series_id, a.n, CASE WHEN {of_a} THEN 2 ELSE 1 END AS k, i.i AS i, j.j AS j, greatest(regr_syy(a.value, a.t) - CASE WHEN {of_a} THEN regr_sxy(a.value, a.t) ^ 2 / regr_sxx(a.value, a.t) ELSE 0 END, 0) AS rss FROM (SELECT DISTINCT series_id, n, h FROM s WHERE {some}) x, unnest(range(0, n)) AS i(i), unnest(range(i.i + CAST(greatest(CASE WHEN {of_x} THEN 3 ELSE 2 END, h) AS BIGINT), n + 1)) AS j(j), s a WHERE a.series_id = x.series_id AND a.t > i.i AND a.t <= j.j GROUP BY a.series_id, a.n, a.h, i.i, j.j)",
        "b0 AS (SELECT series_id, n, k, j, rss, CAST([] AS BIGINT[]) AS br FROM co WHERE i = 0)",
    ]
    for m in range(most):
        out.append(f"b{m + 1} AS (SELECT c.series_id, c.n, c.k, c.j, min(b.rss + c.rss) AS rss, arg_min(list_append(b.br, c.i), b.rss + c.rss) AS br FROM b{m} b JOIN co c ON b.series_id = c.series_id AND b.j = c.i GROUP BY ALL)")
    every = " UNION ALL ".join(f"SELECT * FROM b{m} WHERE j = n" for m in range(most + 1))
    out.append(f"found AS (SELECT *, n * (ln(greatest(rss, 1e-12) / n) + ln(2 * pi()) + 1) + ln(n) * ((k + 1) * (len(br) + 1)) AS bic FROM ({every}) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY bic, len(br)) = 1)")
    return ", ".join(out) + " --- "


add(
    "B1_breakpoints",
    lambda f: r3(_found(f).withColumn("breaks", F.array_join(F.col("breaks").cast("array<string>"), ",")), "rss", "bic"),
    _breaks_sql() + "SELECT series_id, CAST(len(br) AS INTEGER) AS n_breaks, array_to_string(br, ',') AS breaks, round(rss, 3) AS rss, round(bic, 3) AS bic, CASE k WHEN 2 THEN 'trend' ELSE 'mean' END AS model FROM found",
)
_SEG = "s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY year) AS t, count(*) OVER (PARTITION BY series_id) AS n FROM daily) --- SELECT a.series_id, any_value(a.n) AS n, CAST(i.i AS INTEGER) AS i, CAST(j.j AS INTEGER) AS j, round(greatest(regr_syy(a.value, a.t) - regr_sxy(a.value, a.t) ^ 2 / regr_sxx(a.value, a.t), 0), 4) AS rss FROM (SELECT DISTINCT series_id, n FROM s) x, unnest(range(0, n)) AS i(i), unnest(range(i.i + greatest(3, CAST(floor(n * 0.15) AS BIGINT)), n + 1)) AS j(j), s a WHERE a.series_id = x.series_id AND a.t > i.i AND a.t <= j.j AND x.n >= 5 GROUP BY a.series_id, i.i, j.j"
add("B1_segment_costs", lambda f: breaks.segment_costs(f.daily).withColumns({"i": F.col("i").cast("int"), "j": F.col("j").cast("int"), "rss": F.round("rss", 4) + 0.0}), _SEG)
_PARTS = ", sg AS (SELECT series_id, len(list_filter(br, lambda b: b < t)) + 1 AS segment, len(br) + 1 AS parts, year, value FROM s JOIN (SELECT series_id, br FROM found) USING (series_id)), seg AS (SELECT series_id, segment, min(year) AS first_year, max(year) AS last_year, count(*) AS length, avg(value) AS mean, regr_slope(value, year) AS slope, CASE WHEN segment < any_value(parts) THEN max(year) END AS break_year FROM sg GROUP BY series_id, segment) --- "
add(
    "B2_segments",
    lambda f: r6(breaks.segments(f.daily, _found(f)), "mean", "slope"),
    _breaks_sql().replace(" --- ", _PARTS) + "SELECT series_id, CAST(segment AS INTEGER) AS segment, first_year, last_year, length, round(mean, 6) AS mean, round(slope, 6) AS slope, break_year FROM seg",
)
add(
    "B3_breaks_on_seams",
    lambda f: breaks.on_seams(breaks.segments(f.series, breaks.breakpoints(f.series, 0.4, 2, False)), f.seams),
    _breaks_sql("series", "0.4", 2, "false", "n >= 5").replace(" --- ", _PARTS) + "SELECT series_id, break_year, seam FROM seg JOIN seams ON break_year IN (seam - 1, seam)",
)
add("B4_break_class", lambda f: _found(f).select("series_id", breaks.break_class(F.col("n_breaks")).alias("class"), "model"), _breaks_sql() + "SELECT series_id, CASE len(br) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS class, CASE k WHEN 2 THEN 'trend' ELSE 'mean' END AS model FROM found")
