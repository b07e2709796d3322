"""Scalar rules as Column expressions: recodes, numbers in local spelling, labels, rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitals.schema import PSEUDO_AREAS, ROLL_UP_BANDS


def sex_code(code: Column, label: Column) -> Column:
    """HM, H or M by code, else by label, else the label as it is."""
    by_code = F.create_map(*(F.lit(x) for x in ("T", "HM", "1", "H", "2", "M")))
    by_label = F.create_map(*(F.lit(x) for x in ("MF", "HM", "Total", "HM", "HM", "HM", "Homens", "H", "H", "H", "Mulheres", "M", "M", "M")))
    return F.coalesce(F.try_element_at(by_code, code), F.try_element_at(by_label, label), label)


def folded_band(band: Column) -> Column:
    """The two youngest published bands as one."""
    return F.when(band.isin("Menos de 1 ano", "1 - 4 anos"), "0 - 4 anos").otherwise(band)


def no_roll_ups(df: DataFrame, band: str = "age_band") -> DataFrame:
    """Without rows that sum other bands."""
    return df.where(~F.col(band).isin(ROLL_UP_BANDS))


def real_areas(df: DataFrame, area: str = "area") -> DataFrame:
    """Without rows of no area."""
    return df.where(~F.col(area).isin(PSEUDO_AREAS))


def local_number(text: Column) -> Column:
    """A number with blanks between thousands and a decimal comma; marks of absence are null."""
    bare = F.regexp_replace(text, r"[\s ]", "")
    return F.when(bare.isin("", "-", "--", "x", "X", "...", "–", "—"), None).otherwise(F.replace(bare, F.lit(","), F.lit(".")).try_cast("double"))


def plain_label(text: Column) -> Column:
    """Lower case, no punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def token(text: Column) -> Column:
    """A name for files and partitions: ASCII letters and digits, runs of others as one _."""
    ascii_ = F.translate(F.lower(text), "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    name = F.regexp_replace(F.regexp_replace(ascii_, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name.isNull() | (name == ""), "unknown").otherwise(name)


def band_midpoint(band: Column) -> Column:
    """Middle of a band in years; null for an open band."""
    low, high = F.regexp_extract(band, r"^\s*(\d+)\s*-\s*(\d+)", 1), F.regexp_extract(band, r"^\s*(\d+)\s*-\s*(\d+)", 2)
    return (
        F.when(band.startswith("0 - 4"), 2.5)
        .when(band.startswith("<") | band.startswith("Menos de 1"), 0.5)
        .when(band.startswith("1 - 4"), 3.0)
        .when(low != "", (low.try_cast("double") + high.try_cast("double")) / 2)
    )


def period(start: Column, end: Column) -> Column:
    """y or y1-y2."""
    return F.when(start == end, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("-"), end.cast("string")))


def rounded_metric(metric: Column, value: Column) -> Column:
    """Counts whole, proportions and indirect measures to one place, else two; halves to even."""
    return (
        F.when(metric.isin("deaths", "ypll", "infant_deaths"), F.bround(value, 0))
        .when(metric.isin("proportional", "smr", "isr"), F.bround(value, 1))
        .otherwise(F.bround(value, 2))
    )


def interval_text(value: Column, lower: Column, upper: Column, places: int = 2) -> Column:
    """v (l; u), the value alone without limits, N/D without a value."""
    show = lambda c: F.format_string(f"%.{places}f", c)
    return F.when(value.isNull() | F.isnan(value), "N/D").when(lower.isNull() | upper.isNull(), show(value)).otherwise(F.concat(show(value), F.lit(" ("), show(lower), F.lit("; "), show(upper), F.lit(")")))


def source_list(source: Column) -> Column:
    """An aggregate: distinct non-empty sources, sorted, or N/D."""
    some = F.sort_array(F.collect_set(F.when(source != "", source)))
    return F.when(F.size(some) == 0, "N/D").otherwise(F.array_join(some, ", "))


def list_with_overflow(value: Column, most: int) -> Column:
    """An aggregate: the first values, and how many more there are."""
    some = F.sort_array(F.collect_set(value))
    shown = F.array_join(F.slice(some, 1, most), ", ")
    return F.when(F.size(some) > most, F.concat(shown, F.lit(" +"), (F.size(some) - most).cast("string"))).otherwise(shown)


def year_span(year: Column) -> Column:
    """An aggregate: min - max (n)."""
    return F.concat(F.min(year).cast("string"), F.lit(" - "), F.max(year).cast("string"), F.lit(" ("), F.count_distinct(year).cast("string"), F.lit(")"))


def year_selection(year: Column) -> Column:
    """An aggregate: a - b for years without a gap, else the list."""
    whole = F.max(year) - F.min(year) + 1 == F.count_distinct(year)
    listed = F.array_join(F.sort_array(F.collect_set(year)).cast("array<string>"), ", ")
    return F.when(whole, F.concat(F.min(year).cast("string"), F.lit(" - "), F.max(year).cast("string"))).otherwise(listed)


def selection_label(areas: Column, custom: Column) -> Column:
    """The custom label, the one area, or how many places are summed."""
    return F.when(custom.isNotNull() & (custom != ""), custom).when(F.size(areas) == 1, areas[0]).otherwise(F.concat(F.lit("sum of "), F.size(areas).cast("string"), F.lit(" places")))


def matched_categories(requested: DataFrame, categories: DataFrame) -> DataFrame:
    """(requested, code) where the request is a category's label, plain label, code or id."""
    keys = categories.select("code", F.explode(F.array_distinct(F.array("label", plain_label(F.col("label")), "code", "id"))).alias("key"))
    asked = requested.select("requested", F.explode(F.array_distinct(F.array("requested", plain_label(F.col("requested"))))).alias("key"))
    return asked.join(keys, "key").select("requested", "code").distinct()


def unmatched_categories(requested: DataFrame, categories: DataFrame) -> DataFrame:
    """Requests that no category answers; the caller decides whether that is an error."""
    return requested.join(matched_categories(requested, categories), "requested", "left_anti")


def common_categories(categories: DataFrame, preferred: str) -> DataFrame:
    """Codes that every indicator has, labelled by the preferred one."""
    held = categories.groupBy("code").agg(F.count_distinct("indicator").alias("n"), F.max(F.when(F.col("indicator") == preferred, F.col("label"))).alias("preferred"), F.min("label").alias("any"))
    every = categories.agg(F.count_distinct("indicator").alias("every"))
    return held.join(F.broadcast(every), F.col("n") == F.col("every")).select("code", F.coalesce("preferred", "any").alias("label"))


def pinned(rows: DataFrame, pins: dict[str, str], keys: list[str], value: str) -> DataFrame:
    """Rows of one category in every pinned dimension, summed by the rest."""
    for dimension, category in pins.items():
        rows = rows.where(F.col(dimension) == category)
    return rows.groupBy(*keys).agg(F.sum(value).alias(value))


def catalogue(rows: DataFrame, dimension: str) -> DataFrame:
    """Categories of a dimension by indicator, with the years, order and level of each.

    Order and level come from the columns `<dimension>_order` and `<dimension>_level`, as
    numbers; without an order column categories are counted by name within the indicator, and
    without a level column the level is null.
    """
    order, level = f"{dimension}_order", f"{dimension}_level"
    given = F.min(F.col(order).try_cast("double")) if order in rows.columns else F.lit(None).cast("double")
    depth = F.min(F.col(level).try_cast("double")) if level in rows.columns else F.lit(None).cast("double")
    out = rows.groupBy("source_indicator", F.col(dimension).alias("category")).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_distinct("year").alias("n_years"), given.alias("order"), depth.alias("level"))
    if order in rows.columns:
        return out
    return out.withColumn("order", F.row_number().over(Window.partitionBy("source_indicator").orderBy("category")).cast("double"))
