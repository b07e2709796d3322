"""Places: membership, roll-up, overlap, coverage, building the lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ["nuts1", "nuts2", "nuts3"]


def members(lookup: DataFrame) -> DataFrame:
    """(vintage, region, municipality) over all levels, each once."""
    return lookup.select("vintage", F.explode(F.array(*LEVELS)).alias("region"), "municipality").where("region IS NOT NULL").distinct()


MODES = ("municipal", "original")


def resolved(areas: DataFrame, membership: DataFrame, mode: str = "municipal") -> DataFrame:
    """(region, area): what each chosen area stands for (G1). areas: area.

    A region stands for its municipalities, any other area for itself; in mode `original`
    (and in one that isn't known) every area does.
    """
    chosen = areas.select("area").distinct()
    if mode != "municipal":
        return chosen.select(F.col("area").alias("region"), "area")
    parts = membership.select("region", "municipality").distinct()
    found = chosen.join(parts, F.col("area") == F.col("region"), "left")
    return found.select(F.col("area").alias("region"), F.coalesce("municipality", "area").alias("area"))


def rolled_up(facts: DataFrame, membership: DataFrame, keys: list[str], value: str, area: str = "area", chosen: DataFrame | None = None, mode: str = "municipal") -> DataFrame:
    """Facts summed over the municipalities of each region (G1); membership: region, municipality.

    chosen (area): the areas wanted, each as `resolved` has it; name the region here where one
    alone is wanted. Without, every region, and each area that the membership doesn't know as
    it is: a membership cut down to some regions passes all other areas on.
    """
    if chosen is not None:
        m = resolved(chosen, membership, mode).withColumnRenamed("area", area)
        return facts.join(m, area).groupBy("region", *keys).agg(F.sum(value).alias(value))
    parts = membership.select(F.col("municipality").alias(area), "region").distinct()
    known = parts.select(area).unionByName(parts.select(F.col("region").alias(area))).distinct()
    rest = facts.join(known, area, "left_anti").withColumn("region", F.col(area))
    rows = facts.join(parts, area).select("region", *keys, value).unionByName(rest.select("region", *keys, value))
    return rows.groupBy("region", *keys).agg(F.sum(value).alias(value))


def combined(facts: DataFrame, selections: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Facts summed over each selection of areas (G3); selections: label, area."""
    return facts.join(selections.select("label", "area").distinct(), "area").groupBy("label", *keys).agg(F.sum(value).alias(value))


def rolled_up_by_vintage(facts: DataFrame, membership: DataFrame, keys: list[str], value: str, vintages: list[str] | None = None) -> DataFrame:
    """The same facts under each vintage's regions (G4); as in rolled_up, areas that a vintage doesn't know pass through it.

    vintages: those wanted, else all of the membership, which has a handful.
    """
    if vintages is None:
        vintages = sorted(r["vintage"] for r in membership.select("vintage").distinct().collect())
    parts = membership.select("vintage", F.col("municipality").alias("area"), "region").where(F.col("vintage").isin(vintages)).distinct()
    known = parts.select("vintage", "area").unionByName(parts.select("vintage", F.col("region").alias("area"))).distinct()
    every = facts.select("area").distinct().select("area", F.explode(F.array(*map(F.lit, vintages))).alias("vintage"))
    rest = every.join(known, ["vintage", "area"], "left_anti").select("vintage", "area", F.col("area").alias("region"))
    return facts.join(parts.unionByName(rest), "area").groupBy("vintage", "region", *keys).agg(F.sum(value).alias(value))


def coverage(membership: DataFrame, areas: DataFrame) -> DataFrame:
    """Members that a region should have and has (G5); areas: area."""
    have = areas.select(F.col("area").alias("municipality"), F.lit(True).alias("_h")).distinct()
    j = membership.join(have, "municipality", "left")
    missing = F.array_join(F.sort_array(F.collect_list(F.when(F.col("_h").isNull(), F.col("municipality")))), ", ")
    return j.groupBy("vintage", "region").agg(F.count(F.lit(1)).alias("expected"), F.count("_h").alias("found"), missing.alias("missing")).withColumn("complete", F.col("expected") == F.col("found"))


def overlaps(selections: DataFrame, membership: DataFrame, national: str) -> DataFrame:
    """Pairs of a selection that count people twice (G6): the nation with anything, or a region with a part of it.

    selections: label, area. A pair is found through the municipalities that both hold, not
    by comparing every area with every other.
    """
    expanded = selections.distinct().join(membership.select(F.col("region").alias("area"), F.col("municipality").alias("m")).distinct(), "area", "left").select("label", "area", F.coalesce("m", "area").alias("m"))
    sizes = expanded.groupBy("label", "area").agg(F.count(F.lit(1)).alias("n"))
    a = expanded.select("label", "m", F.col("area").alias("outer"))
    b = expanded.select("label", "m", F.col("area").alias("inner"))
    common = a.join(b, ["label", "m"]).where("outer <> inner").groupBy("label", "outer", "inner").agg(F.count(F.lit(1)).alias("common"))
    small = common.join(sizes.withColumnRenamed("area", "inner"), ["label", "inner"]).where("common = n").select("label", "outer", "inner", F.lit("absorbed").alias("kind"))
    nation = selections.where(F.col("area") == national).select("label", F.col("area").alias("outer")).distinct()
    return small.unionByName(nation.join(selections.where(F.col("area") != national).distinct(), "label").select("label", "outer", F.col("area").alias("inner"), F.lit("national").alias("kind"))).distinct()


def unknown_regions(asked: DataFrame, membership: DataFrame, vintage: str) -> DataFrame:
    """Asked labels that only another vintage knows (G7); asked: area."""
    known = membership.select(F.col("region").alias("area"), "vintage").distinct()
    return asked.join(known.where(F.col("vintage") != vintage), "area", "left_semi").join(known.where(F.col("vintage") == vintage), "area", "left_anti")


def reconciled(selected: DataFrame, choices: DataFrame) -> DataFrame:
    """(area, status): which selected areas the choices still hold."""
    have = choices.select("area", F.lit(True).alias("_h")).distinct()
    return selected.distinct().join(have, "area", "left").select("area", F.when(F.col("_h"), "kept").otherwise("dropped").alias("status"))


def vocabulary(lookup: DataFrame, national: str) -> DataFrame:
    """Areas in order (G9): the nation, regions of the two upper levels by lowest municipality code, municipalities by name."""
    nation = lookup.select("vintage").distinct().select("vintage", F.lit(national).alias("area"), F.lit(0).alias("kind"), F.lit("").alias("key"))
    upper = lookup.select("vintage", "municipality_code", F.posexplode(F.array("nuts1", "nuts2")).alias("level", "area"))
    regions = upper.groupBy("vintage", "area").agg(F.min("level").alias("level"), F.min("municipality_code").alias("key")).select("vintage", "area", (F.col("level") + 1).alias("kind"), "key")
    towns = lookup.select("vintage", F.col("municipality").alias("area"), F.lit(3).alias("kind"), F.col("municipality").alias("key"))
    return nation.unionByName(regions).unionByName(towns)


def definition_breaks(selected: DataFrame, breaks: DataFrame) -> DataFrame:
    """Selected regions with years on both sides of the year their definition changed."""
    spans = selected.groupBy("area").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return spans.join(F.broadcast(breaks), "area").where("a < break_year AND b >= break_year").select("area", "break_year")


def parents(towns: DataFrame, regions: DataFrame) -> DataFrame:
    """The region of each level with the longest code that begins a town's code.

    towns: code, label; regions: level, code, label. Prefixes of the town codes are looked
    up, so nothing is compared with everything.
    """
    prefix = towns.select("code", "label", F.explode(F.sequence(F.lit(1), F.length("code"))).alias("n"))
    prefix = prefix.withColumn("prefix", F.expr("substring(code, 1, n)"))
    r = F.broadcast(regions.select("level", F.col("code").alias("prefix"), F.col("label").alias("region")))
    return prefix.join(r, "prefix").groupBy("code", "label", "level").agg(F.max_by("region", "n").alias("region"))


def canonical(rows: DataFrame, names: DataFrame, strict: bool = True) -> DataFrame:
    """Labels by code, else by a name that is unique on both sides (G12). rows: code, label; names: code, name.

    A label that neither finds is an error when it is read; null if not strict.
    """
    by_code = names.select("code", F.col("name").alias("_by_code"))
    single = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("name").alias("label"), F.col("name").alias("_by_name"))
    once = rows.select("label", "code").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("label")
    found = rows.join(by_code, "code", "left").join(single.join(once, "label", "left_semi"), "label", "left").select("code", "label", F.coalesce("_by_code", "_by_name").alias("canonical"))
    if not strict:
        return found
    lost = F.raise_error(F.concat(F.lit("no canonical name for "), F.coalesce("code", F.lit("?")), F.lit(" "), F.coalesce("label", F.lit("?")))).cast("string")
    return found.withColumn("canonical", F.when(F.col("canonical").isNull(), lost).otherwise(F.col("canonical")))


def ambiguous_labels(names: DataFrame) -> DataFrame:
    """Labels that several codes share (G13). names: code, label."""
    n = names.select("code", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n_codes"), F.array_join(F.sort_array(F.collect_list("code")), ", ").alias("codes"))
    return n.where("n_codes > 1")


def repaired(facts: DataFrame, repairs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Facts in which ambiguous labels give way to rows resolved by code.

    repairs: stored_label, label, year_min, year_max. A stored label that is itself an output
    keeps its rows. Facts and resolved rows have the same columns.
    """
    outputs = repairs.select(F.col("label").alias("stored_label")).distinct()
    gone = repairs.join(outputs, "stored_label", "left_anti").select(F.col("stored_label").alias("area"), "year_min", "year_max").distinct()
    kept = facts.join(gone, (facts["area"] == gone["area"]) & facts["year"].between(gone["year_min"], gone["year_max"]), "left_anti")
    wanted = repairs.select(F.col("label").alias("area"), "year_min", "year_max").distinct()
    new = resolved.join(wanted, (resolved["area"] == wanted["area"]) & resolved["year"].between(wanted["year_min"], wanted["year_max"]), "left_semi")
    return kept.unionByName(new)


def crosswalk(lookup: DataFrame, old: str, new: str, level: str = "nuts2") -> DataFrame:
    """Municipalities that moved between regions from one vintage to another."""
    a = lookup.where(F.col("vintage") == old).select("municipality", F.col(level).alias("old_region"))
    b = lookup.where(F.col("vintage") == new).select("municipality", F.col(level).alias("new_region"))
    return a.join(b, "municipality").where("old_region <> new_region").groupBy("old_region", "new_region").agg(F.count(F.lit(1)).alias("n"))


def closure(regions: DataFrame, nation: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums of the parts beside the stored whole."""
    parts = regions.groupBy(*keys).agg(F.sum(value).alias("parts"))
    return parts.join(nation.select(*keys, F.col(value).alias("whole")), keys).withColumn("difference", F.col("parts") - F.col("whole"))
