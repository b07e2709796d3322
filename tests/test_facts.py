"""Scans, the portal's files, merging, places, streaming ingest."""

import pytest
from pyspark.sql import functions as F

from vitals import demo
from vitals.functions import labels as L
from vitals.operators import geo, merge, quality
from vitals.sources import facts as S
from vitals.sources.portal import read_portal


def test_priority_merge_fills_and_breaks_ties(spark):
    rows = [(1, "a", 5.0), (1, "b", 7.0), (2, "a", 3.0), (3, "c", 1.0), (3, "b", 2.0)]
    f = spark.createDataFrame(rows, "cell int, source_indicator string, v double")
    p = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "source_indicator string, priority int")
    got = {r["cell"]: (r["v"], r["source_indicator"]) for r in merge.by_priority(f, p, ["cell"], "v").collect()}
    assert got == {1: (7, "b"), 2: (3, "a"), 3: (2, "b")}


def test_seams(spark):
    from vitals.schema import seams

    rows = [(k, y) for k, (a, b) in enumerate([(2019, 2022), (2010, 2018), (1991, 2024), (2015, 2019)]) for y in (a, b)]
    got = merge.seams_crossed(spark.createDataFrame(rows, "s int, year int"), seams(spark), ["s"]).collect()
    assert sorted((r["s"], r["seam"]) for r in got) == [(0, 2021), (1, 2014), (2, 2014), (2, 2021)]


def test_local_numbers(spark):
    given = ["1 234,5", "12 000", "-", "x", "...", "", "7", "abc", None]
    got = [r["v"] for r in spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, t string").orderBy("k").select(L.local_number(F.col("t")).alias("v")).collect()]
    assert got == [1234.5, 12000, None, None, None, None, 7, None, None]


def test_midpoints(spark):
    given = ["0 - 4 anos", "< 1 ano", "1 - 4 anos", "30 - 34 anos", "85 e mais anos"]
    got = [r["m"] for r in spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, b string").orderBy("k").select(L.band_midpoint(F.col("b")).alias("m")).collect()]
    assert got == [2.5, 0.5, 3, 32, None]


def test_portal_files(spark, tmp_path):
    text = '"Óbitos";;;\n;;;2020;;2019\n"Causa";"Sexo";"Idade";"11: Braga";"12: Beja";"11: Braga"\nGripe;MF;Menos de 1 ano;1 000;2;x\n;;1 - 4 anos;1;-;3\n;Homens;Total;5;5;5\nnota;\n'
    (tmp_path / "a.csv").write_bytes(text.encode("latin-1"))
    got = {(r["year"], r["area"], r["sex"], r["cause"], r["age_band"]): r["deaths"] for r in read_portal(spark, str(tmp_path), "S").collect()}
    assert got == {(2020, "Braga", "HM", "Gripe", "0 - 4 anos"): 1001, (2020, "Beja", "HM", "Gripe", "0 - 4 anos"): 2, (2019, "Braga", "HM", "Gripe", "0 - 4 anos"): 3}


def test_coverage_and_overlap(spark):
    m = spark.createDataFrame([("A", "Alentejo", "Beja"), ("A", "Alentejo", "Serpa"), ("A", "Sul", "Beja"), ("A", "Sul", "Serpa"), ("A", "Sul", "Faro")], "vintage string, region string, municipality string")
    c = {r["region"]: r for r in geo.coverage(m, spark.createDataFrame([("Beja",), ("Faro",)], "area string")).collect()}
    assert (c["Alentejo"]["expected"], c["Alentejo"]["found"], c["Alentejo"]["missing"]) == (2, 1, "Serpa")
    s = spark.createDataFrame([("x", a) for a in ("Sul", "Alentejo", "Beja", "Portugal")], "label string, area string")
    got = {(r["outer"], r["inner"], r["kind"]) for r in geo.overlaps(s, m, "Portugal").collect()}
    assert ("Sul", "Alentejo", "absorbed") in got and ("Alentejo", "Beja", "absorbed") in got and ("Portugal", "Sul", "national") in got
    assert ("Alentejo", "Sul", "absorbed") not in got


def test_missing_year_fails(spark):
    df = spark.createDataFrame([(2000, "A", 1.0)], "year int, area string, pop double")
    assert S.scan_population_chunks(df, [2000], ["A"]).count() == 1
    with pytest.raises(Exception, match="no population"):
        S.scan_population_chunks(df, [2000, 2001], ["A"]).collect()
    with pytest.raises(ValueError, match="missing columns: sex"):
        quality.require_columns(df, ["year", "sex"])


def test_streamed_slices_replace(spark, tmp_path):
    from vitals.schema import DEATHS
    from vitals.streaming.ingest import follow

    new = lambda rows, k: spark.createDataFrame([(y, a, "H", "c", "0 - 4 anos", float(d), "S") for y, a, d in rows], DEATHS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k, rows in enumerate([[(2000, "A", 1), (2001, "A", 2)], [(2000, "A", 5), (2000, "B", 3)]]):
        new(rows, k)
        follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["year"], r["area"]): r["deaths"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(2000, "A"): 5, (2001, "A"): 2, (2000, "B"): 3}


def test_csv_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(2000, "Évora", 1.0)], "year int, area string, pop double")
    S.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["area"] == "Évora"
    S.write_facts(df, str(tmp_path / "f"))
    plan = spark.read.parquet(str(tmp_path / "f")).where("year = 2000")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_the_shorter_of_two_names_wins_a_tie(spark):
    f = spark.createDataFrame([(1, "S10", 5.0), (1, "S1", 7.0)], "cell int, source_indicator string, v double")
    p = spark.createDataFrame([("S1", 2), ("S10", 2)], "source_indicator string, priority int")
    assert merge.by_priority(f, p, ["cell"], "v").first()["source_indicator"] == "S1"


def test_counts_cross_no_seam(spark):
    from vitals.schema import seams

    s = spark.createDataFrame([(m, y) for m in ("deaths", "crude") for y in (2019, 2022)], "metric string, year int")
    assert [r["metric"] for r in merge.seams_crossed(s, seams(spark), ["metric"], metric="metric").collect()] == ["crude"]


def test_areas_outside_the_membership_pass_through(spark):
    m = spark.createDataFrame([("R", "a"), ("R", "b"), ("Q", "b")], "region string, municipality string")
    f = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("Nation", 9.0), ("R", 50.0)], "area string, v double")
    got = lambda **k: {r["region"]: r["v"] for r in geo.rolled_up(f, m, [], "v", **k).collect()}
    chosen = spark.createDataFrame([("R",), ("b",), ("Nation",)], "area string")
    assert got() == {"R": 3, "Q": 2, "Nation": 9}
    assert got(chosen=chosen) == {"R": 3, "b": 2, "Nation": 9}
    assert got(chosen=chosen, mode="original") == {"R": 50, "b": 2, "Nation": 9}


def test_year_ranges_join_by_equality(spark):
    f = spark.createDataFrame([("a", y, 1.0) for y in range(2000, 2006)] + [("b", 2001, 2.0), ("c", 2001, 3.0)], "source_indicator string, year int, v double")
    r = spark.createDataFrame([("a", 2000, 2002), ("a", 2002, 2003), ("b", 2002, 2001), ("c", 2001, 2001)], "source_indicator string, first int, last int")
    got = merge.by_year_range(f, r)
    assert sorted((x["source_indicator"], x["year"]) for x in got.collect()) == [("a", 2000), ("a", 2001), ("a", 2002), ("a", 2002), ("a", 2003), ("c", 2001)]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and got.columns == f.columns


def test_areas_outside_a_vintage_pass_through_it(spark):
    m = spark.createDataFrame([("A", "R", "a"), ("A", "R", "b"), ("B", "Q", "a")], "vintage string, region string, municipality string")
    f = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("Nation", 9.0), ("R", 50.0)], "area string, v double")
    got = {(r["vintage"], r["region"]): r["v"] for r in geo.rolled_up_by_vintage(f, m, [], "v").collect()}
    assert got == {("A", "R"): 3, ("A", "Nation"): 9, ("B", "Q"): 1, ("B", "b"): 2, ("B", "Nation"): 9, ("B", "R"): 50}


def test_a_label_without_a_name_is_an_error(spark):
    rows, names = spark.createDataFrame([("1", "x"), ("?", "gone")], "code string, label string"), spark.createDataFrame([("1", "One")], "code string, name string")
    assert sorted(map(str, (r["canonical"] for r in geo.canonical(rows, names, strict=False).collect()))) == ["None", "One"]
    with pytest.raises(Exception, match="no canonical name for . gone"):
        geo.canonical(rows, names).collect()


def test_year_filters_prune_partitions(spark, tmp_path):
    from vitals.schema import DEATHS

    df = spark.createDataFrame([(y, "A", "H", "c", "0 - 4 anos", 1.0, "S") for y in (2000, 2001)], DEATHS)
    S.write_facts(df, str(tmp_path / "d"))
    scan = S.scan_deaths(S.read_facts(spark, str(tmp_path / "d"), "deaths"), [2000], ["A"], ["c"])
    plan = scan._jdf.queryExecution().toString()
    assert "PartitionFilters: [year" in plan.replace("isnotnull(year", "[year") or "year#" in plan.split("PartitionFilters:")[1][:80]
    assert "EqualTo(area,A)" in plan or "In(area" in plan
    assert scan.first()["deaths"] == 1


def test_joins_of_line_items_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(demo, "LINES", 500)
    f = demo.Facts(spark, "/root/testdata/sf0.001")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert f.base.rdd.getNumPartitions() == f.parts == -(-f.table("lineitem").count() // 500) > 4
        # orders are told apart where they were joined, in as many parts
        distinct = f.base.select("year", "area", "o_orderkey").distinct()
        assert distinct.rdd.getNumPartitions() == f.parts
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert f.births.agg(F.sum("births")).first()[0] == distinct.count()


def test_dealt_joins_are_not_put_together_again(spark, monkeypatch):
    monkeypatch.setattr(demo, "LINES", 3000)
    f = demo.Facts(spark, "/root/testdata/sf0.001")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # fewer parts than shuffle partitions, which adaptive execution would put together
        assert 1 < f.parts < 4
        assert f.base.rdd.getNumPartitions() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
