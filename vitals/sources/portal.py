"""Wide CSV files of a statistics portal to long facts, a folder at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitals.functions.labels import folded_band, local_number, no_roll_ups, real_areas, sex_code


def read_portal(spark: SparkSession, path: str, source: str) -> DataFrame:
    """year, area, area_code, sex, cause, age_band, deaths, source_indicator.

    Files are latin-1 with semicolons: a row of years (each stands for the columns up to the
    next), a row of "code: area", then data rows of cause, sex, age band and values, where an
    empty cause or sex repeats the one above; what follows the first row without an age band
    after the data is the footer. Each file is one row of text; all else is DataFrame work.
    """
    lines = (
        spark.read.format("binaryFile").load(path)
        .select(F.col("path").alias("file"), F.decode("content", "ISO-8859-1").alias("text"))
        .select("file", F.posexplode(F.split("text", "\r?\n")).alias("line", "text"))
        .select("file", "line", F.transform(F.split("text", ";"), lambda c: F.trim(F.regexp_replace(c, '^"|"$', ""))).alias("cells"))
    )
    lines = lines.withColumn("n_areas", F.size(F.filter("cells", lambda c: c.rlike(r"^\w+: ."))))
    of_file = Window.partitionBy("file")
    lines = lines.withColumn("head", F.min(F.when(F.col("n_areas") > 0, F.col("line"))).over(of_file))
    up_to = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)

    cells = lines.where("line IN (head, head - 1)").select("file", (F.col("line") == F.col("head")).alias("areas"), F.posexplode("cells").alias("col", "cell"))
    wide = cells.groupBy("file", "col").agg(F.max(F.when(F.col("areas"), F.col("cell"))).alias("place"), F.max(F.when(~F.col("areas"), F.col("cell"))).alias("y"))
    across = Window.partitionBy("file").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    columns = wide.withColumn("year", F.last(F.regexp_extract("y", r"(\d{4})", 1).try_cast("int"), ignorenulls=True).over(across))
    columns = columns.where(F.col("place").rlike(r"^\w+: .")).select("file", "col", "year", F.regexp_extract("place", r"^(\w+): (.+)$", 1).alias("area_code"), F.regexp_extract("place", r"^(\w+): (.+)$", 2).alias("area"))

    data = lines.where("line > head")
    band = F.when(F.size("cells") > 3, F.nullif(F.col("cells")[2], F.lit("")))
    data = data.withColumns({"age_band": band, "cut": F.max(F.when(band.isNull(), 1).otherwise(0)).over(up_to)}).where("cut = 0")
    filled = lambda i: F.last(F.nullif(F.col("cells")[i], F.lit("")), ignorenulls=True).over(up_to)
    data = data.withColumns({"cause": filled(0), "sex_raw": filled(1)})
    long = data.select("file", "cause", "sex_raw", "age_band", F.posexplode("cells").alias("col", "cell")).join(columns, ["file", "col"])
    facts = long.select("year", "area", "area_code", sex_code(F.lit(None).cast("string"), F.col("sex_raw")).alias("sex"), "cause", folded_band(F.col("age_band")).alias("age_band"), local_number(F.col("cell")).alias("deaths")).where("deaths IS NOT NULL")
    summed = no_roll_ups(real_areas(facts)).groupBy("year", "area", "area_code", "sex", "cause", "age_band").agg(F.sum("deaths").alias("deaths"))
    return summed.withColumn("source_indicator", F.lit(source))
