"""Reading the tables and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once; texts are long, and Spark's default would hold tens of MB on both sides.
BATCH_ROWS = "1000"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has its own size."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir that all executors see; it goes when the session's JVM ends.

    A folder of this machine is taken only where the setting is missing and the master local,
    as in tests.
    """
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        home = tempfile.mkdtemp(prefix="saved-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return str(path.toString())


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows from Parquet files in a shared folder, so that a lost executor costs no recomputation.

    Unlike a checkpoint, the files tell the planner how large they are.
    """
    path = path or shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with this share of the rows, or more, is dealt in parts of about that share each, if
#: it has as many rows as one task should not take.
SHARE, LEAST = 1000, 50_000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], n: str = "n", at_most: int | None = None) -> DataFrame:
    """rows joined with table, which has each key once and the number n of its rows, however many rows one key has.

    A key with a thousandth of the rows or more is dealt, by the columns `by`, in as many parts
    as it has thousandths, and its row of the table goes to each part. At most SHARE keys can
    be so common, so that many keys are broadcast and twice as many rows of the table copied,
    whatever the input. The table is read more than once: save it where that is dear. at_most:
    a number of rows that no key exceeds, where one is known.
    """
    if at_most is not None and at_most < LEAST:
        return rows.join(table, keys)
    r = table.agg(F.sum(n).alias("total"), F.max(n).alias("most")).first()
    total = r["total"] or 0
    if (r["most"] or 0) < max(LEAST, total / SHARE):
        return rows.join(table, keys)
    common = (F.col(n) * SHARE >= total) & (F.col(n) >= LEAST)
    hot = table.where(common).withColumn("_parts", F.ceil(F.col(n) * SHARE / F.lit(float(total))).cast("int"))
    named = F.broadcast(hot.select(*keys, "_parts"))
    dealt = rows.join(named, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = hot.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copies.unionByName(table.where(~common).withColumn("_part", F.lit(0))), [*keys, "_part"]).drop("_part")
