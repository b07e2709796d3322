"""Slices of deaths that arrive as files, put into the stored facts as they come."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitals.schema import DEATHS
from vitals.sources.facts import upserted


def follow(spark: SparkSession, incoming: str, stored: str, checkpoint: str) -> StreamingQuery:
    """Each batch of new files replaces its (year, cause, area) slices in `stored`; ends when all files are taken.

    Only the years that a batch touches are written: to a folder of their own first, then over
    their partitions, so a batch that is repeated after a failure gives the same rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        years = [r["year"] for r in batch.select("year").distinct().collect()]  # a few years
        if not years:
            return
        try:
            old = session.read.schema(DEATHS).parquet(stored).where(F.col("year").isin(years))
        except AnalysisException as e:  # the first batch finds nothing
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            old = session.createDataFrame([], DEATHS)
        staged = f"{stored}_staged/{number}"
        upserted(old, batch).write.mode("overwrite").parquet(staged)
        new = session.read.schema(DEATHS).parquet(staged)
        new.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(stored)

    rows = spark.readStream.schema(DEATHS).parquet(incoming)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
