"""Incremental daily summaries of station readings.

They are the incremental forms of the batch library's daily sums and of its idempotent upsert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def station_days(readings: DataFrame, late: str = "2 days") -> DataFrame:
    """Per station and day: readings, their sum, least and largest, of a stream with columns station, ts and dtw. Readings
    later than the watermark are left out, so the state holds only open days."""
    days = readings.withWatermark("ts", late).groupBy("station", F.window("ts", "1 day").alias("w"))
    return days.agg(F.count("dtw").alias("n"), F.sum("dtw").alias("total"), F.min("dtw").alias("least"), F.max("dtw").alias("most")).select("station", F.to_date("w.start").alias("day"), "n", "total", "least", "most")


def write_days(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch into its own partition, overwriting it if the batch runs again: every row once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return days.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
