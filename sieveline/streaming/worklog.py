"""The work-log operators on streams (an extension: the batch forms are in operators.worklog)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def refusals(stream: DataFrame, time: str, bad: str, window: str = "10 minutes", slide: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Bad events per sliding window; a window is given out once the watermark has passed it."""
    rows = stream.filter(F.col("status") == bad).withWatermark(time, late)
    return rows.groupBy(F.window(time, window, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Each job's first event within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upserts(stream: DataFrame, key: str, time: str, path: str) -> DataStreamWriter:
    """Each batch's latest row per key as one more version under ``path``; a batch that is run again replaces its own version."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), time).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write)
