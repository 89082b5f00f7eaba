"""The same scans and sanitizers on streams: both are stateless, so a stream is a plan like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilwright.operators.detect import detect
from veilwright.operators.sanitize import sanitize


def scan_stream(frame: DataFrame, text: str = "text", regions="ALL", rules=()) -> DataFrame:
    """Adds the detections of each text."""
    return frame.withColumn("detections", detect(F.col(text), regions, rules=rules))


def clean_stream(frame: DataFrame, text: str = "text", mode: str = "mask", salt: str | None = None, regions="ALL") -> DataFrame:
    """Replaces the text by the sanitized one."""
    return frame.withColumn(text, sanitize(F.col(text), detect(F.col(text), regions), mode, salt))


def write_totals(frame: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each micro-batch's count by type, with the batch's number, to a Parquet folder; a batch done twice stands once."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.select(F.explode("detections").alias("d")).groupBy(F.col("d.type").alias("type")).agg(F.count("*").alias("count"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
