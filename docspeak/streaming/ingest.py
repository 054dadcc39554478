"""Streams: files of blocks through the batch plan, and job states from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cleaner, jobs
from ..schema import BLOCKS


def clean_stream(spark: SparkSession, source: str, out: str, checkpoint: str, files: int = 10) -> StreamingQuery:
    """Clean arriving parquet files of whole documents, at most ``files`` at a time."""

    def each(batch: DataFrame, number: int) -> None:
        cleaner.cleaned(cleaner.with_reason(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch overwrites itself

    rows = spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", files).parquet(source)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(events: DataFrame) -> DataFrame:
    """The last state of each job, for a stream in update or complete mode."""
    last = F.max_by(F.struct("status", "progress"), F.struct("at", "event_id"))
    return events.groupBy("job_id").agg(F.max("at").alias("updated_at"), last.alias("s")).select("job_id", "updated_at", F.col("s.status").alias("status"), jobs.clamp(F.col("s.progress")).alias("progress"))
