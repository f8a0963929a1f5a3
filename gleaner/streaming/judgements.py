"""Judgements as a stream: a file source, duplicates dropped within a watermark, finished keys appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.files import append_new


def judgements(spark: SparkSession, folder: str, schema: str = "query_id string, chunk_id string, grade int, ts timestamp", lateness: str = "1 hour") -> DataFrame:
    """A stream of the JSON lines that arrive in a folder; a pair counts once within the lateness."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(folder)
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["query_id", "chunk_id"])


def sink(rows: DataFrame, path: str, checkpoint: str):
    """Append each batch's new pairs to the table at path, so that a repeated batch changes nothing; runs what is there, then stops."""
    return (
        rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, _: append_new(batch.drop("ts"), path, ["query_id", "chunk_id"]) and None).start()
    )


def windowed(rows: DataFrame, every: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Judgements and mean grade by window of event time; windows close after the lateness."""
    return rows.withWatermark("ts", lateness).groupBy(F.window("ts", every)).agg(F.count("*").alias("n"), F.avg("grade").alias("mean"))


def counted(events: DataFrame) -> DataFrame:
    """event_type, users, n."""
    return events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))
