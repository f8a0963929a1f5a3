"""The judging loop as a stream: pairs arrive as files, each is judged once, and a run that was stopped goes on where it stood."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from gleaner.sources.files import append_new

KEYS = ["query_id", "doc_id"]


def arriving(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 16, lateness: str = "30 days") -> DataFrame:
    """A stream of the pairs in a folder's Parquet files (query_id, doc_id, ts); a pair that comes again within the lateness is dropped.

    What comes later than the lateness behind the newest is dropped, too: it must cover the disorder of the files.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(KEYS)


def judged(pairs: DataFrame, texts: DataFrame, judge: Callable[[Column, Column], Column], grade: Callable[[Column], Column]) -> DataFrame:
    """query_id, doc_id, raw, grade of the arriving pairs; texts: query_id, doc_id, question, text of all pairs that may come.

    The stream meets the texts in each micro-batch; pairs without texts are left out.
    """
    from pyspark.sql import functions as F

    rows = pairs.join(texts, KEYS)
    rows = rows.withColumn("raw", judge(F.col("question"), F.col("text")))
    return rows.select(*KEYS, "raw", grade(F.col("raw")).alias("grade"))


def run(rows: DataFrame, table: str, checkpoint: str, fail_after: int | None = None) -> int:
    """Judge what has arrived and stop; the number of micro-batches done.

    Each batch appends the pairs that the table lacks, so a batch that is repeated after a crash changes nothing.
    fail_after: raise in the batch after so many, between judging and the stream's own record of the batch, as tests of a killed run want it.
    """
    done: list[int] = []

    def append(batch: DataFrame, number: int) -> None:
        append_new(batch, table, KEYS)
        done.append(number)
        if fail_after is not None and len(done) > fail_after:
            raise RuntimeError("killed")

    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start().awaitTermination()
    return len(done)
