"""Global numbering without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: list[str], name: str, ranges: int = 64) -> DataFrame:
    """The rows with their place (from 1) in the order, which must start with a column of hexadecimal digests.

    The first two digits cut the order into ranges; places within a range come from a window over it, the ranges'
    offsets from their counts, a table of at most 256 rows.
    """
    cut = rows.withColumn("_range", F.substring(order[0], 1, 2))
    counts = cut.groupBy("_range").agg(F.count("*").alias("_c"))
    offsets = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_before"))
    placed = cut.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_i")).drop("_range", "_before", "_i")
