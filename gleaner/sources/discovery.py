"""Finding files below a root by what their names and metadata say; no content is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, file, modified, length of all files below root whose names match; Spark lists folders in parallel, and only metadata."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.substring_index("path", "/", -1).alias("file"), F.col("modificationTime").alias("modified"), "length")


def found(files: DataFrame, names: DataFrame, newest: bool = False) -> DataFrame:
    """name, path, modified, length: of each name (column `name`) the file that is meant, null where there is none.

    files: as from `listing`. A name stands for itself and for its form with or without .gz. The form that was asked for comes
    first, then the shortest path, then the newest file; with `newest` the newest comes before the shortest path.
    """
    other = F.when(F.col("name").endswith(".gz"), F.expr("left(name, char_length(name) - 3)")).otherwise(F.concat("name", F.lit(".gz")))
    asked = names.select("name", F.explode(F.array(F.struct(F.col("name").alias("file"), F.lit(0).alias("form")), F.struct(other.alias("file"), F.lit(1).alias("form")))).alias("f")).select("name", "f.*")
    age, size = F.desc("modified"), F.char_length("path")
    order = F.row_number().over(Window.partitionBy("name").orderBy("form", *((age, size) if newest else (size, age)), "path"))
    hits = asked.join(files, "file").withColumn("i", order).where("i = 1").select("name", "path", "modified", "length")
    return names.select("name").distinct().join(hits, "name", "left")


def richest(files: DataFrame, mark: str = "ids.txt", up: int = 2) -> DataFrame:
    """root, n: the folder, `up` levels above the folders of files called `mark`, below which there are most of them (ties: the first by name); no row without one."""
    folder = F.regexp_replace("path", F.lit("(/[^/]*)" + "{" + str(up + 1) + "}$"), F.lit(""))
    return files.where(F.col("file") == mark).groupBy(folder.alias("root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)
