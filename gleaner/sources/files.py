"""Readers and writers of the formats that retrieval data comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.sources.durable import exists


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines, plain or gzipped; blank lines give no row."""
    return spark.read.schema(schema).json(path)


def parse_qrels(lines: DataFrame) -> DataFrame:
    """query_id, doc_id, grade from lines (line_no, value) of a tab-separated file.

    An optional header starts with query-id; further columns are ignored; a row without a whole number as grade is
    skipped; the last row of a pair wins.
    """
    cells = F.split("value", "\t", -1)
    rows = lines.where("value not like 'query-id%'").where(F.size(cells) >= 3)
    rows = rows.select("line_no", cells[0].alias("query_id"), cells[1].alias("doc_id"), F.trim(cells[2]).alias("g")).where(F.col("g").rlike(r"^-?\d+$"))
    return rows.groupBy("query_id", "doc_id").agg(F.max_by(F.col("g").cast("int"), "line_no").alias("grade"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, value in the order of the file."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return parse_qrels(read_lines(spark, path))


def read_qrels_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, grade from JSON lines of query-id, corpus-id and score; only scores above 0, the last row of a pair wins."""
    rows = spark.read.schema("`query-id` string, `corpus-id` string, score int").json(path).withColumn("line_no", F.monotonically_increasing_id())
    pairs = rows.where("score > 0").groupBy(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id"))
    return pairs.agg(F.max_by("score", "line_no").alias("grade"))


def write_qrels(qrels: DataFrame, path: str) -> None:
    """Tab-separated with a header, sorted, grades of 0 and less left out."""
    rows = qrels.where("grade > 0").select(F.col("query_id").alias("query-id"), F.col("doc_id").alias("corpus-id"), F.col("grade").alias("score"))
    rows.orderBy("query-id", "corpus-id").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def run_lines(run: DataFrame) -> DataFrame:
    """query_id, ranked array: one row a query, scores left out."""
    places = F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").cast("string").alias("doc_id"))))
    return run.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(places.getField("doc_id").alias("ranked"))


def run_name(name: str) -> str:
    return name.replace(":", "-").replace("+", "-")


def write_run(run: DataFrame, folder: str, config: str, retriever: str) -> None:
    run_lines(run).write.mode("overwrite").json(f"{folder}/{run_name(config)}__{run_name(retriever)}.jsonl")


def read_runs(spark: SparkSession, folder: str, config: str) -> DataFrame:
    """run, query_id, doc_id, rank of all runs of a config: the retriever is in the name of the file or folder."""
    rows = spark.read.schema("query_id string, ranked array<string>").json(f"{folder}/{config}__*.jsonl")
    rows = rows.withColumn("run", F.regexp_extract(F.input_file_name(), r"__([^/]+)\.jsonl", 1))
    return rows.select("run", "query_id", F.posexplode("ranked").alias("rank", "doc_id")).withColumn("rank", F.col("rank") + 1)


def beir_corpus(chunks: DataFrame) -> DataFrame:
    """_id, title, text with the act and the section in the title."""
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" // "), F.col("section"))).otherwise("")
    return chunks.select(F.col("chunk_id").alias("_id"), F.concat("number", F.lit(" от "), "date", F.lit(". "), "title", section).alias("title"), "text")


def beir_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """_id, text of the queries that have labels."""
    return queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi").select(F.col("query_id").alias("_id"), "text")


def filled_down(sheet: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Blank cells take the last filled one above, within `by`; order of rows: line."""
    w = Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return sheet.withColumn(column, F.last(F.nullif(F.trim(column), F.lit("")), ignorenulls=True).over(w))


def exploded_split(split_json: DataFrame) -> DataFrame:
    """part, doc_id from one JSON text {"groups": {part: [ids]}}."""
    groups = F.from_json("value", "groups map<string, array<string>>")["groups"]
    return split_json.select(F.explode(groups).alias("part", "ids")).select("part", F.explode("ids").alias("doc_id"))


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys aren't in the table at path yet; the number of them. A run that broke off goes on where it stood.

    The rows are computed once and counted as they are written. One writer at a time: what two append at once isn't compared.
    """
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    seen = Observation()
    rows.dropDuplicates(keys).observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def union_queries(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """query_id, text, origin, route of several sources; the first source that has an id gives its row, rejected routes drop out."""
    tagged = None
    for i, (name, rows) in enumerate(sources):
        part = rows.withColumn("origin", F.lit(name)).withColumn("_i", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    kept = tagged.where("not coalesce(route, '') like 'отброшен%'")
    w = Window.partitionBy("query_id").orderBy("_i", "text")
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_i")
