"""Operations on runs, long tables of (query_id, doc_id, rank): fusion, filters, lifting to parents, overlap, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(runs: list[DataFrame], top: int = 50, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion; ties keep the order of first sight (run by run, then rank)."""
    tagged = reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank", F.lit(i).alias("run")) for i, r in enumerate(runs)])
    fused = tagged.groupBy("query_id", "doc_id").agg(F.sum(1 / (c + F.col("rank"))).alias("score"), F.min(F.struct("run", "rank")).alias("seen"))
    fused = fused.withColumn("score", F.round("score", 9))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen.run", "seen.rank"))
    return fused.withColumn("rank", order).where(F.col("rank") <= top).select("query_id", "doc_id", "score", "rank")


def common_queries(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, [r.select("query_id") for r in runs])


def reranked(run: DataFrame, score: Column, top: int = 10) -> DataFrame:
    """The run ordered anew by a score column; ties keep their old rank."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "old_rank"))
    rows = run.withColumnRenamed("rank", "old_rank").withColumn("score", score)
    return rows.withColumn("rank", order).where(F.col("rank") <= top)


def overlap(a: DataFrame, b: DataFrame, depth: int = 10) -> DataFrame:
    """query_id, overlap: the share of a's first places that b's first places hold, over the queries of both."""
    x, y = (r.where(F.col("rank") <= depth).select("query_id", "doc_id") for r in (a, b))
    both = x.join(y, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("same"))
    return common_queries([a, b]).join(both, "query_id", "left").select("query_id", (F.coalesce("same", F.lit(0)) / depth).alias("overlap"))


def divergence(a: DataFrame, b: DataFrame, depth: int = 10) -> DataFrame:
    """One row: how many of a's first places b lost from its own, and where b has them, median and deepest."""
    lost = a.where(F.col("rank") <= depth).select("query_id", "doc_id").join(b.select("query_id", "doc_id", F.col("rank").alias("place")), ["query_id", "doc_id"], "left")
    lost = lost.where(F.coalesce("place", F.lit(1 << 30)) > depth)
    return lost.agg(F.count("*").alias("lost"), F.count("place").alias("deeper"), F.percentile("place", 0.5).alias("median_place"), F.max("place").alias("max_place"))


def lifted(run: DataFrame, parents: DataFrame, top: int = 10) -> DataFrame:
    """Each document replaced by its parent (doc_id, parent), repeats dropped, places closed up."""
    first = run.join(parents, "doc_id").groupBy("query_id", "parent").agg(F.min("rank").alias("best"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("best", "parent"))
    return first.withColumn("rank", order).where(F.col("rank") <= top).select("query_id", F.col("parent").alias("doc_id"), "rank")


def with_gold(run: DataFrame, gold: DataFrame, depth: int = 10) -> DataFrame:
    """The first depth places; where the gold document isn't among them it takes the last one."""
    head = run.where(F.col("rank") <= depth)
    has = head.join(gold, ["query_id", "doc_id"], "left_semi").select("query_id").distinct()
    need = gold.join(run.select("query_id").distinct(), "query_id", "left_semi").join(has, "query_id", "left_anti")
    cut = head.join(need.select("query_id"), "query_id", "left_semi").where(F.col("rank") < depth)
    rest = head.join(need.select("query_id"), "query_id", "left_anti")
    last = cut.groupBy("query_id").agg((F.max("rank") + 1).alias("rank"))
    injected = need.join(last, "query_id", "left").select("query_id", "doc_id", F.coalesce("rank", F.lit(1)).alias("rank"))
    names = ["query_id", "doc_id", "rank"]
    return rest.select(names).union(cut.select(names)).union(injected.select(names))


def pool(runs: dict[str, DataFrame], size: int = 14, depth: int = 10) -> DataFrame:
    """Round-robin pool: rank by rank, runs by name, first sight only, `size` documents a query."""
    tagged = reduce(DataFrame.unionByName, [r.where(F.col("rank") <= depth).select("query_id", "doc_id", "rank", F.lit(n).alias("run")) for n, r in runs.items()])
    seen = tagged.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "run")).alias("seen"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("seen.rank", "seen.run"))
    return seen.withColumn("place", order).where(F.col("place") <= size).select("query_id", "doc_id", "place", F.col("seen.run").alias("run"))
