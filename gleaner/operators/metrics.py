"""Ranking metrics per query. Undefined values are null (recall and NDCG without positives); MRR without a hit is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("recall_1", "recall_5", "recall_10", "mrr_10", "ndcg_10")


def per_query(run: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = (1, 5, 10), depth: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, recall_k..., mrr_{depth}, ndcg_{depth} over the queries that run and qrels both have.

    run: query_id, doc_id, rank, and the columns `by`, by which several runs are told apart; qrels: query_id, doc_id, grade (one row a pair).
    """
    keys = [*by, "query_id"]
    both = run.select(*keys).distinct().join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal = qrels.where("grade > 0").withColumn("i", F.row_number().over(w)).groupBy("query_id").agg(
        F.count("*").alias("good"), F.sum(F.when(F.col("i") <= depth, gain / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("idcg")
    )
    hit = run.join(qrels.where("grade > 0"), ["query_id", "doc_id"]).groupBy(*keys).agg(
        *(F.count_if(F.col("rank") <= k).alias(f"hit_{k}") for k in depths),
        F.min(F.when(F.col("rank") <= depth, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= depth, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    rows = both.join(ideal, "query_id", "left").join(hit, keys, "left")
    zero = F.lit(0)
    return rows.select(
        *keys,
        *(F.round(F.coalesce(f"hit_{k}", zero) / F.col("good"), 6).alias(f"recall_{k}") for k in depths),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias(f"mrr_{depth}"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / F.nullif(F.col("idcg"), F.lit(0.0)), 6).alias(f"ndcg_{depth}"),
    )


def per_query_counted(run: DataFrame, totals: DataFrame, depths: tuple[int, ...] = (1, 5, 10), depth: int = 10) -> DataFrame:
    """The metrics of per_query where labels are known by rule: only their numbers are needed beyond the run.

    run: query_id, doc_id, rank, grade (0 or null: none); totals: query_id, grade, n, how many documents have that grade for the query
    (a row with n = 0 says that the query was judged). No table of all labels is made.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    judged = totals.groupBy("query_id").agg(F.sum(F.when(F.col("grade") > 0, F.col("n")).otherwise(0)).alias("good"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0)
    ends = totals.where("grade > 0 and n > 0").withColumn("upto", F.sum("n").over(w))
    low, high = F.col("upto") - F.col("n") + 1, F.least(F.col("upto"), F.lit(depth))
    places = ends.where(low <= depth).select("query_id", "grade", F.explode(F.sequence(low, high)).alias("i"))
    ideal = places.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("i") + 1.0)).alias("idcg"))
    positive = F.coalesce("grade", F.lit(0)) > 0
    hit = run.groupBy("query_id").agg(
        *(F.count_if(positive & (F.col("rank") <= k)).alias(f"hit_{k}") for k in depths),
        F.min(F.when(positive & (F.col("rank") <= depth), F.col("rank"))).alias("first"),
        F.sum(F.when(positive & (F.col("rank") <= depth), gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    rows = hit.join(judged, "query_id").join(ideal, "query_id", "left")
    good = F.nullif(F.col("good"), F.lit(0))
    return rows.select(
        "query_id",
        *(F.round(F.col(f"hit_{k}") / good, 6).alias(f"recall_{k}") for k in depths),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias(f"mrr_{depth}"),
        F.round(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0)), 6).alias(f"ndcg_{depth}"),
    )


def unpivoted(metrics: DataFrame, names=METRICS, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id (and the columns `by`), metric, value."""
    return metrics.unpivot([*by, "query_id"], list(names), "metric", "value")


def report(runs: DataFrame, qrels: DataFrame, subsets: DataFrame, least: int = 20) -> DataFrame:
    """run, subset, metric, n, mean over the queries that all runs have; subsets with fewer than `least` queries drop out.

    runs: run, query_id, doc_id, rank; subsets: subset, query_id (they may overlap).
    """
    n_runs = runs.agg(F.countDistinct("run").alias("n_runs"))
    common = runs.groupBy("query_id").agg(F.countDistinct("run").alias("in_runs")).join(F.broadcast(n_runs), F.col("in_runs") == F.col("n_runs")).select("query_id")
    long = unpivoted(per_query(runs.join(common, "query_id", "left_semi"), qrels, by=("run",)), by=("run",))
    out = long.join(subsets, "query_id").groupBy("run", "subset", "metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.where(F.col("n") >= least)
