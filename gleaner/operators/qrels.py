"""Graded relevance labels: merging sources by priority, remapping between chunkings, guards and subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.chunking import overlapping

PAIR = ["query_id", "doc_id"]


def apply_judge(judge: DataFrame, clause: DataFrame) -> DataFrame:
    """query_id, doc_id, grade: clause labels go before the judge's, grades above 0 stay, and only queries that keep a 2."""
    x, y = judge.select(*PAIR, F.col("grade").alias("j")), clause.select(*PAIR, F.col("grade").alias("c"))
    merged = x.join(y, PAIR, "full_outer").select(*PAIR, F.coalesce("c", "j").alias("grade")).where("grade > 0")
    best = F.max("grade").over(Window.partitionBy("query_id"))
    return merged.withColumn("best", best).where("best = 2").drop("best")


def apply_pool_judge(old: DataFrame, judge: DataFrame, clause: DataFrame) -> DataFrame:
    """Old labels never go; the judge adds grades above 0 where there was none; clause labels overwrite at the end."""
    o, j, c = (t.select(*PAIR, F.col("grade").alias(n)) for t, n in ((old, "o"), (judge.where("grade > 0"), "j"), (clause, "c")))
    return o.join(j, PAIR, "full_outer").join(c, PAIR, "full_outer").select(*PAIR, F.coalesce("c", "o", "j").alias("grade"))


def merged(sources: list[DataFrame]) -> DataFrame:
    """Labels of several sources; the first source that has a pair gives its grade, and a grade of 0 deletes it."""
    tagged = reduce(DataFrame.unionByName, [s.select(*PAIR, "grade", F.lit(i).alias("source")) for i, s in enumerate(sources)])
    first = tagged.groupBy(*PAIR).agg(F.min_by("grade", "source").alias("grade"))
    return first.where("grade > 0")


def vanished(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs that the old labels had and the new ones lost."""
    return old.select(*PAIR).join(new, PAIR, "left_anti")


def same_act_grades(gold: DataFrame, chunks: DataFrame, share: float = 0.30) -> DataFrame:
    """query_id, doc_id, grade: the gold chunks with 2, and chunks of the same act that share `share` of a gold span with 1."""
    spans = chunks.select(F.col("chunk_id").alias("id"), "doc_id", "char_start", "char_end")
    mine = spans.join(gold.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    near = overlapping(mine, spans).where(F.col("shared") >= share * (F.col("e1") - F.col("s1")))
    one = gold.select("query_id", F.col("doc_id").alias("a_id")).join(near, "a_id").select("query_id", F.col("b_id").alias("doc_id"), F.lit(1).alias("grade"))
    two = gold.select("query_id", "doc_id", F.lit(2).alias("grade"))
    return two.union(one).groupBy(*PAIR).agg(F.max("grade").alias("grade"))


def review_neighbours(gold: DataFrame, chunks: DataFrame, share: float = 0.30, window: int = 2, most: int = 4) -> DataFrame:
    """query_id, gold, doc_id, distance, place: for each gold chunk the `most` chunks of its act that a person should grade.

    They stand within `window` places of it or in its section (those come after, by distance), and share less than `share` of its span.
    chunks: chunk_id, doc_id, position, section, char_start, char_end. Only the gold chunks' own acts are looked at.
    """
    names = ["position", "section", "char_start", "char_end"]
    mine = gold.select("query_id", F.col("doc_id").alias("gold")).join(chunks.select(F.col("chunk_id").alias("gold"), F.col("doc_id").alias("act"), *(F.col(c).alias(f"g_{c}") for c in names)), "gold")
    near = mine.join(chunks.select("chunk_id", F.col("doc_id").alias("act"), *names), "act").where("chunk_id <> gold")
    distance = F.abs(F.col("position") - F.col("g_position"))
    shared = F.greatest(F.lit(0), F.least("char_end", "g_char_end") - F.greatest("char_start", "g_char_start"))
    section = (F.coalesce("section", F.lit("")) != "") & (F.col("section") == F.col("g_section"))
    far = F.when(distance <= window, distance).when(section, 100 + distance)
    rows = near.where(shared < share * (F.col("g_char_end") - F.col("g_char_start"))).withColumn("distance", far).where("distance is not null")
    order = F.row_number().over(Window.partitionBy("query_id", "gold").orderBy("distance", "chunk_id"))
    return rows.withColumn("place", order).where(F.col("place") <= most).select("query_id", "gold", F.col("chunk_id").alias("doc_id"), "distance", "place")


def remap(qrels: DataFrame, source: DataFrame, target: DataFrame, share: float = 0.5) -> DataFrame:
    """Labels moved to another chunking: query_id, doc_id, grade.

    source, target: id, doc_id, char_start, char_end. An exactly equal span takes the grade alone; else the span
    with most shared characters (ties: smaller start, then larger id) takes it, and for a grade of 2 or more the
    others that hold `share` of the old span get 1. The larger grade stays where labels meet.
    """
    old = qrels.select("query_id", F.col("doc_id").alias("a_id"), "grade")
    used = source.join(old.select(F.col("a_id").alias("id")).distinct(), "id", "left_semi")
    hit = overlapping(used, target).join(old, "a_id")
    w = Window.partitionBy("query_id", "a_id")
    exact = (F.col("s1") == F.col("s2")) & (F.col("e1") == F.col("e2"))
    order = w.orderBy(F.desc(exact.cast("int")), F.desc("shared"), "s2", F.desc("b_id"))
    hit = hit.withColumn("r", F.row_number().over(order)).withColumn("exact", F.max(exact.cast("int")).over(w))
    extra = (F.col("exact") == 0) & (F.col("grade") >= 2) & (F.col("shared") >= share * (F.col("e1") - F.col("s1")))
    moved = hit.withColumn("new", F.when(F.col("r") == 1, F.col("grade")).when(extra, 1)).where("new is not null")
    return moved.groupBy("query_id", F.col("b_id").alias("doc_id")).agg(F.max("new").alias("grade"))


def remap_losses(qrels: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """reason, n: labels of spans that the source doesn't know, and those without any shared character in the target."""
    old = qrels.select("query_id", F.col("doc_id").alias("id"))
    unknown = old.join(source, "id", "left_anti")
    known = old.join(source, "id", "left_semi")
    lost = known.join(overlapping(source, target).select(F.col("a_id").alias("id")).distinct(), "id", "left_anti")
    return unknown.agg(F.lit("unknown").alias("reason"), F.count("*").alias("n")).union(lost.agg(F.lit("lost").alias("reason"), F.count("*").alias("n")))


def one_act_numbers(acts: DataFrame) -> DataFrame:
    """number, doc_id of the numbers that name exactly one act."""
    return acts.groupBy("number").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").drop("n")


def subset_stats(qrels: DataFrame, subsets: DataFrame) -> DataFrame:
    """subset, n_queries, n_pairs, pairs_per_query of labelled queries."""
    both = subsets.join(qrels, "query_id")
    out = both.groupBy("subset").agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_pairs"))
    return out.withColumn("pairs_per_query", F.round(F.col("n_pairs") / F.col("n_queries"), 6))


def histogram(values: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """lo, hi, n of the half-open bins between the edges, empty ones too."""
    bins = values.sparkSession.createDataFrame(list(zip(edges[:-1], edges[1:])), "lo double, hi double")
    inside = F.broadcast(bins).join(values.select(F.col(value).alias("v")), (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")), "right").groupBy("lo", "hi").agg(F.count("*").alias("c"))
    return bins.join(inside, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("c", F.lit(0)).alias("n"))
