"""Splits and training data: leak-free groups of acts, pairs, hard negatives, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import cyrillic_share, sigmoid


def shuffled(*parts: Column, seed: int = 17) -> Column:
    """A repeatable order: the md5 of the seed and the parts."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)).cast("binary"))


def split_acts(acts: DataFrame, stratum: str, weight: str, shares: dict[str, float], seed: int = 17) -> DataFrame:
    """doc_id, part: in each stratum, acts in md5 order go to the first part until its share of the weight is reached, then to the next, the rest to train.

    The first three digits of the md5 cut a stratum into ranges: sums run within a range, and the sums of the ranges
    (at most 4096 a stratum) give what lies before it, so no task gets a whole stratum.
    """
    rows = acts.withColumn("_o", shuffled(F.col("doc_id"), seed=seed)).withColumn("_range", F.substring("_o", 1, 3))
    sums = rows.groupBy(F.col(stratum).alias("_s"), F.col("_range").alias("_r")).agg(F.coalesce(F.sum(weight), F.lit(0)).alias("_w"))
    w = Window.partitionBy("_s")
    ranges = sums.select("_s", "_r", (F.sum("_w").over(w.orderBy("_r")) - F.col("_w")).alias("_earlier"), F.sum("_w").over(w).alias("_all"))
    inside = Window.partitionBy(stratum, "_range").orderBy("_o", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(ranges, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    rows = rows.withColumn("_before", F.col("_earlier") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    part, edge = None, 0.0
    for name, share in shares.items():
        edge += share
        fits = F.col("_before") < edge * F.col("_all")
        part = F.when(fits, name) if part is None else part.when(fits, name)
    return rows.select("doc_id", stratum, part.otherwise("train").alias("part"))


def in_several_groups(groups: DataFrame) -> DataFrame:
    return groups.groupBy("doc_id").agg(F.countDistinct("part").alias("n")).where("n > 1")


def leaked(train: DataFrame, heldout: DataFrame) -> DataFrame:
    return train.select("doc_id").intersect(heldout.select("doc_id"))


def outside_group(queries: DataFrame, groups: DataFrame, expected: str) -> DataFrame:
    """query_id, part: queries whose act isn't in the expected group."""
    both = queries.join(groups, "doc_id", "left").select("query_id", F.coalesce("part", F.lit("нет в сплите")).alias("part"))
    return both.where(F.col("part") != expected)


def build_pairs(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, reason: kept, or why not, in this order: the gold passage is missing, is blank, the question was seen before."""
    both = queries.join(passages.select("doc_id", F.col("text").alias("passage")), "doc_id", "left")
    state = F.when(F.col("passage").isNull(), "no gold").when(F.trim("passage") == "", "blank gold")
    both = both.withColumn("reason", state)
    first = F.row_number().over(Window.partitionBy("reason", "text").orderBy("query_id"))
    repeat = F.col("reason").isNull() & (F.col("n") > 1)
    return both.withColumn("n", first).select("query_id", F.when(repeat, "repeated").otherwise(F.coalesce("reason", F.lit("kept"))).alias("reason"))


def pick_negatives(candidates: DataFrame, most: float = 0.5, margin: float = 0.10, per_query: int = 2) -> DataFrame:
    """Every candidate with the first rule that drops it, or `kept`.

    candidates: query_id, gold, gold_act, gold_score, doc_id, act, place, score (logits), train boolean.
    """
    p, gold_p = sigmoid(F.col("score")), sigmoid(F.col("gold_score"))
    reason = (
        F.when(F.col("doc_id") == F.col("gold"), "gold").when(~F.col("train"), "not a training act").when(F.col("act") == F.col("gold_act"), "same act")
        .when(p >= most, "score too high").when(p >= gold_p - margin, "close to gold")
    )
    rows = candidates.withColumn("reason", reason)
    so_far = F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_k", so_far)
    last = F.when(F.col("reason").isNull() & (F.col("_k") > per_query), "surplus").otherwise(F.coalesce("reason", F.lit("kept")))
    return rows.withColumn("reason", last).drop("_k")


def negative_columns(picked: DataFrame, k: int = 2) -> DataFrame:
    """query_id, negative_1..k of the queries that have k."""
    kept = picked.where("reason = 'kept'").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "doc_id"))).alias("n"))
    return kept.where(F.size("n") >= k).select("query_id", *(F.col("n")[i]["doc_id"].alias(f"negative_{i + 1}") for i in range(k)))


def capped(rows: DataFrame, by: str, order: list, most: int = 12) -> DataFrame:
    """At most `most` rows of each value of `by`."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def forgetting_sample(docs: DataFrame, relevant: DataFrame, size: int = 20_000, seed: int = 17) -> DataFrame:
    """All relevant documents, filled up to `size` with others in md5 order."""
    known = relevant.select("doc_id").distinct()
    kept, others = (docs.join(known, "doc_id", how) for how in ("left_semi", "left_anti"))
    fill = others.withColumn("_fill", shuffled(F.col("doc_id"), seed=seed)).orderBy("_fill", "doc_id").limit(max(size - kept.count(), 0))
    return kept.unionByName(fill.drop("_fill"))


def build_corpus(wanted: DataFrame, found: DataFrame, least_chars: int = 500, least_cyrillic: float = 0.90) -> DataFrame:
    """number, date, title, issue, chars, cyrillic, text, reason: each wanted act once, with its text from the first of its issues that holds it.

    wanted: number, date, title, issue (an act is listed once for each issue); found: issue, number, text. Acts that
    no issue holds give no row. reason: why the act is rejected, else null.
    """
    texts = found.select("issue", "number", "text").join(wanted, ["issue", "number"])
    first = texts.groupBy("number", "date").agg(F.min_by(F.struct("title", "issue", "text"), F.struct("issue", "text")).alias("a")).select("number", "date", "a.*")
    first = first.withColumns({"chars": F.length("text").cast("long"), "cyrillic": F.round(cyrillic_share(F.col("text")), 3)})
    reason = F.when(F.col("cyrillic") < least_cyrillic, "мало кириллицы").when(F.col("chars") < least_chars, "слишком короткий")
    return first.select("number", "date", "title", "issue", "chars", "cyrillic", "text", reason.alias("reason"))


def train_report(**parts: DataFrame) -> DataFrame:
    """part, state, n: the rows of every part of the training data by state (column `state`)."""
    out = None
    for name, rows in parts.items():
        one = rows.groupBy("state").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "state", "n")
        out = one if out is None else out.union(one)
    return out


def referential_faults(queries: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """check, n: labels of unknown queries, labels of unknown documents, queries without a positive label."""
    one = qrels.join(queries, "query_id", "left_anti").agg(F.lit("unknown query").alias("check"), F.count("*").alias("n"))
    two = qrels.join(corpus, "doc_id", "left_anti").agg(F.lit("unknown document").alias("check"), F.count("*").alias("n"))
    three = queries.join(qrels.where("grade > 0"), "query_id", "left_anti").agg(F.lit("no positive").alias("check"), F.count("*").alias("n"))
    return one.union(two).union(three)


def journal(entries: list[dict], tolerance: float = 0.02) -> list[dict]:
    """Fold of an experiment journal: each entry is compared with the last accepted one; adding a tag again replaces it.

    entries: tag, values {query: value}. A handful of runs, folded on the driver; means over the queries of both.
    """
    out: dict[str, dict] = {}
    for e in entries:
        out.pop(e["tag"], None)
        before = next((x for x in reversed(list(out.values())) if x["verdict"] != "rejected"), None)
        common = sorted(set(e["values"]) & set(before["values"])) if before else []
        diff = sum(e["values"][q] - before["values"][q] for q in common) / len(common) if common else None
        out[e["tag"]] = {**e, "compared_with": before["tag"] if before else None, "diff": diff, "verdict": "rejected" if diff is not None and diff < -tolerance else "accepted"}
    return list(out.values())
