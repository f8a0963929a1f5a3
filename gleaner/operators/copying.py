"""How much of a question is copied from a passage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import plain
from gleaner.functions.text import let, split_tokens

#: Wanted runs of tokens up to this number go to every task; more of them meet those of the documents by shuffle.
MOST_RUNS = 200_000


def grams(tokens, n: int = 8):
    """All runs of n tokens, joined; none for fewer tokens."""
    none = F.array().cast("array<string>")
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(none))


def shared_grams(docs: DataFrame, wanted: DataFrame, n: int = 8, most: int = MOST_RUNS) -> DataFrame:
    """doc_id, gram of the wanted runs of n tokens (column gram, distinct) that stand in documents (doc_id, text), each once.

    The wanted runs are counted; where they are few, a document's are looked up within its row, and only hits leave the task.
    """
    told = wanted.select("gram").limit(most + 1).collect() if most else []
    if not most or len(told) > most:
        there = docs.select("doc_id", F.explode(F.array_distinct(grams(split_tokens(F.col("text")), n))).alias("gram"))
        return there.join(wanted.select("gram"), "gram", "left_semi").select("doc_id", "gram")
    held = docs.sparkSession.sparkContext.broadcast(frozenset(r.gram for r in told))

    def run(batches):
        import pyarrow as pa

        runs = held.value
        heads = {g.split(" ", 1)[0] for g in runs}
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = plain.split_tokens(text) if text else []
                hits = {g for i in range(len(t) - n + 1) if t[i] in heads and (g := " ".join(t[i : i + n])) in runs}
                ids += [doc] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(found, pa.string())], ["doc_id", "gram"])

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, gram string")


def longest_runs(queries: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, doc_id, run, share for the pairs that share a token: the longest common run of tokens.

    Equal tokens of a pair lie on diagonals (difference of their places); a run is an island on one of them.
    """
    q = queries.select("query_id", F.size(split_tokens(F.col("text"))).alias("n"), F.posexplode(split_tokens(F.col("text"))).alias("p", "token"))
    used = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    t = used.select("doc_id", F.posexplode(split_tokens(F.col("text"))).alias("s", "token"))
    same = pairs.join(q, "query_id").join(t, ["doc_id", "token"]).withColumn("diagonal", F.col("p") - F.col("s"))
    w = Window.partitionBy("query_id", "doc_id", "diagonal").orderBy("p")
    island = same.withColumn("island", F.col("p") - F.row_number().over(w))
    runs = island.groupBy("query_id", "doc_id", "diagonal", "island").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    return runs.groupBy("query_id", "doc_id").agg(F.max("c").alias("run"), F.round(F.max("c") / F.max("n"), 6).alias("share"))
