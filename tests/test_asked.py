"""What queries ask of documents, read in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import plain
from gleaner.functions.stemmer import tokenize
from gleaner.functions.text import split_tokens, truncate_tokens
from gleaner.operators import asked, bm25, copying
from gleaner.plans import base, registry

SMALL = "/root/testdata/sf0.001"
TOKENIZERS = [tokenize, truncate_tokens, split_tokens]


def rows(df):
    return sorted(map(tuple, df.collect()))


def corpus(spark):
    rng = random.Random(5)
    words = "a wordlong wordlonger 590-п ab-12/3 3-x положение положения ё Ёлка it's \t İx café ſ ٣-ab end.".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(120)]
    texts += [None, "", " \n", "-", texts[0], texts[1] + " a " + texts[1], "wordlong " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    queries = [(i, t) for i, t in enumerate(texts[:25] + ["нет таких", None, "", "wordlong " * 8])]
    return docs, spark.createDataFrame(queries, "query_id long, text string")


def wanted_runs(queries):
    return queries.select(F.explode(copying.grams(split_tokens(F.col("text")))).alias("gram")).distinct()


def test_asked_rows_give_the_searches_and_runs_of_whole_texts(spark, tmp_path, monkeypatch):
    docs, queries = corpus(spark)
    once = asked.Asked(spark, str(tmp_path / "a"), docs, queries, "query_id", TOKENIZERS)
    assert once.known
    for t in TOKENIZERS:
        whole = bm25.build(docs, t)
        assert rows(once.index(t).df) == rows(whole.df)
        assert rows(once.index(t).rows.select("doc_id", "dl")) == rows(whole.rows.select("doc_id", "dl"))
        assert rows(once.best(t, 7)) == rows(bm25.best(whole, queries, "query_id", t, 7))
    want = rows(copying.shared_grams(docs, wanted_runs(queries)))
    assert want and rows(once.shared) == want
    # texts aren't read again
    monkeypatch.setattr(plain, "blanked", None)
    assert rows(asked.Asked(spark, str(tmp_path / "a"), docs, queries, "query_id", TOKENIZERS).shared) == want


def test_small_parts_and_early_counts_change_nothing(spark):
    """Texts are taken some megabytes at a time, and counts of a large vocabulary are passed on before a task's end."""
    import pyarrow as pa

    docs, _ = corpus(spark)

    class Given:
        value = ([plain.FORMS[truncate_tokens]], [["wordlo", "a"]], ["wordlong a a a a a a a"])

    batches = docs.select("doc_id", F.lower("text").alias("text")).coalesce(1).toArrow().cast(pa.schema([("doc_id", pa.int32()), ("text", pa.string())])).to_batches()

    def made(**sizes):
        docs, counts = {}, {}
        for batch in asked._pass(Given, pa.int32(), 8, **sizes)(iter(batches)):
            for r in batch.to_pylist():
                if r["form"] is None:
                    docs[r["doc_id"]] = r["dl0"], r["terms0"], r["runs"]
                else:
                    for c in r["counts"]:
                        counts[c["token"]] = counts.get(c["token"], 0) + c["df"]
        return docs, counts

    assert made() == made(size=1, most=0) == made(size=300, most=5)


@pytest.mark.parametrize("name", ["h4_exhaustive_pool", "g26_run_overlap", "g24_candidates_with_gold", "i1_apply_judge", "h5_label_provenance"])
def test_searches_and_labels_split_the_texts_once(spark, name, monkeypatch):
    """No whole index is built, and the labels read no text, for queries that want the runs of given questions."""
    base.forget_indexes(spark)
    for where, what in ((bm25, "build"), (base, "stored_index"), (base, "shared_grams")):
        monkeypatch.setattr(where, what, None)
    assert registry.queries()[name](spark, SMALL).count()
    base.forget_indexes(spark)


def test_many_terms_are_searched_over_the_whole_index(spark, monkeypatch):
    few = rows(base.run_words(spark, SMALL, 5)), rows(base.text_qrels(spark, SMALL))
    base.forget_indexes(spark)
    monkeypatch.setattr(asked, "MOST_RUNS", 1)
    assert not base.asked(spark, SMALL).known
    assert (rows(base.run_words(spark, SMALL, 5)), rows(base.text_qrels(spark, SMALL))) == few
    base.forget_indexes(spark)


def test_reranking_shuffles_no_text(spark):
    """Pairs of a run go to the documents as they are read, whatever size the plan takes the texts to have."""
    name, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(name, "-1")
    try:
        plan = registry.queries()["g18_rerank_lexical"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, old)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan, plan
