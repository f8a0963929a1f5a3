"""Stored indexes, vector files, published versions, reports, discovery and the judging stream."""

import gzip
import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import plain
from gleaner.functions.stemmer import tokenize
from gleaner.functions.text import split_tokens, truncate_tokens
from gleaner.operators import bm25, dense
from gleaner.operators.inverted import Stored
from gleaner.operators.judging import grade, parse_answer
from gleaner.operators.models import overlap_judge
from gleaner.sources import discovery, durable, files, publish
from gleaner.sources.reports import Report
from gleaner.sources.vectors import VectorFiles, read_meta
from gleaner.streaming import judging

TEXTS = ["Принципы принципами 590-П и Закон 86-ФЗ о ЁЛКАХ", "", None, "Basel 2026 12/3-Э письмо АБ-12-3/4, расчётами резервов", "the quick-brown fox's 3-rd", "İstanbul ΑΣ straße", "не на и для", "вывшись старейшие"]


def test_plain_tokenizers_equal_the_columns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for column, function in plain.PLAIN.items():
        got = rows.select("text", F.lower("text").alias("low"), column(F.col("text")).alias("t")).collect()
        assert all((r.t or []) == (function(r.low) if r.low else []) for r in got), column


def some_docs(spark, n=400, seed=6):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(20_000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, "резервы банков")], "doc_id long, text string")


@pytest.mark.parametrize("tokenizer", [tokenize, truncate_tokens])
def test_stored_search_equals_scoring_all(spark, tmp_path, tokenizer):
    docs = some_docs(spark)
    q = spark.createDataFrame([(0, "w1 w2 w250"), (1, "w77 w77 w3"), (2, "unknown"), (3, ""), (4, "резерв w299"), (5, None)], "query_id long, text string")
    stored = Stored(spark, str(tmp_path / "i"), docs, tokenizer, range_docs=16)
    want = bm25.top(bm25.scores(bm25.build(docs, tokenizer), q, "query_id", tokenizer), "query_id", 7)
    got = stored.search(q, "query_id", 7)
    assert sorted(map(tuple, got.select("query_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "doc_id", "score", "rank").collect()))
    # the files alone serve the next search
    again = Stored(spark, str(tmp_path / "i"), None, tokenizer, range_docs=16)
    assert again.search(q, "query_id", 7).count() == got.count() and not spark.sparkContext._jsc.getPersistentRDDs()


def test_search_leaves_out_ranges(spark, tmp_path):
    """Rare terms decide: ranges without them can't reach the best, and aren't scored."""
    rows = [(i, "common words of all " + ("needle haystack" if i % 400 == 7 else "other")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = Stored(spark, str(tmp_path / "i"), docs, range_docs=32)
    q = spark.createDataFrame([(1, "common needle haystack")], "query_id long, text string")
    found, ranges = stored._searched(q, "query_id", 5, 4)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [7, 407, 807, 1207, 1607]
    assert ranges.count() <= 20 < stored.ranges


def test_a_part_that_broke_off_is_written_again(spark, tmp_path):
    docs = some_docs(spark, 50)
    stored = Stored(spark, str(tmp_path / "i"), docs)
    n = stored.index.postings.count()
    os.remove(tmp_path / "i" / "forward" / "_SUCCESS")
    assert Stored(spark, str(tmp_path / "i"), docs).index.postings.count() == n


def vectors_of(spark, n=300, dim=8, seed=2):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x[5] = 0
    x[17] = x[18] = x[19]
    rows = [(i, x[i].tolist()) for i in range(n)] + [(n, None), (n + 1, []), (n + 2, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


@pytest.mark.parametrize("half", [False, True])
@pytest.mark.parametrize("dim", [0, 4])
def test_searches_agree(spark, dim, half):
    v = vectors_of(spark)
    q = v.where("vec_id % 25 = 0 or vec_id = 17")
    a = dense.top_k(q, v, 9, dim, half=half)
    b = dense.top_k(q, v.where("size(embedding) = 8"), 9, dim, block_rows=64, most_bytes=0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 13 * 9
    assert "hashpartitioning" not in a._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].split("MapInArrow", 1)[1]  # the corpus is read where it lies


def test_heaps_keep_the_best():
    rng = np.random.default_rng(1)
    h, seen = dense.Heaps(3, 4), {0: [], 1: [], 2: []}
    for _ in range(20):
        row, score, name = rng.integers(0, 3, 7), np.round(rng.random(7), 1), rng.integers(0, 10**6, 7)
        h.push(row, score, name)
        for r, s, i in zip(row.tolist(), score.tolist(), name.tolist()):
            seen[r].append((-s, i))
    for r in range(3):
        assert [(-s, i) for s, i in zip(h.scores[r].tolist(), h.ids[r].tolist())] == sorted(seen[r])[:4]


def test_vector_files(spark, tmp_path):
    spark.dataSource.register(VectorFiles)
    x = np.random.default_rng(0).normal(size=(500, 6)).astype(np.float32)
    df = spark.createDataFrame([(f"id-{i}", x[i].tolist()) for i in range(500)], "id string, embedding array<float>").repartition(3)
    folder = str(tmp_path / "v")
    df.write.format("vectors").option("bytesPerFile", 1000).mode("overwrite").save(folder)
    meta = read_meta(folder)
    assert meta["rows"] == 500 and meta["dim"] == 6 and len(meta["parts"]) > 5 and meta["size_mb"] == round(500 * 24 / 1048576, 3)
    back = spark.read.format("vectors").option("rowsPerPartition", 7).load(folder)
    assert {r.id: r.embedding for r in back.collect()} == {f"id-{i}": x[i].tolist() for i in range(500)}
    df.limit(10).write.format("vectors").mode("append").save(folder)
    assert spark.read.format("vectors").load(folder).count() == 510
    df.limit(4).write.format("vectors").mode("overwrite").option("dtype", "float16").save(folder)
    assert spark.read.format("vectors").load(folder).count() == 4 and len([f for f in os.listdir(folder) if f.endswith(".npy")]) == len(read_meta(folder)["parts"])
    # what fails leaves the content as it was, and none of its files
    bad = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "id string, embedding array<float>")
    for rows in (bad.coalesce(1), bad.repartition(2), spark.createDataFrame([(None, [1.0])], "id string, embedding array<float>")):
        with pytest.raises(Exception):
            rows.write.format("vectors").mode("overwrite").save(folder)
    assert spark.read.format("vectors").load(folder).count() == 4


def test_plain_matrix_with_ids(spark, tmp_path):
    spark.dataSource.register(VectorFiles)
    x = np.arange(60, dtype=np.float16).reshape(20, 3)
    np.save(tmp_path / "vectors.npy", x)
    (tmp_path / "ids.txt").write_text("".join(f"акт#{i}\n" for i in range(20)))
    for rows in (3, 20, 100):
        got = {r.id: r.embedding for r in spark.read.format("vectors").option("rowsPerPartition", rows).load(str(tmp_path)).collect()}
        assert got == {f"акт#{i}": x[i].tolist() for i in range(20)}
    for n in (19, 21, 0):
        (tmp_path / "ids.txt").write_text("".join(f"акт#{i}\n" for i in range(n)))
        for rows in (3, 100):
            with pytest.raises(Exception, match="ids for"):
                spark.read.format("vectors").option("rowsPerPartition", rows).load(str(tmp_path)).collect()
    np.save(tmp_path / "vectors.npy", np.zeros((0, 4), np.float32))
    (tmp_path / "ids.txt").write_text("")
    assert spark.read.format("vectors").load(str(tmp_path)).count() == 0


def benchmark(spark, faulty=False):
    corpus = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    queries = spark.createDataFrame([(10, "q")], "query_id long, text string")
    qrels = spark.createDataFrame([(10, 1, 2)] + [(10, 99, 1), (11, 1, 1)] * faulty, "query_id long, doc_id long, grade int")
    return {"corpus": corpus, "queries": queries, "qrels": qrels}


def test_publish(spark, tmp_path):
    path = str(tmp_path / "p")
    first = publish.publish(spark, benchmark(spark), path, publish.benchmark_check)
    assert publish.current(spark, path) == first and publish.broken(spark, path) == []
    assert publish.manifest(spark, path)["tables"]["corpus"]["rows"] == 2
    with pytest.raises(publish.Refused) as e:
        publish.publish(spark, benchmark(spark, True), path, publish.benchmark_check)
    assert dict(e.value.faults) == {"unknown query": 1, "unknown document": 1}
    with pytest.raises(Exception):
        publish.publish(spark, {"corpus": spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))}, path)
    assert publish.current(spark, path) == first and sorted(os.listdir(tmp_path / "p" / "versions")) == [first]
    assert not [f for f in os.listdir(tmp_path / "p") if f.startswith("_staging")]
    second = publish.publish(spark, benchmark(spark) | {"corpus": spark.createDataFrame([(1, "c")], "doc_id long, text string")}, path, publish.benchmark_check)
    assert publish.current(spark, path) == second != first and publish.published(spark, path, "corpus").count() == 1
    spark.createDataFrame([(1, "d")], "doc_id long, text string").write.mode("overwrite").parquet(f"{path}/versions/{second}/corpus")
    assert publish.broken(spark, path) == ["corpus"]


def test_checksums_know_no_order(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, None, []), (2, None, [])], "k int, t string, v array<double>")
    sums = [df.repartition(n).agg(*publish.checksum(df)).first() for n in (1, 3)]
    assert sums[0] == sums[1] != df.distinct().agg(*publish.checksum(df)).first()


def test_report_in_the_pass_that_writes(spark, tmp_path):
    report, ran = Report(), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    rows = report.watch("rows", spark.range(100).mapInArrow(count, "id long"), n=F.count("*"), most=F.max("id"))
    rows.write.parquet(str(tmp_path / "r"))
    report.save(spark, str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text()) == {"rows": {"n": 100, "most": 99}} and ran.value == 100
    assert report.say() == "rows: n 100, most 99"
    with pytest.raises(ValueError):
        report.watch("rows", spark.range(1))


def test_append_new_computes_rows_once(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    rows = spark.range(50).selectExpr("id % 40 as k", "id").mapInArrow(count, "k long, id long")
    assert files.append_new(rows, str(tmp_path / "t"), ["k"]) == 40 and ran.value == 50
    assert files.append_new(rows, str(tmp_path / "t"), ["k"]) == 0 and spark.read.parquet(str(tmp_path / "t")).count() == 40


def test_text_files_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/a/CURRENT"
    for text in ("one", "двa", ""):
        durable.write_text(spark, path, text)
        assert durable.read_text(spark, path) == text
    assert [f for f in os.listdir(tmp_path / "a") if not f.endswith(".crc")] == ["CURRENT"]


def test_discovery(spark, tmp_path):
    for name, age in (("x/acts.jsonl", 50), ("deep/er/acts.jsonl", 10), ("y/acts.jsonl.gz", 5), ("deep/down/chunks.jsonl.gz", 9), ("z/z/chunks.jsonl.gz", 1), ("e/base/m/ids.txt", 1), ("e/fine/m/ids.txt", 1), ("f/base/m/ids.txt", 1)):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(gzip.compress(b"{}\n") if name.endswith("gz") else b"{}\n")
        os.utime(at, (time.time() - age, time.time() - age))
    names = spark.createDataFrame([("acts.jsonl",), ("acts.jsonl.gz",), ("chunks.jsonl",), ("none",)], "name string")
    rows = discovery.listing(spark, str(tmp_path))

    def ends(**more):
        return {r.name: r.path and r.path.split(tmp_path.name + "/")[1] for r in discovery.found(rows, names, **more).collect()}

    assert ends() == {"acts.jsonl": "x/acts.jsonl", "acts.jsonl.gz": "y/acts.jsonl.gz", "chunks.jsonl": "z/z/chunks.jsonl.gz", "none": None}
    assert ends(newest=True)["acts.jsonl"] == "deep/er/acts.jsonl"
    assert [(r.root.rsplit("/", 1)[1], r.n) for r in discovery.richest(rows).collect()] == [("e", 2)]
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString()


def test_a_killed_judging_run_goes_on(spark, tmp_path):
    words = [f"w{i}" for i in range(12)]
    texts = spark.createDataFrame([(q, d, " ".join(words[q : q + 4]), " ".join(words[d : d + 6])) for q in range(6) for d in range(5)], "query_id long, doc_id long, question string, text string")
    rng = random.Random(3)
    calls = [(q, d, f"2026-01-0{1 + rng.randrange(3)} 0{rng.randrange(10)}:00:00") for q in range(6) for d in range(5) for _ in range(3)] + [(77, 1, "2026-01-01 00:00:00")]
    rng.shuffle(calls)
    arrived = spark.createDataFrame(calls, "query_id long, doc_id long, t string").select("query_id", "doc_id", F.to_timestamp("t").alias("ts"))
    for i in range(4):
        arrived.where(F.pmod(F.xxhash64("ts", "doc_id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return judging.judged(judging.arriving(spark, str(tmp_path / "in"), "query_id long, doc_id long, ts timestamp", files_a_batch=1), texts, overlap_judge, lambda raw: grade(parse_answer(raw)))

    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    with pytest.raises(Exception):
        judging.run(stream(), table, state, fail_after=1)
    before = spark.read.parquet(table).count()
    assert 0 < before
    assert judging.run(stream(), table, state) >= 2
    rows = spark.read.parquet(table).collect()
    assert len(rows) == len({(r.query_id, r.doc_id) for r in rows}) == 30
    for r in rows:
        share = len(set(words[r.query_id : r.query_id + 4]) & set(words[r.doc_id : r.doc_id + 6])) / len(words[r.query_id : r.query_id + 4])
        assert r.grade == (2 if share >= 0.5 else 1 if share >= 0.25 else 0)
    assert judging.run(stream(), table, state) == 0 and spark.read.parquet(table).count() == 30
