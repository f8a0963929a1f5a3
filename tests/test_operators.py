"""Operators on hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import split_tokens
from gleaner.operators import bm25, chunking, curation, dense, judging, metrics, qrels, runs, stats
from gleaner.sources import files
from gleaner.streaming import judgements


def run_of(spark, lists):
    return spark.createDataFrame([(q, d, i + 1) for q, ds in lists.items() for i, d in enumerate(ds)], "query_id string, doc_id string, rank int")


def test_rrf(spark):
    fused = runs.rrf([run_of(spark, {"q": ["a", "b", "c"]}), run_of(spark, {"q": ["b", "c", "a"]})]).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == ["b", "a", "c"]
    both = runs.rrf([run_of(spark, {"q": ["x", "a"]}), run_of(spark, {"q": ["a"]})]).where("doc_id = 'a'").first()
    assert both.score == pytest.approx(1 / 61 + 1 / 62)
    tie = runs.rrf([run_of(spark, {"q": ["z"]}), run_of(spark, {"q": ["a"]})]).orderBy("rank").collect()
    assert [r.doc_id for r in tie] == ["z", "a"]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "резерв ссуда ссуда"), (2, "лицензия банк"), (3, "резерв банк лицензия отзыв"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(9, "резерв ссуда")], "query_id long, text string")
    index = bm25.build(docs)
    idf = {r.token: r.idf for r in index.terms.collect()}
    assert idf["ссуд"] == pytest.approx(math.log(3.5) - math.log(1.5)) and idf["резерв"] == pytest.approx(0)
    found = bm25.padded(bm25.scores(index, q, "query_id"), q, docs, "query_id", 3).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [1, 2, 3] and found[1].score == 0
    twice = bm25.scores(index, spark.createDataFrame([(9, "ссуда ссуда")], "query_id long, text string"), "query_id").first().score
    once = bm25.scores(index, spark.createDataFrame([(9, "ссуда")], "query_id long, text string"), "query_id").first().score
    assert twice == pytest.approx(2 * once, abs=1e-5)


def test_bm25_finds_other_forms_of_a_word(spark):
    docs = spark.createDataFrame([(1, "принципы оценки"), (2, "оценка риска"), (3, "порядок расчёта")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "принципами")], "query_id long, text string")
    assert [r.doc_id for r in bm25.scores(bm25.build(docs, keep=True), q, "query_id").collect()] == [1]
    assert bm25.scores(bm25.build(docs, split_tokens), q, "query_id", split_tokens).count() == 0


def test_bm25_term_counts_and_shuffled_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b a b c b a"), (2, ""), (3, None), (4, "c c")], "doc_id long, text string")
    index = bm25.build(docs)
    assert sorted((r.doc_id, r.dl, r.token, r.tf) for r in index.postings.collect()) == [(1, 6, "a", 2), (1, 6, "b", 3), (1, 6, "c", 1), (4, 2, "c", 2)]
    assert sorted((r.doc_id, r.dl) for r in index.docs.collect()) == [(1, 6), (2, 0), (3, 0), (4, 2)]
    q = spark.createDataFrame([(9, "a c"), (8, "b")], "query_id long, text string")
    few = sorted(map(tuple, bm25.scores(index, q, "query_id").collect()))
    monkeypatch.setattr(bm25, "MOST_TERMS", 1)
    assert len(few) == 3 and sorted(map(tuple, bm25.scores(index, q, "query_id").collect())) == few


def test_padding_ranks_before_negative_scores(spark):
    docs = spark.createDataFrame([(i, "") for i in range(30)], "doc_id long, text string")
    q = spark.createDataFrame([(9, ""), (8, "")], "query_id long, text string")
    scored = spark.createDataFrame([(9, i, -1.0) for i in range(25)] + [(9, 29, 2.0)], "query_id long, doc_id long, score double")
    got = {k: [r.doc_id for r in bm25.padded(scored, q, docs, "query_id", 4).where(f"query_id = {k}").orderBy("rank").collect()] for k in (8, 9)}
    assert got == {8: [0, 1, 2, 3], 9: [29, 25, 26, 27]}


def test_order_statistic(spark):
    v = spark.createDataFrame([("a", float(x)) for x in [5, 1, 1, 9, 3, 3, 3]] + [("b", 2.0), ("a", None)], "k string, x double")
    got = {r.k: (r.n, r.median, r.p) for r in stats.order_statistic(v, "k", "x", 0.8).collect()}
    assert got == {"a": (7, 3.0, 5.0), "b": (1, 2.0, 2.0)}


def test_metrics(spark):
    run = run_of(spark, {"q1": ["a", "b", "c"], "q2": ["x"], "q3": ["a"]})
    labels = spark.createDataFrame([("q1", "b", 2), ("q1", "z", 1), ("q2", "x", 0), ("q4", "a", 1)], "query_id string, doc_id string, grade int")
    got = {r.query_id: r for r in metrics.per_query(run, labels).collect()}
    assert set(got) == {"q1", "q2"}
    assert (got["q1"].recall_1, got["q1"].recall_5, got["q1"].mrr_10) == (0, 0.5, 0.5)
    assert got["q1"].ndcg_10 == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)), abs=1e-6)
    assert got["q2"].recall_10 is None and got["q2"].ndcg_10 is None and got["q2"].mrr_10 == 0


def test_statistics(spark):
    v = spark.createDataFrame([("m", i, float(i % 7)) for i in range(70)] + [("m", 99, None)], "metric string, query_id long, value double")
    ci = stats.bootstrap(v, "metric", "query_id").first()
    assert ci.n == 70 and ci.lo < ci.mean < ci.hi and ci == stats.bootstrap(v.repartition(5), "metric", "query_id").first()
    same = stats.paired(v, v, "metric", "query_id")
    assert stats.sign_flip_p(same, "metric", "query_id").first().p == 1
    exact = stats.bootstrap_numpy(v, "metric").first()
    assert exact.n == 70 and abs(exact.lo - ci.lo) < 0.2
    worse = stats.gate(same.withColumn("value", F.lit(-0.03)), "metric", "query_id").first()
    assert not worse.accepted and worse.established
    assert stats.gate(same.withColumn("value", F.lit(-0.019)), "metric", "query_id").first().accepted


def test_kappa(spark):
    def votes(a, b):
        return spark.createDataFrame([("q", str(i), x, y) for i, (x, y) in enumerate(zip(a, b))], "query_id string, doc_id string, a int, b int")

    assert judging.kappa(votes([0, 1, 2], [0, 1, 2])).first().kappa == 1
    assert judging.kappa(votes([0, 0, 1, 1], [0, 1, 0, 1])).first().kappa == 0
    assert judging.kappa(votes([1, 1], [1, 1])).first().kappa == 1
    far, near = votes([0, 2, 1, 0], [2, 2, 1, 0]), votes([0, 2, 1, 0], [1, 2, 1, 0])
    assert judging.kappa(far, True).first().kappa < judging.kappa(near, True).first().kappa


def spans_of(spark, rows):
    return spark.createDataFrame(rows, "id string, doc_id string, char_start int, char_end int")


BASE = [("A#0", "A", 0, 1000), ("A#1", "A", 850, 1850), ("A#2", "A", 1700, 2700), ("B#0", "B", 0, 500)]


def test_parents(spark):
    fine = spans_of(spark, [("f1", "A", 100, 400), ("f2", "A", 900, 1100), ("f3", "A", 850, 1000), ("f4", "A", 5000, 5100), ("f5", "C", 0, 10), ("f6", "B", 490, 700)])
    got = {r.id: r.parent for r in chunking.parents(fine, spans_of(spark, BASE)).collect()}
    assert got == {"f1": "A#0", "f2": "A#1", "f3": "A#0", "f4": "A#2", "f6": "B#0"}


def test_remap(spark):
    labels = spark.createDataFrame([("q", "A#0", 2), ("q", "A#1", 1), ("q", "X#9", 2)], "query_id string, doc_id string, grade int")
    base = spans_of(spark, BASE)
    same = qrels.remap(labels, base, base, 0.5).collect()
    assert {(r.doc_id, r.grade) for r in same} == {("A#0", 2), ("A#1", 1)}
    halves = spans_of(spark, [("h0", "A", 0, 500), ("h1", "A", 500, 1000), ("h2", "A", 1000, 1850)])
    got = {r.doc_id: r.grade for r in qrels.remap(labels, base, halves, 0.5).collect()}
    assert got == {"h0": 2, "h1": 1, "h2": 1}
    assert {r.reason: r.n for r in qrels.remap_losses(labels, base, spans_of(spark, [("z", "A", 0, 10)])).collect()} == {"unknown": 1, "lost": 1}


def test_structure_chunks(spark):
    lines = "\n".join(f"{i}. " + "слово " * 40 for i in range(1, 30))
    docs = spark.createDataFrame([(1, lines), (2, "x" * 9000), (3, ""), (4, None)], "doc_id long, text string")
    got = chunking.pack_units(chunking.parse_units(docs), 256).orderBy("doc_id", "position").collect()
    assert {r.doc_id for r in got} == {1, 2}
    assert all(len(r.text) <= 256 * 3.3 for r in got)
    first = [r for r in got if r.doc_id == 1]
    assert first[0].units.startswith("1–") and all(a.char_start <= b.char_start for a, b in zip(first, first[1:]))
    second = [r for r in got if r.doc_id == 2]
    assert second[0].char_start == 0 and second[-1].char_end == 9000


def test_headed_chunks(spark):
    lines = "Глава 1. Общие положения\n" + "\n".join(f"{i}. " + "слово " * 20 for i in range(1, 9)) + "\nПриложение 1 Форма\n1. " + "строка " * 400
    rows = [(1, lines, "УКАЗАНИЕ", "590-П", "28.06.2017", "О порядке"), (2, "коротко", "ПОЛОЖЕНИЕ", "1-П", "01.01.2020", "О" * 900), (3, "", "ПИСЬМО", "7-Т", "02.02.2002", "")]
    acts = spark.createDataFrame(rows, "doc_id long, text string, kind string, number string, date string, title string")
    units = chunking.parse_units(acts.select("doc_id", "text"))
    got = chunking.pack_units(chunking.headed(units, acts, 256), 256).orderBy("doc_id", "position").collect()
    first = [r for r in got if r.doc_id == 1]
    stem = "Указание Банка России № 590-П от 28.06.2017. О порядке"
    assert {r.section for r in first} == {"Глава 1. Общие положения", "Приложение 1. Форма"}
    assert all(r.text.startswith(f"{stem}. {r.section}\n\n") for r in first)
    assert all(len(r.text) <= 256 * 3.2 + 8 for r in got)
    # every character of the units is in a chunk
    covered = set().union(*(range(r.char_start, r.char_end) for r in first))
    assert all(set(range(u.start, u.end)) <= covered for u in units.where("doc_id = 1").collect())
    (second,) = (r for r in got if r.doc_id == 2)
    assert second.text.endswith("О…\n\nкоротко") and len(second.text) < 256 * 3.2 * 0.5 and {r.doc_id for r in got} == {1, 2}
    none = chunking.pack_units(chunking.headed(units, acts, 256, section=False), 256).where("doc_id = 1").collect()
    assert all(r.text.startswith(stem + "\n\n") for r in none)
    windows = chunking.headed_windows(acts, 256).orderBy("doc_id", "position").collect()
    assert all(r.text.startswith((stem + "\n\n", "Положение Банка России № 1-П")) for r in windows) and windows[0].char_start == 0


def test_chunk_beyond_its_cap_is_trimmed(spark):
    docs = spark.createDataFrame([(1, "x" * 800)], "doc_id long, text string")
    (r,) = chunking.pack_units(chunking.parse_units(docs), 256).collect()  # 250 tokens by length, 267 by offsets
    assert (r.char_end, len(r.text)) == (253 * 3, 253 * 3)


def test_build_corpus(spark):
    wanted = spark.createDataFrame([("1-П", "01.01.2020", "А", i) for i in ("v1", "v2", "v3")] + [("2-П", "01.01.2020", "Б", "v1"), ("3-П", "01.01.2020", "В", "v1"), ("4-П", "01.01.2020", "Г", "v9")], "number string, date string, title string, issue string")
    found = spark.createDataFrame([("v3", "1-П", "поздний"), ("v2", "1-П", "текст " * 100), ("v1", "2-П", "мал"), ("v1", "3-П", "latin text"), ("v1", "8-П", "чужой")], "issue string, number string, text string")
    got = {r.number: (r.issue, r.chars, r.reason) for r in curation.build_corpus(wanted, found).collect()}
    assert got == {"1-П": ("v2", 600, None), "2-П": ("v1", 3, "слишком короткий"), "3-П": ("v1", 10, "мало кириллицы")}


def test_named_only(spark):
    scored = spark.createDataFrame([(q, d, 1.0) for q in (1, 2, 3) for d in (10, 11)], "query_id int, doc_id int, score double")
    named = spark.createDataFrame([(1, "a"), (1, "zz"), (2, "zz")], "query_id int, number string")
    docs = spark.createDataFrame([(10, "a"), (11, "b"), (12, None)], "doc_id int, number string")
    got = sorted((r.query_id, r.doc_id) for r in bm25.named_only(scored, named, docs, "query_id").collect())
    assert got == [(1, 10), (2, 10), (2, 11), (3, 10), (3, 11)]


def test_split_of_null_stratum_and_weight(spark):
    acts = spark.createDataFrame([(i, None if i % 2 else "a", None if i % 10 == 0 else 1) for i in range(400)], "doc_id long, kind string, size int")
    got = curation.split_acts(acts, "kind", "size", {"dev": 0.25}).collect()
    assert len(got) == 400 and len({r.doc_id for r in got}) == 400
    for kind in (None, "a"):
        held = sum(1 for r in got if r.kind == kind and r.part == "dev" and r.doc_id % 10)
        whole = sum(1 for r in got if r.kind == kind and r.doc_id % 10)
        assert held == -(-whole // 4)


def test_qrels_jsonl(spark, tmp_path):
    from gleaner.sources import files

    (tmp_path / "q.jsonl").write_text('{"query-id": "q1", "corpus-id": "c1", "score": 1}\n\n{"query-id": "q1", "corpus-id": "c2", "score": 0}\n{"query-id": "q1", "corpus-id": "c1", "score": 2}\n')
    assert [tuple(r) for r in files.read_qrels_jsonl(spark, str(tmp_path / "q.jsonl")).collect()] == [("q1", "c1", 2)]


def test_dense(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    got = dense.top_k(v.where("vec_id = 0"), v, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2] and got[1].score == pytest.approx(0.6)
    assert v.where("vec_id = 2").select(dense.unit(F.col("embedding"))).first()[0] == [0.0, 0.0]
    assert dense.top_k(v.limit(0), v, 3).count() == 0


def test_negatives_and_journal(spark):
    rows = [("q", "g", 0, 3.0, "g", 0, 1, 3.0, True), ("q", "g", 0, 3.0, "a", 0, 2, -1.0, True), ("q", "g", 0, 3.0, "b", 1, 3, -1.0, False), ("q", "g", 0, 3.0, "c", 1, 4, 2.0, True)]
    rows += [("q", "g", 0, 3.0, d, 2, p, -2.0, True) for d, p in (("d", 5), ("e", 6), ("f", 7))]
    df = spark.createDataFrame(rows, "query_id string, gold string, gold_act int, gold_score double, doc_id string, act int, place int, score double, train boolean")
    got = {r.doc_id: r.reason for r in curation.pick_negatives(df).collect()}
    assert got == {"g": "gold", "a": "same act", "b": "not a training act", "c": "score too high", "d": "kept", "e": "kept", "f": "surplus"}
    assert curation.negative_columns(curation.pick_negatives(df)).first()[1:] == ("d", "e")
    folded = curation.journal([{"tag": "a", "values": {1: 0.5}}, {"tag": "b", "values": {1: 0.4}}, {"tag": "c", "values": {1: 0.6}}, {"tag": "b", "values": {1: 0.59}}])
    assert [(e["tag"], e["verdict"], e["compared_with"]) for e in folded] == [("a", "accepted", None), ("c", "accepted", "a"), ("b", "accepted", "c")]


def test_split_has_no_leaks(spark):
    acts = spark.createDataFrame([(i, f"k{i % 3}", 10 + i % 5) for i in range(300)], "doc_id long, kind string, n int")
    parts = curation.split_acts(acts, "kind", "n", {"dev": 0.1, "test": 0.05})
    counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sum(counts.values()) == 300 and 25 <= counts["dev"] <= 40 and counts["test"] >= 10
    assert curation.in_several_groups(parts).count() == 0


def test_files_round_trip(spark, tmp_path):
    run = run_of(spark, {"q1": ["a", "b"], "q2": ["c"]})
    files.write_run(run, str(tmp_path), "base", "dense:bge+rerank")
    back = files.read_runs(spark, str(tmp_path), "base").orderBy("query_id", "rank").collect()
    assert [(r.run, r.query_id, r.doc_id, r["rank"]) for r in back] == [("dense-bge-rerank", "q1", "a", 1), ("dense-bge-rerank", "q1", "b", 2), ("dense-bge-rerank", "q2", "c", 1)]
    labels = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 0)], "query_id string, doc_id string, grade int")
    files.write_qrels(labels, str(tmp_path / "qrels"))
    assert [tuple(r) for r in files.read_qrels(spark, str(tmp_path / "qrels")).collect()] == [("q1", "a", 2)]
    path = str(tmp_path / "table")
    assert files.append_new(labels, path, ["query_id", "doc_id"]) == 2 and files.append_new(labels, path, ["query_id", "doc_id"]) == 0


def test_streaming_judgements(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"query_id": "q", "chunk_id": "c", "grade": 2, "ts": "2026-01-01T00:00:00"}\n{"query_id": "q", "chunk_id": "c", "grade": 1, "ts": "2026-01-01T00:00:01"}\n{"query_id": "q", "chunk_id": "d", "grade": 1, "ts": "2026-01-01T00:00:02"}\n')
    out = str(tmp_path / "out")
    judgements.sink(judgements.judgements(spark, str(src)), out, str(tmp_path / "state")).awaitTermination()
    (src / "b.json").write_text('{"query_id": "q", "chunk_id": "d", "grade": 1, "ts": "2026-01-01T00:00:03"}\n')
    judgements.sink(judgements.judgements(spark, str(src)), out, str(tmp_path / "state")).awaitTermination()
    assert sorted((r.query_id, r.chunk_id) for r in spark.read.parquet(out).collect()) == [("q", "c"), ("q", "d")]
