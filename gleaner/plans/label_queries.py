"""Queries of pools, judges, labels, splits and training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import curation, judging, qrels, runs
from gleaner.plans.base import (
    Literal, chunks, documents, judges, query, questions, read, run_stems, run_words, spans, text_qrels, first_of_label, graded_run, vector_run, vectors,
)

POOL = """
tagged AS (SELECT query_id, doc_id, rank, 'a' AS run FROM run_words WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, rank, 'b' FROM run_stems WHERE rank <= 10),
seen AS (SELECT query_id, doc_id, min(rank * 2 + (run = 'b')::INT) AS s FROM tagged GROUP BY ALL),
pool AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s) AS place, CASE WHEN s % 2 = 1 THEN 'b' ELSE 'a' END AS run FROM seen) WHERE place <= 14)"""


def pooled(spark, d):
    return runs.pool({"a": run_words(spark, d), "b": run_stems(spark, d)})


@query("h1_round_robin_pool", "WITH" + POOL + " SELECT query_id, doc_id, place, run FROM pool")
def _(spark, d):
    return pooled(spark, d)


@query("h2_covered_queries", "SELECT DISTINCT query_id FROM run_words WHERE query_id IN (SELECT query_id FROM run_stems) AND query_id IN (SELECT query_id FROM qrels)")
def _(spark, d):
    return runs.common_queries([run_words(spark, d), run_stems(spark, d), text_qrels(spark, d)])


@query("h3_shuffled_pool", "WITH" + POOL + " SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('17|' || query_id || '|' || doc_id), doc_id) AS place FROM pool")
def _(spark, d):
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("query_id").orderBy(curation.shuffled(F.col("query_id"), F.col("doc_id")), "doc_id"))
    return pooled(spark, d).select("query_id", "doc_id", order.alias("place"))


@query("h4_exhaustive_pool", """
WITH t AS (SELECT query_id, doc_id, rank, CASE WHEN rank <= 10 THEN 1 ELSE 2 END AS prio FROM run_words UNION ALL SELECT query_id, doc_id, rank, 3 FROM run_stems)
SELECT query_id, doc_id, min(prio) AS prio, min(rank) AS best, count(*) AS found FROM t GROUP BY ALL""")
def _(spark, d):
    a = run_words(spark, d).select("query_id", "doc_id", "rank", F.when(F.col("rank") <= 10, 1).otherwise(2).alias("prio"))
    b = run_stems(spark, d).select("query_id", "doc_id", "rank", F.lit(3).alias("prio"))
    return a.union(b).groupBy("query_id", "doc_id").agg(F.min("prio").alias("prio"), F.min("rank").alias("best"), F.count("*").alias("found"))


@query("h5_label_provenance", "WITH" + POOL + """
SELECT p.query_id, p.doc_id, CASE WHEN q.grade IS NOT NULL THEN 'clause' WHEN a.a IS NOT NULL THEN 'judge' WHEN b.b = 2 THEN 'gold' ELSE '-' END AS origin, coalesce(q.grade, a.a, CASE WHEN b.b = 2 THEN 2 END) AS grade
FROM pool p LEFT JOIN qrels q USING (query_id, doc_id) LEFT JOIN judge_a a ON a.doc_id = p.doc_id LEFT JOIN judge_b b ON b.doc_id = p.doc_id""")
def _(spark, d):
    a, b = judges(spark, d)
    p = pooled(spark, d).join(text_qrels(spark, d), ["query_id", "doc_id"], "left").join(a, "doc_id", "left").join(b, "doc_id", "left")
    gold = F.when(F.col("b") == 2, 2)
    origin = F.when(F.col("grade").isNotNull(), "clause").when(F.col("a").isNotNull(), "judge").when(gold.isNotNull(), "gold").otherwise("-")
    return p.select("query_id", "doc_id", origin.alias("origin"), F.coalesce("grade", "a", gold).alias("grade"))


@query("h6_first_row_texts", "WITH" + POOL + " SELECT p.query_id, p.doc_id, p.place, CASE WHEN place = 1 THEN md5(text) END AS question FROM pool p JOIN benchmark b ON b.item_id = p.query_id")
def _(spark, d):
    return pooled(spark, d).join(questions(spark, d), "query_id").select("query_id", "doc_id", "place", F.when(F.col("place") == 1, F.md5(F.col("text").cast("binary"))).alias("question"))


@query("h7_coverage_by_depth", """
WITH r AS (SELECT 'a' AS run, * FROM run_words UNION ALL SELECT 'b', * FROM run_stems), k AS (SELECT unnest([10, 50]) AS depth)
SELECT run, depth, count(*) AS places, count(q.grade) AS labelled FROM r JOIN k ON r.rank <= k.depth LEFT JOIN qrels q USING (query_id, doc_id) GROUP BY run, depth""")
def _(spark, d):
    r = run_words(spark, d).withColumn("run", F.lit("a")).unionByName(run_stems(spark, d).withColumn("run", F.lit("b")))
    at = r.withColumn("depth", F.explode(F.when(F.col("rank") <= 10, F.array(F.lit(10), F.lit(50))).otherwise(F.array(F.lit(50)))))
    return at.join(text_qrels(spark, d), ["query_id", "doc_id"], "left").groupBy("run", "depth").agg(F.count("*").alias("places"), F.count("grade").alias("labelled"))


@query("h9_judged_pairs", "SELECT query_id, doc_id FROM qrels UNION SELECT query_id, doc_id FROM run_words WHERE rank <= 3")
def _(spark, d):
    return text_qrels(spark, d).select("query_id", "doc_id").union(run_words(spark, d, 3).select("query_id", "doc_id")).distinct()


RAW = Literal("id int, raw string", [
    (1, "1: да\n2: -\nтип: -"), (2, "1: нет\n2: да\nтип: часть"), (3, "1: нет\n2: нет\nтип: -"), (4, "нет да тип: общая норма"), (5, "Вопрос 1: нет\nвопрос 2: да\nтип: что-то"),
    (6, "да"), (7, "не знаю"), (8, "1: нет 2: да тип: иное"), (9, ""), (10, "1) ДА"),
])
PARSED = Literal("id int, whole boolean, together boolean, kind string, grade int", [
    (1, True, False, "-", 2), (2, False, True, "часть", 1), (3, False, False, "-", 0), (4, False, True, "общая", 1), (5, False, True, "-", 1),
    (6, None, None, None, None), (7, None, None, None, None), (8, False, True, "иное", 1), (9, None, None, None, None), (10, True, False, "-", 2),
])


@query("f1_f2_parse_answers", f"SELECT * FROM {PARSED.sql}")
def _(spark, d):
    a = RAW.df(spark).withColumn("a", judging.parse_answer(F.col("raw")))
    return a.select("id", "a.whole", "a.together", "a.kind", judging.grade(F.col("a")).alias("grade"))


SHEET = Literal("line int, query_id string, chunk_id string, grade int", [(1, "q1", "c1", 2), (2, "q1", "c1", 0), (3, "q1", "c2", None), (4, None, "c3", 1), (5, "q2", "c1", 1)])


@query("f3_clean_sheet", f"SELECT line, query_id, chunk_id, grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY line) AS r FROM {SHEET.sql} WHERE grade IS NOT NULL AND query_id IS NOT NULL) WHERE r = 1")
def _(spark, d):
    return judging.cleaned(SHEET.df(spark))


def votes(spark, d):
    a, b = judges(spark, d)
    return judging.vote(a.select(F.lit(1).alias("query_id"), "doc_id", F.col("a").alias("grade")), b.select(F.lit(1).alias("query_id"), "doc_id", F.col("b").alias("grade")))


@query("f4_vote", """
SELECT doc_id, a, b, CASE WHEN b IS NULL THEN 'only a' WHEN a IS NULL THEN 'only b' WHEN a = b THEN 'agreed' ELSE 'disputed' END AS verdict FROM judge_a FULL JOIN judge_b USING (doc_id)""")
def _(spark, d):
    return votes(spark, d).drop("query_id")


@query("f4_confusion", "SELECT a, count(*) FILTER (b = 0) AS b0, count(*) FILTER (b = 1) AS b1, count(*) FILTER (b = 2) AS b2 FROM judge_a JOIN judge_b USING (doc_id) GROUP BY a")
def _(spark, d):
    return judging.confusion(votes(spark, d))


_KAPPA = """
WITH v AS (SELECT a, b FROM judge_a JOIN judge_b USING (doc_id)), n AS (SELECT count(*) AS n, greatest(max(a), max(b)) - least(min(a), min(b)) AS span FROM v),
o AS (SELECT sum({w}) / any_value(n) AS o FROM v, n), e AS (SELECT sum({w} * ca * cb) / any_value(n * n) AS e FROM (SELECT a, count(*) AS ca FROM v GROUP BY a), (SELECT b, count(*) AS cb FROM v GROUP BY b), n)
SELECT n, round(CASE WHEN e = 0 THEN CASE WHEN o = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - o / e END, 6) AS kappa FROM n, o, e"""


@query("f5_kappa", _KAPPA.format(w="(a <> b)::INT::DOUBLE"))
def _(spark, d):
    return judging.kappa(votes(spark, d))


@query("f5_kappa_weighted", _KAPPA.format(w="pow((a - b) / greatest(span, 1)::DOUBLE, 2)"))
def _(spark, d):
    return judging.kappa(votes(spark, d), weighted=True)


KAPPAS = Literal("k double", [(-0.1,), (0.0,), (0.19,), (0.2,), (0.41,), (0.6,), (0.8,), (1.0,)])


@query("f7_kappa_verdict", f"""
SELECT k, CASE WHEN k < 0 THEN 'хуже случайного' WHEN k < 0.2 THEN 'ничтожное согласие' WHEN k < 0.4 THEN 'слабое согласие' WHEN k < 0.6 THEN 'умеренное согласие' WHEN k < 0.8 THEN 'существенное согласие'
 ELSE 'почти полное согласие' END AS verdict FROM {KAPPAS.sql}""")
def _(spark, d):
    return KAPPAS.df(spark).select("k", judging.kappa_verdict(F.col("k")).alias("verdict"))


@query("f8_stratified_sample", """
WITH s AS (SELECT greatest(1, floor(60 / greatest(1, count(DISTINCT lang)))) AS share FROM documents), p AS (SELECT doc_id, lang, md5('13|' || doc_id) AS o, row_number() OVER (PARTITION BY lang ORDER BY md5('13|' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, lang FROM p, s ORDER BY (r > share)::INT, o, doc_id LIMIT 60""")
def _(spark, d):
    return judging.stratified(documents(spark, d).select("doc_id", "lang"), "lang", "doc_id", 60)


@query("f9_judge_acceptance", _KAPPA.format(w="(a <> b)::INT::DOUBLE").replace("SELECT n, round(", "SELECT n, kappa, kappa >= 0.40 AS accepted FROM (SELECT n, round(") + ")")
def _(spark, d):
    return judging.kappa(votes(spark, d)).withColumn("accepted", F.col("kappa") >= 0.40)


@query("f10_transitions", "SELECT a AS old, b AS new, count(*) AS n, CASE WHEN b > a THEN 'raised' WHEN b < a THEN 'lowered' ELSE 'same' END AS move FROM judge_a JOIN judge_b USING (doc_id) GROUP BY ALL")
def _(spark, d):
    v = votes(spark, d).where("a is not null and b is not null")
    move = F.when(F.col("b") > F.col("a"), "raised").when(F.col("b") < F.col("a"), "lowered").otherwise("same")
    return v.groupBy(F.col("a").alias("old"), F.col("b").alias("new"), move.alias("move")).agg(F.count("*").alias("n"))


@query("f11_judge_candidates", """
WITH v AS (SELECT lang, avg((a = b)::INT::DOUBLE) AS agree, count(*) AS n FROM judge_a JOIN judge_b USING (doc_id) JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, n, round(agree, 6) AS agree, agree >= 0.3 AS above, lang = (SELECT arg_max(lang, (round(agree, 9), lang)) FROM v) AS best FROM v""")
def _(spark, d):
    """Agreement by group, the bar, and the best one by agreement then name."""
    v = votes(spark, d).where("a is not null and b is not null").join(documents(spark, d).select("doc_id", "lang"), "doc_id")
    v = v.groupBy("lang").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("agree"), F.count("*").alias("n"))
    best = v.agg(F.max_by("lang", F.struct(F.round("agree", 9), "lang")).alias("top"))
    return v.crossJoin(F.broadcast(best)).select("lang", "n", F.round("agree", 6).alias("agree"), (F.col("agree") >= 0.3).alias("above"), (F.col("lang") == F.col("top")).alias("best"))


@query("f12_cost_projection", "WITH" + POOL + ", n AS (SELECT count(*) AS pairs FROM pool) SELECT rate, pairs, round(pairs / rate / 3600, 6) AS hours FROM n, (SELECT unnest([0.289, 1.0, 4.0]::DOUBLE[]) AS rate)")
def _(spark, d):
    n = pooled(spark, d).agg(F.count("*").alias("pairs"))
    rates = F.explode(F.array(F.lit(0.289), F.lit(1.0), F.lit(4.0)))
    return n.select(rates.alias("rate"), "pairs").withColumn("hours", F.round(F.col("pairs") / F.col("rate") / 3600, 6))


def judged(spark, d):
    """A judge's grades of the pooled pairs."""
    a, _ = judges(spark, d)
    return pooled(spark, d).join(a, "doc_id").select("query_id", "doc_id", F.col("a").alias("grade"))


_JUDGED = POOL + ", judged AS (SELECT p.query_id, p.doc_id, a.a AS grade FROM pool p JOIN judge_a a ON a.doc_id = p.doc_id)"


@query("i1_apply_judge", "WITH" + _JUDGED + """,
m AS (SELECT query_id, doc_id, coalesce(q.grade, j.grade) AS grade FROM judged j FULL JOIN qrels q USING (query_id, doc_id))
SELECT query_id, doc_id, grade FROM m WHERE grade > 0 AND query_id IN (SELECT query_id FROM m WHERE grade = 2)""")
def _(spark, d):
    return qrels.apply_judge(judged(spark, d), text_qrels(spark, d))


@query("i2_apply_pool_judge", "WITH" + _JUDGED + """, old AS (SELECT query_id, doc_id, 1 AS grade FROM run_words WHERE rank <= 2)
SELECT query_id, doc_id, coalesce(c.grade, o.grade, j.grade) AS grade FROM old o FULL JOIN (SELECT * FROM judged WHERE grade > 0) j USING (query_id, doc_id) FULL JOIN qrels c USING (query_id, doc_id)""")
def _(spark, d):
    old = run_words(spark, d, 2).select("query_id", "doc_id", F.lit(1).alias("grade"))
    return qrels.apply_pool_judge(old, judged(spark, d), text_qrels(spark, d))


ROUTES = Literal("id int, act string, clauses array<string>", [(1, "590-П", ["3.1"]), (2, "590-П", []), (3, None, ["3.1"]), (4, "611-П", ["9.9"]), (5, "590-П", ["7.7"])])
HAS = Literal("act string, clause string", [("590-П", "3.1"), ("590-П", "3.2"), ("611-П", "1.1")])


@query("i3_clause_routing", f"""
SELECT id, CASE WHEN act IS NULL THEN 'отброшен' WHEN EXISTS (SELECT 1 FROM {HAS.sql} h WHERE h.act = r.act AND list_contains(r.clauses, h.clause)) THEN 'по пунктам' ELSE 'в пул' END AS route FROM {ROUTES.sql} r""")
def _(spark, d):
    r = ROUTES.df(spark)
    named = r.select("id", "act", F.explode("clauses").alias("clause")).join(F.broadcast(HAS.df(spark)), ["act", "clause"], "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    route = F.when(F.col("act").isNull(), "отброшен").when(F.col("hit"), "по пунктам").otherwise("в пул")
    return r.join(named, "id", "left").select("id", route.alias("route"))


_GOLD = "gold AS (SELECT item_id AS query_id, printf('%d#%04d', item_id, item_id % 2) AS chunk_id FROM benchmark)"


def gold_chunks(spark, d):
    return questions(spark, d).select("query_id", F.format_string("%d#%04d", "query_id", F.col("query_id") % 2).alias("doc_id"))


@query("i4_same_act_grades", f"""
WITH {_GOLD}, one AS (SELECT g.query_id, b.chunk_id AS doc_id, 1 AS grade FROM gold g JOIN chunks a USING (chunk_id) JOIN chunks b ON a.doc_id = b.doc_id AND a.char_start < b.char_end AND b.char_start < a.char_end
  WHERE least(a.char_end, b.char_end) - greatest(a.char_start, b.char_start) >= 0.10 * (a.char_end - a.char_start))
SELECT query_id, doc_id, max(grade) AS grade FROM (SELECT * FROM one UNION ALL SELECT query_id, chunk_id, 2 FROM gold) GROUP BY ALL""")
def _(spark, d):
    return qrels.same_act_grades(gold_chunks(spark, d), chunks(spark, d), 0.10)


@query("i4_review_neighbours", f"""
WITH {_GOLD}, near AS (SELECT g.query_id, a.chunk_id AS gold, b.chunk_id, abs(a.position - b.position) AS distance, greatest(0, least(a.char_end, b.char_end) - greatest(a.char_start, b.char_start)) AS shared, a.char_end - a.char_start AS span
 FROM gold g JOIN chunks a USING (chunk_id) JOIN chunks b ON a.doc_id = b.doc_id AND a.chunk_id <> b.chunk_id AND abs(a.position - b.position) <= 2),
r AS (SELECT query_id, gold, chunk_id, distance, row_number() OVER (PARTITION BY query_id, gold ORDER BY distance, chunk_id) AS place FROM near WHERE shared < 0.30 * span)
SELECT query_id, chunk_id AS doc_id, distance, place FROM r WHERE place <= 4""")
def _(spark, d):
    """Chunks next to a gold one that share too little of it for a grade: what people should look at."""
    rows = chunks(spark, d).withColumn("section", F.lit(""))
    return qrels.review_neighbours(gold_chunks(spark, d), rows).select("query_id", "doc_id", "distance", "place")


@query("i4_merged_sources", "WITH" + _JUDGED + """,
t AS (SELECT query_id, doc_id, grade, 0 AS s FROM qrels UNION ALL SELECT query_id, doc_id, grade, 1 FROM judged UNION ALL SELECT query_id, doc_id, 1, 2 FROM run_words WHERE rank = 1)
SELECT query_id, doc_id, arg_min(grade, s) AS grade FROM t GROUP BY ALL HAVING arg_min(grade, s) > 0""")
def _(spark, d):
    first = run_words(spark, d, 1).select("query_id", "doc_id", F.lit(1).alias("grade"))
    return qrels.merged([text_qrels(spark, d), judged(spark, d), first])


@query("i5_vanished_pairs", "SELECT query_id, doc_id FROM run_words WHERE rank <= 10 EXCEPT SELECT query_id, doc_id FROM run_stems WHERE rank <= 10")
def _(spark, d):
    return qrels.vanished(run_words(spark, d, 10), run_stems(spark, d, 10))


_SUBSETS = "subsets AS (SELECT 'all' AS subset, item_id AS query_id FROM benchmark UNION ALL SELECT 'even', item_id FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'long', item_id FROM benchmark WHERE length(text) > 300)"


def subsets(spark, d):
    """Overlapping subsets as rows: all questions, those with even ids, long ones."""
    q = questions(spark, d)
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("query_id") % 2 == 0, "even"), F.when(F.length("text") > 300, "long")))
    return q.select(F.explode(names).alias("subset"), "query_id")


@query("i6_subsets", f"WITH {_SUBSETS} SELECT subset, count(*) AS n FROM subsets GROUP BY subset")
def _(spark, d):
    return subsets(spark, d).groupBy("subset").agg(F.count("*").alias("n"))


@query("i7_subset_stats", f"WITH {_SUBSETS} SELECT subset, count(DISTINCT query_id) AS n_queries, count(*) AS n_pairs, round(count(*) / count(DISTINCT query_id), 6) AS pairs_per_query FROM subsets JOIN qrels USING (query_id) GROUP BY subset")
def _(spark, d):
    return qrels.subset_stats(text_qrels(spark, d), subsets(spark, d))


_CHUNK_QRELS = "old AS (SELECT item_id AS query_id, printf('%d#%04d', item_id, item_id % 3) AS id, 1 + item_id % 2 AS grade FROM benchmark)"


def chunk_qrels(spark, d):
    return questions(spark, d).select("query_id", F.format_string("%d#%04d", "query_id", F.col("query_id") % 3).alias("doc_id"), (1 + F.col("query_id") % 2).cast("int").alias("grade"))


@query("i8_remap", f"""
WITH {_CHUNK_QRELS}, hit AS (SELECT o.query_id, o.id, o.grade, b.chunk_id AS doc_id, least(a.char_end, b.char_end) - greatest(a.char_start, b.char_start) AS shared, a.char_end - a.char_start AS len, b.char_start,
  (a.char_start = b.char_start AND a.char_end = b.char_end)::INT AS exact FROM old o JOIN chunks a ON a.chunk_id = o.id JOIN fine b ON a.doc_id = b.doc_id AND a.char_start < b.char_end AND b.char_start < a.char_end),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY exact DESC, shared DESC, char_start, doc_id DESC) AS r, max(exact) OVER (PARTITION BY query_id, id) AS any_exact FROM hit),
n AS (SELECT query_id, doc_id, CASE WHEN r = 1 THEN grade WHEN any_exact = 0 AND grade >= 2 AND shared >= 0.3 * len THEN 1 END AS g FROM r)
SELECT query_id, doc_id, CAST(max(g) AS INTEGER) AS grade FROM n WHERE g IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return qrels.remap(chunk_qrels(spark, d), spans(spark, d), spans(spark, d, 256), 0.3)


@query("i8_remap_losses", f"""
WITH {_CHUNK_QRELS} SELECT 'unknown' AS reason, count(*) AS n FROM old WHERE id NOT IN (SELECT chunk_id FROM chunks)
UNION ALL SELECT 'lost', count(*) FROM old WHERE id IN (SELECT chunk_id FROM chunks) AND id NOT IN (SELECT a.chunk_id FROM chunks a JOIN fine b ON a.doc_id = b.doc_id AND a.char_start < b.char_end AND b.char_start < a.char_end)""")
def _(spark, d):
    return qrels.remap_losses(chunk_qrels(spark, d), spans(spark, d), spans(spark, d, 256))


@query("i9_histogram", """
WITH e AS (SELECT unnest([0.0, 100.0, 500.0, 1000.0, 2000.0, 4000.0, 1000000.0]::DOUBLE[]) AS lo, unnest([100.0, 500.0, 1000.0, 2000.0, 4000.0, 1000000.0, 2000000.0]::DOUBLE[]) AS hi)
SELECT lo, hi, count(n_chars) AS n FROM e LEFT JOIN documents ON n_chars >= lo AND n_chars < hi GROUP BY lo, hi""")
def _(spark, d):
    return qrels.histogram(documents(spark, d).select(F.col("n_chars").cast("double").alias("v")), "v", [0.0, 100.0, 500.0, 1000.0, 2000.0, 4000.0, 1_000_000.0, 2_000_000.0])


@query("i10_one_act_numbers", "SELECT number, min(doc_id) AS doc_id FROM (SELECT doc_id, source || '-' || (n_chars // 200) AS number FROM documents) GROUP BY number HAVING count(DISTINCT doc_id) = 1")
def _(spark, d):
    acts = documents(spark, d).select("doc_id", F.concat("source", F.lit("-"), F.floor(F.col("n_chars") / 200)).alias("number"))
    return qrels.one_act_numbers(acts)


@query("i10_act_hits", """
WITH h AS (SELECT r.query_id, max((rank <= 1)::INT) AS a1, max((rank <= 10)::INT) AS a10, max((rank <= 50)::INT) AS a50 FROM run_words r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = r.query_id JOIN documents g ON g.doc_id = b.item_id AND g.source = d.source GROUP BY r.query_id),
q AS (SELECT DISTINCT query_id FROM run_words)
SELECT round(avg(coalesce(a1, 0)), 6) AS act_1, round(avg(coalesce(a10, 0)), 6) AS act_10, round(avg(coalesce(a50, 0)), 6) AS act_50 FROM q LEFT JOIN h USING (query_id)""")
def _(spark, d):
    """A weak label: the source of the document with the question's number; a hit is any document of it."""
    docs = documents(spark, d).select("doc_id", "source")
    run = run_words(spark, d).select("query_id", "doc_id", "rank")
    gold = docs.select(F.col("doc_id").alias("query_id"), F.col("source").alias("want"))
    hit = run.join(docs, "doc_id").join(gold, "query_id").where("source = want").groupBy("query_id").agg(*(F.max((F.col("rank") <= k).cast("int")).alias(f"a{k}") for k in (1, 10, 50)))
    both = run.select("query_id").distinct().join(hit, "query_id", "left")
    return both.agg(*(F.round(F.avg(F.coalesce(f"a{k}", F.lit(0))), 6).alias(f"act_{k}") for k in (1, 10, 50)))


@query("i11_corpus_ceiling", "SELECT lang, count(*) AS n, count(*) FILTER (l.doc_id IS NOT NULL) AS bound, count(*) FILTER (l.doc_id IS NULL) AS unbound FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def _(spark, d):
    l = read(spark, d, "labels").select("doc_id", F.lit(1).alias("has"))
    return documents(spark, d).join(l, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("has").alias("bound"), F.count_if(F.col("has").isNull()).alias("unbound"))


_KEY = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query("i12_fewshot_filter", f"""
SELECT md5(key) AS key FROM (SELECT DISTINCT {_KEY} AS key FROM conversations WHERE role = 'user') WHERE length(key) BETWEEN 80 AND 700 AND key NOT IN (SELECT {_KEY} FROM benchmark)""")
def _(spark, d):
    from gleaner.functions.text import question_key

    key = question_key(F.col("text")).alias("key")
    mine = read(spark, d, "conversations").where("role = 'user'").select(key).distinct().where("length(key) between 80 and 700")
    return mine.join(questions(spark, d).select(key), "key", "left_anti").select(F.md5(F.col("key").cast("binary")).alias("key"))


@query("i13_manual_task", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('17|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS size FROM documents)
SELECT doc_id, lang, row_number() OVER (ORDER BY r, size DESC, lang) AS place FROM r ORDER BY r, size DESC, lang LIMIT 100""")
def _(spark, d):
    """A sheet of 100 documents dealt round robin over the kinds, large kinds first. No kind can give more than 100, so each task keeps that many of a kind."""
    from pyspark.sql import Window

    docs = documents(spark, d).select("doc_id", "lang")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(curation.shuffled(F.col("doc_id")), "doc_id"))
    few = docs.withColumn("r", order).where(F.col("r") <= 100)
    sizes = docs.groupBy("lang").agg(F.count("*").alias("size"))
    top = few.join(sizes, few["lang"].eqNullSafe(sizes["lang"])).select(few["doc_id"], few["lang"], "r", "size").orderBy("r", F.desc("size"), "lang").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy("r", F.desc("size"), "lang"))).select("doc_id", "lang", "place")


@query("i14_blind_sample", "WITH" + POOL + " SELECT query_id, doc_id FROM pool ORDER BY md5('17|' || query_id || '|' || doc_id), query_id, doc_id LIMIT 50")
def _(spark, d):
    order = curation.shuffled(F.col("query_id"), F.col("doc_id"))
    return pooled(spark, d).select("query_id", "doc_id").orderBy(order, "query_id", "doc_id").limit(50)


# --- splits and training data ---

SHARES = {"dev": 0.08, "test": 0.04}
_SPLIT = """
placed AS (SELECT doc_id, lang, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY md5('17|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_chars) OVER (PARTITION BY lang) AS total FROM documents),
split AS (SELECT doc_id, lang, CASE WHEN before < 0.08::DOUBLE * total THEN 'dev' WHEN before < 0.12::DOUBLE * total THEN 'test' ELSE 'train' END AS part FROM placed)"""


def split(spark, d):
    return curation.split_acts(documents(spark, d).select("doc_id", "lang", "n_chars"), "lang", "n_chars", SHARES)


@query("j1_split_acts", "WITH" + _SPLIT + " SELECT doc_id, lang, part FROM split")
def _(spark, d):
    return split(spark, d)


@query("j2_in_several_groups", "WITH" + _SPLIT + ", g AS (SELECT doc_id, part FROM split UNION ALL SELECT doc_id, 'live' FROM labels WHERE toxic = 1) SELECT doc_id, count(DISTINCT part) AS n FROM g GROUP BY doc_id HAVING count(DISTINCT part) > 1")
def _(spark, d):
    live = read(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("live").alias("part"))
    return curation.in_several_groups(split(spark, d).select("doc_id", "part").union(live))


@query("j3_leaked_acts", "WITH" + _SPLIT + " SELECT doc_id FROM split WHERE part = 'train' INTERSECT SELECT doc_id FROM run_words WHERE rank = 1")
def _(spark, d):
    return curation.leaked(split(spark, d).where("part = 'train'"), run_words(spark, d, 1))


@query("j4_outside_group", "WITH" + _SPLIT + " SELECT q.query_id, coalesce(s.part, 'нет в сплите') AS part FROM (SELECT item_id AS query_id, item_id * 7 AS doc_id FROM benchmark) q LEFT JOIN split s USING (doc_id) WHERE coalesce(s.part, 'нет в сплите') <> 'train'")
def _(spark, d):
    q = questions(spark, d).select("query_id", (F.col("query_id") * 7).alias("doc_id"))
    return curation.outside_group(q, split(spark, d), "train")


@query("j5_build_pairs", """
WITH q AS (SELECT conv_id * 100 + turn AS query_id, conv_id * 2 AS doc_id, text FROM conversations WHERE role = 'user'),
s AS (SELECT q.query_id, q.text, CASE WHEN d.text IS NULL THEN 'no gold' WHEN trim(d.text) = '' THEN 'blank gold' END AS reason FROM q LEFT JOIN documents d USING (doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY reason, text ORDER BY query_id) AS n FROM s)
SELECT query_id, CASE WHEN reason IS NULL AND n > 1 THEN 'repeated' ELSE coalesce(reason, 'kept') END AS reason FROM n""")
def _(spark, d):
    c = read(spark, d, "conversations").where("role = 'user'")
    return curation.build_pairs(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), (F.col("conv_id") * 2).alias("doc_id"), "text"), documents(spark, d))


@query("j6_referential_faults", """
WITH g AS (SELECT r.query_id, r.doc_id, q.label = c.label AS good FROM run_full r JOIN embeddings q ON q.vec_id = r.query_id JOIN embeddings c ON c.vec_id = r.doc_id)
SELECT 'unknown query' AS "check", count(*) AS n FROM g WHERE query_id % 100 = 50
UNION ALL SELECT 'unknown document', count(*) FROM g WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
UNION ALL SELECT 'no positive', count(*) FROM embeddings WHERE vec_id % 100 = 0 AND vec_id NOT IN (SELECT query_id FROM g WHERE good)""")
def _(spark, d):
    """The labels of a run, held against half of its queries and two thirds of the documents."""
    q = vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    return curation.referential_faults(q, documents(spark, d).where("doc_id % 3 <> 0").select("doc_id"), graded_run(spark, d))


_CANDIDATES = """
gold AS (SELECT q.vec_id AS query_id, min(v.vec_id) AS gold FROM embeddings q JOIN embeddings v ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id),
cand AS (SELECT r.query_id, r.doc_id, r.rank AS place, 8 * r.score - 2 AS score, g.gold, e.label AS act, ge.label AS gold_act, 3.0::DOUBLE AS gold_score, r.doc_id % 3 <> 0 AS train
  FROM run_full r JOIN gold g USING (query_id) JOIN embeddings e ON e.vec_id = r.doc_id JOIN embeddings ge ON ge.vec_id = g.gold),
ruled AS (SELECT *, CASE WHEN doc_id = gold THEN 'gold' WHEN NOT train THEN 'not a training act' WHEN act = gold_act THEN 'same act' WHEN 1 / (1 + exp(-score)) >= 0.5 THEN 'score too high' WHEN 1 / (1 + exp(-score)) >= 1 / (1 + exp(-gold_score)) - 0.10 THEN 'close to gold' END AS r FROM cand),
picked AS (SELECT *, CASE WHEN r IS NULL AND sum((r IS NULL)::INT) OVER (PARTITION BY query_id ORDER BY place) > 2 THEN 'surplus' ELSE coalesce(r, 'kept') END AS reason FROM ruled)"""


def candidates(spark, d, shift=2.0):
    v = vectors(spark, d).select(F.col("vec_id").alias("doc_id"), "label")
    gold = first_of_label(spark, d)
    run = vector_run(spark, d).select("query_id", "doc_id", F.col("rank").alias("place"), (8 * F.col("score") - shift).alias("score"))
    run = run.join(gold, "query_id").join(v.withColumnRenamed("label", "act"), "doc_id")
    return run.join(v.select(F.col("doc_id").alias("gold"), F.col("label").alias("gold_act")), "gold").withColumn("gold_score", F.lit(3.0)).withColumn("train", F.col("doc_id") % 3 != 0)


@query("j9_pick_negatives", "WITH" + _CANDIDATES + " SELECT query_id, doc_id, place, reason FROM picked")
def _(spark, d):
    return curation.pick_negatives(candidates(spark, d)).select("query_id", "doc_id", "place", "reason")


@query("j10_negative_stats", "WITH" + _CANDIDATES + " SELECT reason, count(*) AS n, count(DISTINCT query_id) AS queries FROM picked GROUP BY reason")
def _(spark, d):
    return curation.pick_negatives(candidates(spark, d)).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))


@query("j7_negative_columns", "WITH" + _CANDIDATES + ", k AS (SELECT query_id, list(doc_id ORDER BY place) AS n FROM picked WHERE reason = 'kept' GROUP BY query_id) SELECT query_id, n[1] AS negative_1, n[2] AS negative_2 FROM k WHERE len(n) >= 2")
def _(spark, d):
    return curation.negative_columns(curation.pick_negatives(candidates(spark, d)))


_WEAKER = _CANDIDATES.replace("8 * r.score - 2 AS score", "8 * r.score - 5 AS score")


@query("j7_negative_columns_weaker", "WITH" + _WEAKER + ", k AS (SELECT query_id, list(doc_id ORDER BY place) AS n FROM picked WHERE reason = 'kept' GROUP BY query_id) SELECT query_id, n[1] AS negative_1, n[2] AS negative_2 FROM k WHERE len(n) >= 2")
def _(spark, d):
    """The same with a judge that gives candidates less, so that there are negatives to lay out."""
    return curation.negative_columns(curation.pick_negatives(candidates(spark, d, 5.0)))


@query("j15_train_report", "WITH" + _WEAKER + "," + _SPLIT + """,
u AS (SELECT conv_id * 2 AS doc_id, text, conv_id * 100 + turn AS query_id FROM conversations WHERE role = 'user'),
s AS (SELECT u.query_id, u.text, CASE WHEN d.text IS NULL THEN 'no gold' WHEN trim(d.text) = '' THEN 'blank gold' END AS reason FROM u LEFT JOIN documents d USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY reason, text ORDER BY query_id) AS o FROM s)
SELECT 'split' AS part, part AS state, count(*) AS n FROM split GROUP BY ALL
UNION ALL SELECT 'pairs', CASE WHEN reason IS NULL AND o > 1 THEN 'repeated' ELSE coalesce(reason, 'kept') END AS state, count(*) FROM o GROUP BY ALL
UNION ALL SELECT 'negatives', reason AS state, count(*) FROM picked GROUP BY ALL
UNION ALL SELECT 'leaked', 'in train and a run', count(*) AS n FROM (SELECT doc_id FROM split WHERE part = 'train' INTERSECT SELECT doc_id FROM run_words WHERE rank = 1) HAVING count(*) > 0""")
def _(spark, d):
    """Splits, pairs, negatives and leaks of the training data in one table."""
    groups, c = split(spark, d), read(spark, d, "conversations").where("role = 'user'")
    pairs = curation.build_pairs(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), (F.col("conv_id") * 2).alias("doc_id"), "text"), documents(spark, d))
    leaks = curation.leaked(groups.where("part = 'train'"), run_words(spark, d, 1))
    return curation.train_report(
        split=groups.select(F.col("part").alias("state")), pairs=pairs.select(F.col("reason").alias("state")),
        negatives=curation.pick_negatives(candidates(spark, d, 5.0)).select(F.col("reason").alias("state")), leaked=leaks.select(F.lit("in train and a run").alias("state")),
    )


@query("j8_only_train_acts", "WITH" + _SPLIT + ", s AS (SELECT doc_id FROM run_words WHERE rank <= 3) SELECT count(*) AS outside FROM s WHERE doc_id NOT IN (SELECT doc_id FROM split WHERE part = 'train')")
def _(spark, d):
    train = split(spark, d).where("part = 'train'").select("doc_id")
    return run_words(spark, d, 3).join(train, "doc_id", "left_anti").agg(F.count("*").alias("outside"))


@query("j11_distill_lists", """
WITH gold AS (SELECT query_id, min(doc_id) AS gold FROM qrels GROUP BY query_id), c AS (SELECT query_id, gold, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM run_stems JOIN gold USING (query_id) WHERE doc_id <> gold)
SELECT query_id, array_to_string(list_prepend(gold, list(doc_id ORDER BY r) FILTER (r <= 4)), ',') AS docs FROM c GROUP BY query_id, gold HAVING count(*) FILTER (r <= 4) = 4""")
def _(spark, d):
    """The gold document first, then the next candidates, exactly five documents a question."""
    from pyspark.sql import Window

    gold = text_qrels(spark, d).groupBy("query_id").agg(F.min("doc_id").alias("gold"))
    c = run_stems(spark, d).join(gold, "query_id").where("doc_id <> gold").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("r <= 4")
    lists = c.groupBy("query_id", "gold").agg(F.sort_array(F.collect_list(F.struct("r", "doc_id")))["doc_id"].alias("rest")).where(F.size("rest") == 4)
    return lists.select("query_id", F.array_join(F.concat(F.array("gold"), "rest"), ",").alias("docs"))


@query("j12_teacher_filter", """
WITH gold AS (SELECT query_id, min(doc_id) AS doc_id FROM qrels GROUP BY query_id) SELECT g.query_id, r.rank AS place FROM gold g JOIN run_words r USING (query_id, doc_id) WHERE r.rank <= 5""")
def _(spark, d):
    gold = text_qrels(spark, d).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return gold.join(run_words(spark, d, 10), ["query_id", "doc_id"]).where("rank <= 5").select("query_id", F.col("rank").alias("place"))


@query("j13_gold_places", """
WITH gold AS (SELECT query_id, min(doc_id) AS doc_id FROM qrels GROUP BY query_id), p AS (SELECT r.rank FROM gold JOIN run_words r USING (query_id, doc_id))
SELECT count(*) AS n, quantile_cont(rank, 0.5) AS median_place, round(avg((rank = 1)::INT::DOUBLE), 6) AS first_share FROM p""")
def _(spark, d):
    gold = text_qrels(spark, d).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    p = gold.join(run_words(spark, d), ["query_id", "doc_id"])
    return p.agg(F.count("*").alias("n"), F.percentile("rank", 0.5).alias("median_place"), F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("first_share"))


@query("j14_capped_per_act", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 12")
def _(spark, d):
    return curation.capped(documents(spark, d).select("doc_id", "source"), "source", ["doc_id"])


@query("j19_forgetting_sample", """
SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM qrels) THEN '' ELSE md5('17|' || doc_id) END AS o FROM documents ORDER BY o, doc_id LIMIT greatest(300, (SELECT count(DISTINCT doc_id) FROM qrels)))""")
def _(spark, d):
    return curation.forgetting_sample(documents(spark, d).select("doc_id"), text_qrels(spark, d), 300).select("doc_id")
