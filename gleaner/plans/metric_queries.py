"""Queries of metrics, statistics and diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions.text import split_tokens
from gleaner.operators import metrics, stats
from gleaner.plans.base import documents, grade_totals, graded_run, judges, query, questions, read, run_stems, run_words, text_qrels, texts_of, vector_run
from gleaner.plans.label_queries import _SUBSETS, subsets


def metric_sql(run: str, qrels: str, name: str) -> str:
    """CTE `name`: query_id with the metrics of a run, six decimals."""
    return f"""
{name} AS (WITH q AS (SELECT DISTINCT query_id FROM {run} WHERE query_id IN (SELECT query_id FROM {qrels})),
 ideal AS (SELECT query_id, count(*) AS good, sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS i FROM {qrels} WHERE grade > 0) GROUP BY query_id),
 hit AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) FILTER (rank <= 10) AS f, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg
   FROM {run} JOIN (SELECT * FROM {qrels} WHERE grade > 0) USING (query_id, doc_id) GROUP BY query_id)
 SELECT query_id, round(coalesce(h1, 0) / good, 6) AS recall_1, round(coalesce(h5, 0) / good, 6) AS recall_5, round(coalesce(h10, 0) / good, 6) AS recall_10, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr_10, round(coalesce(dcg, 0) / nullif(idcg, 0), 6) AS ndcg_10
 FROM q LEFT JOIN ideal USING (query_id) LEFT JOIN hit USING (query_id))"""


def text_metrics(spark, d, run=run_words, qrels=None):
    return metrics.per_query(run(spark, d), text_qrels(spark, d) if qrels is None else qrels)


def vector_metrics(spark, d, dim=0):
    return metrics.per_query_counted(graded_run(spark, d, dim), grade_totals(spark, d))


@query("l1_l5_metrics_text", "WITH" + metric_sql("run_words", "qrels", "m") + " SELECT * FROM m")
def _(spark, d):
    return text_metrics(spark, d)


@query("l1_l5_metrics_vectors", "WITH" + metric_sql("run_full", "vqrels", "m") + " SELECT * FROM m")
def _(spark, d):
    return vector_metrics(spark, d)


@query("l4_metrics_unpivoted", "WITH" + metric_sql("run_half", "vqrels", "m") + " SELECT query_id, metric, value FROM m UNPIVOT INCLUDE NULLS (value FOR metric IN (recall_1, recall_5, recall_10, mrr_10, ndcg_10))")
def _(spark, d):
    return metrics.unpivoted(vector_metrics(spark, d, 32))


def _draw(n: str, *parts: str) -> str:
    return f"""(('0x' || substring(md5({" || '|' || ".join(parts)}), 1, 8))::UBIGINT % {n})"""


def boot_sql(source: str, seed: int = 7) -> str:
    """CTEs of a bootstrap over `source`(by, key, value): placed, ci."""
    return f"""
placed AS (SELECT by_, row_number() OVER (PARTITION BY by_ ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY by_) AS n, value FROM {source} WHERE value IS NOT NULL),
picks AS (SELECT by_, rep, {_draw('n', str(seed), 'rep', 'i')} AS j FROM placed, (SELECT unnest(range(10000)) AS rep)),
means AS (SELECT k.by_, k.rep, avg(p.value) AS m FROM picks k JOIN placed p ON p.by_ = k.by_ AND p.i = k.j GROUP BY ALL),
centre AS (SELECT by_, count(*) AS n, round(avg(value), 6) AS mean FROM placed GROUP BY by_),
ci AS (SELECT c.by_, c.n, c.mean, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM means JOIN centre c USING (by_) GROUP BY ALL)"""


_LONG = "x AS (SELECT metric AS by_, query_id AS key, value FROM m UNPIVOT (value FOR metric IN (recall_10, mrr_10, ndcg_10)))"
_DIFF = """x AS (SELECT a.metric AS by_, a.query_id AS key, a.value - b.value AS value FROM (SELECT * FROM m UNPIVOT (value FOR metric IN (recall_10, mrr_10, ndcg_10))) a
 JOIN (SELECT * FROM h UNPIVOT (value FOR metric IN (recall_10, mrr_10, ndcg_10))) b USING (query_id, metric))"""
THREE = ("recall_10", "mrr_10", "ndcg_10")


def long_metrics(spark, d, dim=0):
    return metrics.unpivoted(vector_metrics(spark, d, dim), THREE)


@query("l6_bootstrap", "WITH" + metric_sql("run_full", "vqrels", "m") + ", " + _LONG + "," + boot_sql("x") + " SELECT by_ AS metric, n, mean, lo, hi FROM ci")
def _(spark, d):
    return stats.bootstrap(long_metrics(spark, d), "metric", "query_id")


@query("l6_bootstrap_numpy")
def _(spark, d):
    return stats.bootstrap_numpy(long_metrics(spark, d), "metric")


@query("l7_unpaired_diff", "WITH" + metric_sql("run_words", "qrels", "m") + "," + metric_sql("run_words", "qrels", "m2") + """,
x AS (SELECT 'mrr' AS by_, query_id AS key, mrr_10 AS value FROM m WHERE query_id % 2 = 0), y AS (SELECT 'mrr' AS by_, query_id AS key, mrr_10 AS value FROM m2 WHERE query_id % 2 = 1),""" + boot_sql("x") + "," + boot_sql("y", 8).replace("placed", "placed2").replace("picks", "picks2").replace("means", "means2").replace("centre", "centre2").replace("ci AS", "ci2 AS") + """
SELECT round((SELECT avg(value) FROM placed) - (SELECT avg(value) FROM placed2), 6) AS diff, round(quantile_cont(means.m - means2.m, 0.025), 6) AS lo, round(quantile_cont(means.m - means2.m, 0.975), 6) AS hi, 'mrr' AS metric FROM means JOIN means2 USING (rep)""")
def _(spark, d):
    """Two groups of questions, those with even and odd ids, compared by their reciprocal ranks."""
    m = text_metrics(spark, d).select(F.lit("mrr").alias("metric"), "query_id", F.col("mrr_10").alias("value"))
    return stats.unpaired_diff(m.where("query_id % 2 = 0"), m.where("query_id % 2 = 1"), "metric", "query_id")


@query("l8_paired_diff", "WITH" + metric_sql("run_full", "vqrels", "m") + "," + metric_sql("run_half", "vqrels", "h") + ", " + _DIFF + "," + boot_sql("x") + f""",
signed AS (SELECT by_, rep, abs(avg(CASE WHEN {_draw('2', '11', 'rep', 'i')} = 0 THEN value ELSE -value END)) AS m FROM placed, (SELECT unnest(range(10000)) AS rep) GROUP BY ALL),
real_ AS (SELECT by_, abs(avg(value)) AS r FROM placed GROUP BY by_),
p AS (SELECT by_, round(avg((m >= r - 1e-12)::INT::DOUBLE), 6) AS p FROM signed JOIN real_ USING (by_) GROUP BY by_)
SELECT by_ AS metric, n, mean, lo, hi, p FROM ci JOIN p USING (by_)""")
def _(spark, d):
    diff = stats.paired(long_metrics(spark, d), long_metrics(spark, d, 32), "metric", "query_id")
    return stats.bootstrap(diff, "metric", "query_id").join(stats.sign_flip_p(diff, "metric", "query_id"), "metric")


@query("l9_gate", "WITH" + metric_sql("run_full", "vqrels", "m") + "," + metric_sql("run_half", "vqrels", "h") + ", " + _DIFF + "," + boot_sql("x") + """
SELECT by_ AS metric, n, mean, lo, hi, mean >= -0.02 AS accepted, lo > 0 OR hi < 0 AS established, round((hi - lo) / 2, 6) AS detectable FROM ci""")
def _(spark, d):
    return stats.gate(stats.paired(long_metrics(spark, d), long_metrics(spark, d, 32), "metric", "query_id"), "metric", "query_id")


@query("l10_metrics_report", f"WITH {_SUBSETS}," + metric_sql("run_words", "qrels", "m") + "," + metric_sql("run_stems", "qrels", "h") + """,
l AS (SELECT 'words' AS run, * FROM m UNPIVOT INCLUDE NULLS (value FOR metric IN (recall_1, recall_5, recall_10, mrr_10, ndcg_10)) UNION ALL SELECT 'stems', * FROM h UNPIVOT INCLUDE NULLS (value FOR metric IN (recall_1, recall_5, recall_10, mrr_10, ndcg_10)))
SELECT run, subset, metric, count(*) AS n, round(avg(value), 6) AS mean FROM l JOIN subsets USING (query_id) WHERE query_id IN (SELECT query_id FROM run_words) AND query_id IN (SELECT query_id FROM run_stems) GROUP BY ALL HAVING count(*) >= 5""")
def _(spark, d):
    both = run_words(spark, d).withColumn("run", F.lit("words")).unionByName(run_stems(spark, d).withColumn("run", F.lit("stems")))
    return metrics.report(both.select("run", "query_id", "doc_id", "rank"), text_qrels(spark, d), subsets(spark, d), least=5)


@query("l11_depth_ceiling", """
WITH g AS (SELECT query_id, count(*) AS good FROM qrels WHERE grade > 0 GROUP BY query_id), k AS (SELECT unnest([10, 50, 100, 200]) AS depth),
h AS (SELECT query_id, depth, count(*) AS hit FROM deep_stems JOIN qrels USING (query_id, doc_id) JOIN k ON rank <= depth WHERE grade > 0 GROUP BY ALL)
SELECT depth, count(*) AS n, round(avg(coalesce(hit, 0) / good), 6) AS recall FROM g CROSS JOIN k LEFT JOIN h USING (query_id, depth) GROUP BY depth""")
def _(spark, d):
    q = text_qrels(spark, d).where("grade > 0")
    good = q.groupBy("query_id").agg(F.count("*").alias("good"))
    depths = F.explode(F.array(*(F.lit(k) for k in (10, 50, 100, 200)))).alias("depth")
    hit = run_stems(spark, d, 200).join(q, ["query_id", "doc_id"]).select("query_id", "rank", depths).where("rank <= depth").groupBy("query_id", "depth").agg(F.count("*").alias("hit"))
    both = good.select("query_id", "good", depths).join(hit, ["query_id", "depth"], "left")
    return both.groupBy("depth").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0)) / F.col("good")), 6).alias("recall"))


_GAP = """
gap AS (SELECT r.query_id, r.doc_id, r.rank, round(len(list_intersect(list_distinct(q.tokens), t.tokens)) / len(list_distinct(q.tokens)), 6) AS share
  FROM {run} r JOIN questok q USING (query_id) JOIN doctok t USING (doc_id))"""


def lexical_gap(spark, d, pairs):
    """pairs with the share of a question's distinct tokens that the document holds."""
    q = questions(spark, d).select("query_id", F.array_distinct(split_tokens(F.col("text"))).alias("q"))
    t = texts_of(documents(spark, d), pairs).select("doc_id", split_tokens(F.col("text")).alias("t"))
    return pairs.join(q, "query_id").join(t, "doc_id").withColumn("share", F.round(F.size(F.array_intersect("q", "t")) / F.size("q"), 6)).drop("q", "t")


@query("l12_lexical_gap", "WITH" + _GAP.format(run="run_words") + ", f AS (SELECT query_id, share AS first_share FROM gap WHERE rank = 1), g AS (SELECT query_id, max(share) AS gold_share FROM gap JOIN qrels USING (query_id, doc_id) GROUP BY query_id) SELECT query_id, first_share, gold_share FROM f LEFT JOIN g USING (query_id)")
def _(spark, d):
    gap = lexical_gap(spark, d, run_words(spark, d).select("query_id", "doc_id", "rank"))
    first = gap.where("rank = 1").select("query_id", F.col("share").alias("first_share"))
    gold = gap.join(text_qrels(spark, d), ["query_id", "doc_id"]).groupBy("query_id").agg(F.max("share").alias("gold_share"))
    return first.join(gold, "query_id", "left")


@query("l13_length_effect", "WITH" + metric_sql("run_full", "vqrels", "m") + "," + metric_sql("run_half", "vqrels", "h") + """,
t AS (SELECT m.query_id, m.ndcg_10 - h.ndcg_10 AS gap, least(2, (row_number() OVER (ORDER BY m.query_id) - 1) // greatest(1, count(*) OVER () // 3)) AS third FROM m JOIN h USING (query_id) WHERE m.ndcg_10 IS NOT NULL AND h.ndcg_10 IS NOT NULL)
SELECT third, count(*) AS n, round(avg(gap), 6) AS gap FROM t GROUP BY third""")
def _(spark, d):
    """Equal thirds in an order (the remainder goes to the last), the gap between two runs in each. One row a labelled query: a bounded table."""
    a, b = vector_metrics(spark, d), vector_metrics(spark, d, 32)
    both = a.select("query_id", F.col("ndcg_10").alias("x")).join(b.select("query_id", F.col("ndcg_10").alias("y")), "query_id").where("x is not null and y is not null")
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(F.lit(1))) / 3))
    third = F.least(F.lit(2), F.floor((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("query_id")) - 1) / n))
    return both.withColumn("third", third).groupBy("third").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x") - F.col("y")), 6).alias("gap"))


@query("l14_l15_difference_of_differences", "WITH" + metric_sql("run_full", "vqrels", "m") + "," + metric_sql("run_half", "vqrels", "h") + """
SELECT round(avg((m.ndcg_10 - h.ndcg_10) - (m.mrr_10 - h.mrr_10)), 6) AS dd, count(*) AS n FROM m JOIN h USING (query_id) WHERE m.ndcg_10 IS NOT NULL AND h.ndcg_10 IS NOT NULL""")
def _(spark, d):
    a, b = vector_metrics(spark, d), vector_metrics(spark, d, 32).toDF("query_id", "r1", "r5", "r10", "mrr_b", "ndcg_b")
    both = a.join(b, "query_id").where("ndcg_10 is not null and ndcg_b is not null")
    return both.agg(F.round(F.avg((F.col("ndcg_10") - F.col("ndcg_b")) - (F.col("mrr_10") - F.col("mrr_b"))), 6).alias("dd"), F.count("*").alias("n"))


@query("l16_variant_effect", "WITH" + metric_sql("run_words", "qrels", "m") + "," + metric_sql("run_stems", "qrels", "h") + """,
q AS (SELECT item_id AS query_id, regexp_matches(text, '[0-9]') AS with_number FROM benchmark)
SELECT with_number, count(*) AS n, round(avg(m.mrr_10 - h.mrr_10), 6) AS effect FROM m JOIN h USING (query_id) JOIN q USING (query_id) GROUP BY with_number""")
def _(spark, d):
    qrels = text_qrels(spark, d)  # both runs are held against the same labels
    a, b = text_metrics(spark, d, run_words, qrels), text_metrics(spark, d, run_stems, qrels)
    q = questions(spark, d).select("query_id", F.col("text").rlike("[0-9]").alias("with_number"))
    both = a.select("query_id", "mrr_10").join(b.select("query_id", F.col("mrr_10").alias("y")), "query_id").join(q, "query_id")
    return both.groupBy("with_number").agg(F.count("*").alias("n"), F.round(F.avg(F.col("mrr_10") - F.col("y")), 6).alias("effect"))


@query("l17_tokenizer_vocabulary", "SELECT 'words' AS tokenizer, count(DISTINCT token) AS vocabulary FROM tok UNION ALL SELECT 'prefix-6', count(DISTINCT substring(token, 1, 6)) FROM tok")
def _(spark, d):
    t = documents(spark, d).select(F.explode(split_tokens(F.col("text"))).alias("token"))
    a = t.agg(F.countDistinct("token").alias("vocabulary")).select(F.lit("words").alias("tokenizer"), "vocabulary")
    return a.union(t.agg(F.countDistinct(F.substring("token", 1, 6)).alias("vocabulary")).select(F.lit("prefix-6"), "vocabulary"))


@query("l17_prefix_collisions", "SELECT substring(token, 1, 6) AS stem, count(DISTINCT token) AS words FROM tok GROUP BY stem HAVING count(DISTINCT token) > 1")
def _(spark, d):
    t = documents(spark, d).select(F.explode(split_tokens(F.col("text"))).alias("token")).distinct()
    return t.groupBy(F.substring("token", 1, 6).alias("stem")).agg(F.count("*").alias("words")).where("words > 1")


_FAIL = "WITH" + _GAP.format(run="run_words") + """,
best AS (SELECT q.item_id AS query_id, min(r.rank) FILTER (g.grade > 0) AS place, count(DISTINCT g.doc_id) AS good FROM benchmark q LEFT JOIN qrels g ON g.query_id = q.item_id LEFT JOIN run_words r ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY q.item_id),
top AS (SELECT query_id, share FROM gap WHERE rank = 1),
f AS (SELECT query_id, CASE WHEN good = 0 THEN 'not in corpus' WHEN place IS NOT NULL THEN 'almost found' WHEN good > 1 THEN 'needs several' WHEN share < 0.25 THEN 'synonymy' ELSE 'manual' END AS cause FROM best LEFT JOIN top USING (query_id) WHERE place IS NULL OR place > 10)"""


def failures(spark, d):
    q = questions(spark, d).select("query_id").join(text_qrels(spark, d).where("grade > 0"), "query_id", "left")
    run = run_words(spark, d).select("query_id", "doc_id", "rank")
    best = q.join(run, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("place"), F.countDistinct("doc_id").alias("good"))
    top = lexical_gap(spark, d, run.where("rank = 1")).select("query_id", "share")
    cause = (
        F.when(F.col("good") == 0, "not in corpus").when(F.col("place").isNotNull(), "almost found").when(F.col("good") > 1, "needs several")
        .when(F.col("share") < 0.25, "synonymy").otherwise("manual")
    )
    return best.join(top, "query_id", "left").where("place is null or place > 10").select("query_id", cause.alias("cause"))


@query("l18_failure_causes", _FAIL + " SELECT query_id, cause FROM f")
def _(spark, d):
    return failures(spark, d)


@query("l19_failure_summary", _FAIL + " SELECT cause, count(*) AS n FROM f GROUP BY cause")
def _(spark, d):
    return failures(spark, d).groupBy("cause").agg(F.count("*").alias("n"))


@query("l20_candidate_table", "WITH" + metric_sql("run_full", "vqrels", "m") + "," + metric_sql("run_half", "vqrels", "h") + """
SELECT 'half' AS candidate, count(*) AS n, round(avg(h.ndcg_10), 6) AS ndcg, round(avg(m.ndcg_10), 6) AS baseline, round(avg(h.ndcg_10) - avg(m.ndcg_10), 6) AS diff FROM m JOIN h USING (query_id)""")
def _(spark, d):
    a, b = vector_metrics(spark, d), vector_metrics(spark, d, 32)
    both = a.select("query_id", F.col("ndcg_10").alias("x")).join(b.select("query_id", F.col("ndcg_10").alias("y")), "query_id")
    return both.agg(F.lit("half").alias("candidate"), F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("ndcg"), F.round(F.avg("x"), 6).alias("baseline"), F.round(F.avg("y") - F.avg("x"), 6).alias("diff"))


@query("l21_verdict_changes", "SELECT doc_id, a AS old, b AS new FROM judge_a JOIN judge_b USING (doc_id) WHERE a <> b")
def _(spark, d):
    from gleaner.plans.base import judges

    a, b = judges(spark, d)
    return a.join(b, "doc_id").where("a <> b").select("doc_id", F.col("a").alias("old"), F.col("b").alias("new"))


@query("l22_latency", """
WITH m AS (SELECT user_id, event_type, quantile_cont(value, 0.5) AS v FROM events GROUP BY ALL), s AS (SELECT event_type, list(v ORDER BY v) AS l, quantile_cont(v, 0.5) AS median FROM m GROUP BY event_type)
SELECT event_type, len(l) AS n, round(median, 6) AS median, round(l[CAST(round_even(0.95 * (len(l) - 1), 0) AS BIGINT) + 1], 6) AS p FROM s""")
def _(spark, d):
    """The median of each user's timings, then the median and the 95 % order statistic over users."""
    m = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.percentile("value", 0.5).alias("v"))
    return stats.order_statistic(m, "event_type", "v").select("event_type", "n", F.round("median", 6).alias("median"), F.round("p", 6).alias("p"))


@query("l23_length_stats", "SELECT role, count(*) AS n, quantile_cont(length(text), 0.5) AS median, max(length(text)) AS longest, round(avg(length(text)), 6) AS mean FROM conversations GROUP BY role")
def _(spark, d):
    n = F.length("text")
    return read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.percentile(n, 0.5).alias("median"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean"))


@query("l24_control_by_type", "WITH" + metric_sql("run_words", "qrels", "m") + """
SELECT CASE WHEN length(text) > 300 THEN 'long' ELSE 'short' END AS kind, count(*) AS n, round(avg(ndcg_10), 6) AS ndcg, round(avg(mrr_10), 6) AS mrr FROM m JOIN benchmark b ON b.item_id = m.query_id GROUP BY kind""")
def _(spark, d):
    q = questions(spark, d).select("query_id", F.when(F.length("text") > 300, "long").otherwise("short").alias("kind"))
    return text_metrics(spark, d).join(q, "query_id").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("ndcg_10"), 6).alias("ndcg"), F.round(F.avg("mrr_10"), 6).alias("mrr"))


@query("h8_pool_upper_bound", "WITH virtual AS (SELECT query_id, doc_id, max(grade) AS grade FROM (SELECT * FROM qrels UNION ALL SELECT query_id, doc_id, 2 FROM run_words WHERE rank <= 10) GROUP BY ALL)," + metric_sql("run_words", "qrels", "m") + "," + metric_sql("run_words", "virtual", "h") + """
SELECT m.query_id, m.ndcg_10 AS low, h.ndcg_10 AS high FROM m JOIN h USING (query_id)""")
def _(spark, d):
    """The metric with the labels there are, and if all unlabelled places of the first ten were relevant."""
    run, q = run_words(spark, d), text_qrels(spark, d)
    virtual = q.unionByName(run.where("rank <= 10").select("query_id", "doc_id", F.lit(2).alias("grade"))).groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    a, b = metrics.per_query(run, q), metrics.per_query(run, virtual)
    return a.select("query_id", F.col("ndcg_10").alias("low")).join(b.select("query_id", F.col("ndcg_10").alias("high")), "query_id")


@query("e6_e7_copy_run", """
WITH q AS (SELECT query_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p, len(tokens) AS n FROM questok), pairs AS (SELECT query_id, doc_id FROM run_words WHERE rank <= 3),
t AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS s FROM doctok WHERE doc_id IN (SELECT doc_id FROM pairs)),
m AS (SELECT k.query_id, k.doc_id, q.n, q.p, q.p - t.s AS diagonal FROM pairs k JOIN q USING (query_id) JOIN t ON t.doc_id = k.doc_id AND t.token = q.token),
g AS (SELECT query_id, doc_id, n, p - row_number() OVER (PARTITION BY query_id, doc_id, diagonal ORDER BY p) AS island, diagonal FROM m),
c AS (SELECT query_id, doc_id, any_value(n) AS n, count(*) AS c FROM g GROUP BY query_id, doc_id, diagonal, island)
SELECT query_id, doc_id, max(c) AS run, round(max(c) / any_value(n), 6) AS share FROM c GROUP BY query_id, doc_id""")
def _(spark, d):
    """The longest run of tokens that a question and each of its three best documents share, and its share of the question."""
    from gleaner.operators.copying import longest_runs

    return longest_runs(questions(spark, d), documents(spark, d), run_words(spark, d, 3).select("query_id", "doc_id"))


_IDF = """
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM tok GROUP BY token), n AS (SELECT count(*) AS n FROM documents),
mi AS (SELECT query_id, round(avg(ln((n + 1) / (coalesce(df, 0) + 1))), 6) AS mean_idf, count(*) AS tokens FROM qtok LEFT JOIN df USING (token), n GROUP BY query_id)"""


def mean_idf(spark, d):
    """query_id, mean_idf, tokens of the questions that have tokens."""
    t = documents(spark, d).select("doc_id", F.explode(F.array_distinct(split_tokens(F.col("text")))).alias("token"))
    df = t.groupBy("token").agg(F.count("*").alias("df"))
    n = documents(spark, d).agg(F.count("*").alias("n"))
    q = questions(spark, d).select("query_id", F.explode(split_tokens(F.col("text"))).alias("token")).join(df, "token", "left").crossJoin(F.broadcast(n))
    idf = F.ln((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1))
    return q.groupBy("query_id").agg(F.round(F.avg(idf), 6).alias("mean_idf"), F.count("*").alias("tokens"))


@query("e8_mean_idf", "WITH" + _IDF + " SELECT * FROM mi")
def _(spark, d):
    return mean_idf(spark, d)


@query("e11_judge_query", "WITH" + _IDF + """
SELECT q.query_id, CASE WHEN coalesce(mi.tokens, 0) < 4 THEN 'too short' WHEN right(trim(text), 1) <> '?' AND mi.tokens % 2 = 0 THEN 'no question' WHEN mean_idf < 3.0 THEN 'too common' ELSE 'kept' END AS reason
FROM questok q LEFT JOIN mi USING (query_id)""")
def _(spark, d):
    """The rules that apply to any language, in order; every second length stands for the style that must ask."""
    q = questions(spark, d).join(mean_idf(spark, d), "query_id", "left")
    asks = (F.right(F.trim("text"), F.lit(1)) != "?") & (F.col("tokens") % 2 == 0)
    reason = F.when(F.coalesce("tokens", F.lit(0)) < 4, "too short").when(asks, "no question").when(F.col("mean_idf") < 3.0, "too common").otherwise("kept")
    return q.select("query_id", reason.alias("reason"))


@query("f6_kappa_interval", """
WITH cells AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n, a, b FROM judge_a JOIN judge_b USING (doc_id) WHERE a IS NOT NULL AND b IS NOT NULL),
picks AS (SELECT rep, """ + _draw("n", "7", "rep", "i") + """ AS j FROM cells, (SELECT unnest(range(4000)) AS rep)),
drawn AS (SELECT p.rep, c.a, c.b FROM picks p JOIN cells c ON c.i = p.j),
ca AS (SELECT rep, a AS x, count(*) AS c FROM drawn GROUP BY ALL), cb AS (SELECT rep, b AS x, count(*) AS c FROM drawn GROUP BY ALL),
hit AS (SELECT rep, sum(ca.c * cb.c) AS hit FROM ca JOIN cb USING (rep, x) GROUP BY rep),
k AS (SELECT rep, 1 - (off / n) / (1 - coalesce(hit, 0) / (n * n)) AS k FROM (SELECT rep, count(*)::DOUBLE AS n, count(*) FILTER (a <> b) AS off FROM drawn GROUP BY rep) LEFT JOIN hit USING (rep)),
o AS (SELECT list(k ORDER BY k) AS k FROM k)
SELECT round(k[CAST(floor(0.025 * len(k)) AS INT) + 1], 6) AS lo, round(k[CAST(floor(0.975 * len(k)) AS INT) + 1], 6) AS hi FROM o""")
def _(spark, d):
    """Resampled kappa of two judges, order statistics at 2.5 and 97.5 % of 4000 resamples by md5."""
    a, b = judges(spark, d)
    return stats.kappa_interval(a.join(b, "doc_id"), "doc_id")
