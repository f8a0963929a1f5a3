"""Queries of generation, losses and journals of training."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.text import body_of, good_source, split_tokens
from gleaner.operators import generation, journal, losses
from gleaner.plans.base import documents, query, run_words, scratch, stored_index, text_qrels, vector_run, vectors

STYLES = (generation.Style("professional"), generation.Style("everyday"), generation.Style("search", asks=False))
_WRITTEN = {"professional": (0, 9, "?"), "everyday": (20, 12, "?"), "search": (3, 5, "")}


def generation_run(spark, d, folder=None, **more) -> generation.Generation:
    """Questions about documents by a stub: every second word of a stretch, which stretch by style. Acts are source and language."""
    index = stored_index(spark, d, split_tokens)
    n, df = index.index.size.first()["n"], index.index.df

    def write(rows, style):
        return rows.withColumn("question", generation.every_second_word(*_WRITTEN[style.name])(F.col("body")))

    def judge(rows, style):
        return generation.judged(rows, style.asks, df, n, "doc_id", russian=False)

    return generation.Generation(spark, folder or scratch(spark, "generation"), STYLES, write, judge, **more)


def generation_sources(spark, d):
    text = F.col("text")
    good = documents(spark, d).where(good_source(text, F.lit(None).cast("string")))
    return good.select("doc_id", F.concat_ws("/", "source", "lang").alias("act"), body_of(text).alias("body"))


@query("j14_generation")
def _(spark, d):
    """A thousand accepted questions, or as many as twelve for each act allow; tests hold it against a plain loop."""
    return generation_run(spark, d).run(generation_sources(spark, d), 1000)


_DIMS = (64, 32, 16)


def _unit_sql(v: str, dim: int) -> str:
    return f"list_transform({v}[1:{dim}], lambda p: CAST(p AS DOUBLE) / sqrt(list_sum([CAST(q AS DOUBLE) * q for q in {v}[1:{dim}]])))"


@query("j16_contrastive", """
WITH pairs AS (SELECT a.vec_id AS id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0),
placed AS (SELECT *, (row_number() OVER (ORDER BY md5('13|' || id), id) - 1) // 64 AS batch FROM pairs), """ + ", ".join(f"""
u{d} AS (SELECT batch, id, {_unit_sql('x', d)} AS x, {_unit_sql('y', d)} AS y FROM placed),
s{d} AS (SELECT a.batch, a.id, ln(sum(exp(20 * list_dot_product(a.x, b.y)))) - max(CASE WHEN a.id = b.id THEN 20 * list_dot_product(a.x, b.y) END) AS l FROM u{d} a JOIN u{d} b USING (batch) GROUP BY a.batch, a.id),
l{d} AS (SELECT batch, count(*) AS n, avg(l) AS l FROM s{d} GROUP BY batch)""" for d in _DIMS) + """
SELECT batch, n, round(l64.l + l32.l + l16.l, 6) AS loss FROM l64 JOIN l32 USING (batch, n) JOIN l16 USING (batch, n)""")
def _(spark, d):
    """Every vector with an even id and its successor are a pair; batches of 64, loss over three dimensions."""
    v = vectors(spark, d)
    positive = v.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("positive"))
    pairs = v.where("vec_id % 2 = 0").join(positive, "vec_id").select("vec_id", F.col("embedding").alias("anchor"), "positive")
    return losses.contrastive(pairs, "vec_id", dims=_DIMS).select("batch", "n", F.round("loss", 6).alias("loss"))


@query("j16_listwise", """
WITH l AS (SELECT r.query_id, 10 * r.score AS t, q.embedding AS x, c.embedding AS y FROM run_full r JOIN embeddings q ON q.vec_id = r.query_id JOIN embeddings c ON c.vec_id = r.doc_id), """ + ", ".join(f"""
s{d} AS (SELECT query_id, t / 1.5 AS t, 20 * list_dot_product({_unit_sql('x', d)}, {_unit_sql('y', d)}) / 0.7 AS s FROM l),
z{d} AS (SELECT query_id, ln(sum(exp(t))) AS zt, ln(sum(exp(s))) AS zs, count(*) AS n FROM s{d} GROUP BY query_id),
k{d} AS (SELECT query_id, max(n) AS n, sum(exp(t - zt) * (t - zt - s + zs)) AS l FROM s{d} JOIN z{d} USING (query_id) GROUP BY query_id)""" for d in (32, 16)) + """
SELECT query_id, k32.n, round(k32.l + k16.l, 6) AS loss FROM k32 JOIN k16 USING (query_id)""")
def _(spark, d):
    """The ten nearest of each query: full vectors teach truncated ones, with a temperature for either."""
    v = vectors(spark, d)
    anchors = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("anchor"))
    docs = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("doc"))
    lists = vector_run(spark, d).select("query_id", "doc_id", (10 * F.col("score")).alias("label")).join(anchors, "query_id").join(docs, "doc_id")
    return losses.listwise(lists, "query_id", dims=(32, 16), temperature=0.7, teacher_temperature=1.5).select("query_id", "n", F.round("loss", 6).alias("loss"))


#: seq, tag, stage, the depth to which a hit counts, and what is added to its rank.
_ENTRIES = ((1, "base", "base", 1, 0), (2, "deep", "A", 10, 0), (3, "late", "B", 10, 1), (4, "short", "D", 5, 0), (5, "deep", "A", 50, 0), (6, "all", "C", 50, 0), (7, "less", "D", 50, 3))
_ENTRY_SQL = "(VALUES " + ", ".join(f"({s}, '{t}', '{g}', {k}, {a})" for s, t, g, k, a in _ENTRIES) + ") AS e(seq, tag, stage, depth, added)"
_STRUCT = "{'tag': e.tag, 'stage': e.stage, 'seq': e.seq, 'other': b.seq, 'verdict': %s}"
_VERDICT = """CASE WHEN b.seq IS NULL THEN NULL WHEN e.stage = 'D' THEN CASE WHEN p.diff >= 0 OR (p.lo <= 0 AND p.hi >= 0) THEN 'accepted' ELSE 'rejected' END
 WHEN p.diff <= 0 THEN 'rejected' WHEN p.p < 0.05 THEN 'accepted' ELSE 'not established' END"""


@query("j18_journal", f"""
WITH RECURSIVE first_ AS (SELECT q.query_id, min(r.rank) AS rank FROM (SELECT DISTINCT query_id FROM qrels) q LEFT JOIN (SELECT query_id, rank FROM run_words JOIN qrels USING (query_id, doc_id)) r USING (query_id) GROUP BY q.query_id),
journals AS (SELECT query_id, rank, unnest(['all', CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS journal FROM first_),
entries AS (SELECT * FROM {_ENTRY_SQL}, (SELECT DISTINCT journal FROM journals)),
vals AS (SELECT journal, seq, tag, CAST(query_id AS VARCHAR) AS key, CASE WHEN rank <= depth THEN round(1.0::DOUBLE / (rank + added), 6) ELSE 0.0 END AS value FROM journals JOIN entries USING (journal)),
diffs AS (SELECT a.journal, a.seq AS s, b.seq AS o, row_number() OVER (PARTITION BY a.journal, a.seq, b.seq ORDER BY a.key) - 1 AS i, count(*) OVER (PARTITION BY a.journal, a.seq, b.seq) AS n, a.value - b.value AS d FROM vals a JOIN vals b ON a.journal = b.journal AND a.key = b.key AND b.seq < a.seq),
drawn AS (SELECT journal, s, o, rep, n, d, ({journal.mixed_sql(7, 'rep', 'i')} * n) >> 32 AS j, {journal.mixed_sql(8, 'rep', 'i')} & 1 AS sign FROM diffs, (SELECT unnest(range(10000)) AS rep)),
flips AS (SELECT journal, s, o, rep, avg(CASE WHEN sign = 1 THEN d ELSE -d END) AS f FROM drawn GROUP BY ALL),
boots AS (SELECT k.journal, k.s, k.o, k.rep, avg(x.d) AS m FROM drawn k JOIN diffs x ON x.journal = k.journal AND x.s = k.s AND x.o = k.o AND x.i = k.j GROUP BY ALL),
means AS (SELECT journal, s, o, count(*) AS common, avg(d) AS diff FROM diffs GROUP BY ALL),
pairs AS (SELECT journal, s, o, any_value(common) AS common, any_value(diff) AS diff, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg((abs(f) >= abs(diff) - 1e-12)::INT::DOUBLE) AS p FROM boots JOIN flips USING (journal, s, o, rep) JOIN means USING (journal, s, o) GROUP BY journal, s, o),
fold AS (SELECT journal, 0 AS seq, CAST([] AS STRUCT(tag VARCHAR, stage VARCHAR, seq INTEGER, other INTEGER, verdict VARCHAR)[]) AS hist FROM (SELECT DISTINCT journal FROM journals) UNION ALL
 SELECT f.journal, e.seq, list_append(list_filter(f.hist, lambda x: x.tag <> e.tag), {_STRUCT % _VERDICT}) FROM fold f JOIN entries e ON e.journal = f.journal AND e.seq = f.seq + 1,
 LATERAL (SELECT coalesce(list_last(list_filter(f.hist, lambda x: x.tag <> e.tag AND x.verdict = 'accepted')), list_first(list_filter(f.hist, lambda x: x.tag <> e.tag AND x.tag = 'base'))).seq AS seq) b
 LEFT JOIN pairs p ON p.journal = f.journal AND p.s = e.seq AND p.o = b.seq),
done AS (SELECT journal, unnest(hist) AS h, generate_subscripts(hist, 1) AS place FROM fold WHERE seq = {len(_ENTRIES)}),
dev AS (SELECT journal, seq, count(*) AS n, round(avg(value), 6) AS mean FROM vals GROUP BY ALL)
SELECT done.journal, place, h.tag AS tag, h.stage AS stage, n, mean, e.tag AS compared_with, common, round(diff, 6) + 0.0 AS diff, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, round(p, 6) + 0.0 AS p, h.verdict AS verdict
FROM done JOIN dev ON dev.journal = done.journal AND dev.seq = h.seq LEFT JOIN pairs ON pairs.journal = done.journal AND pairs.s = h.seq AND pairs.o = h.other LEFT JOIN (SELECT DISTINCT seq, tag FROM entries) e ON e.seq = h.other""")
def _(spark, d):
    """Three journals, of all judged questions and of either parity: the search at several depths, one of them made anew."""
    hits = run_words(spark, d).join(text_qrels(spark, d), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    first = text_qrels(spark, d).select("query_id").distinct().join(hits, "query_id", "left")
    rows = first.select("query_id", "rank", F.explode(F.array(F.lit("all"), F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))).alias("journal"))
    told = F.broadcast(spark.createDataFrame(_ENTRIES, "seq int, tag string, stage string, depth int, added int"))
    value = F.when(F.col("rank") <= F.col("depth"), F.round(1 / (F.col("rank") + F.col("added")), 6)).otherwise(0.0)
    values = rows.crossJoin(told).select("journal", "seq", F.col("query_id").cast("string").alias("key"), value.alias("value"))
    entries = rows.select("journal").distinct().crossJoin(told).select("journal", "seq", "tag", "stage")
    return journal.folded(entries, values)
