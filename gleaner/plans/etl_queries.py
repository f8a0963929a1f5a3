"""Queries of sources, sinks and corpus building."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import curation
from gleaner.plans.base import CYRILLIC, LATIN, Literal, chunks, documents, graded_run, query, questions, read, run_stems, run_words, scratch, text_qrels
from gleaner.sources import files, web

QRELS_LINES = Literal("line_no long, value string", [
    (0, "query-id\tcorpus-id\tscore"), (1, "q1\tc1\t2"), (2, "q1\tc2\tx"), (3, "q2\tc1\t1\tнота"), (4, "q1\tc1\t0"), (5, "q3\tc9"), (6, "q2\tc5\t-1"), (7, "")
])


@query("a3_qrels_scan", rf"""
SELECT query_id, doc_id, arg_max(CAST(g AS INTEGER), line_no) AS grade FROM (SELECT line_no, split_part(value, chr(9), 1) AS query_id, split_part(value, chr(9), 2) AS doc_id, trim(split_part(value, chr(9), 3)) AS g
 FROM {QRELS_LINES.sql.replace(chr(9), "' || chr(9) || '")} WHERE value NOT LIKE 'query-id%') WHERE regexp_matches(g, '^-?\d+$') GROUP BY ALL""")
def _(spark, d):
    return files.parse_qrels(QRELS_LINES.df(spark))


SHEET = Literal("line long, query_id string, question string", [(1, "q1", "Что?"), (2, "q1", ""), (3, "q1", None), (4, "q2", "Как?"), (5, "q2", " ")])


@query("a7_fill_down", f"SELECT line, query_id, last_value(nullif(trim(question), '') IGNORE NULLS) OVER (PARTITION BY query_id ORDER BY line) AS question FROM {SHEET.sql}")
def _(spark, d):
    return files.filled_down(SHEET.df(spark), "question", ["query_id"])


SPLIT = Literal("value string", [('{"groups": {"dev": ["a1", "a2"], "train": ["a3"], "empty": []}}',)])


@query("a8_split_scan", f"SELECT * FROM {Literal('part string, doc_id string', [('dev', 'a1'), ('dev', 'a2'), ('train', 'a3')]).sql}")
def _(spark, d):
    return files.exploded_split(SPLIT.df(spark))


@query("a5_vector_scan", "SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, min(len(embedding)) AS dim_min, max(len(embedding)) AS dim_max FROM embeddings")
def _(spark, d):
    n = F.size("embedding").cast("long")
    return read(spark, d, "embeddings").agg(F.count("*").alias("vectors"), F.countDistinct("vec_id").alias("ids"), F.min(n).alias("dim_min"), F.max(n).alias("dim_max"))


@query("a9_page_links", r"""
WITH a AS (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS l FROM pages))
SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a""")
def _(spark, d):
    return web.links(read(spark, d, "pages"))


@query("a10_paragraphs", r"""
SELECT page_id, len(l) AS n, list_sum([length(x) for x in l]) AS chars FROM (SELECT page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) AS l FROM pages)""")
def _(spark, d):
    p = web.elements(F.col("html"), "p")
    total = F.aggregate(F.transform(p, lambda x: F.length(x)), F.lit(None).cast("int"), lambda a, x: F.coalesce(a, F.lit(0)) + x)
    return read(spark, d, "pages").select("page_id", F.size(p).cast("long").alias("n"), total.alias("chars"))


TABLE = Literal("page_id long, html string", [(1, "<table><tr><td>1</td><td>№&nbsp;590-П</td><td><b>x</b></td><td><a href='f.pdf'>f</a></td></tr><tr><td>a</td></tr></table>"), (2, "<tr><th>h</th></tr>")])


@query("a10_table_rows", f"SELECT * FROM {Literal('page_id long, pos int, cells string', [(1, 0, '1|№ 590-П|x|f')]).sql}")
def _(spark, d):
    return web.table_rows(TABLE.df(spark)).select("page_id", "pos", F.array_join("cells", "|").alias("cells"))


@query("a11_headings_and_questions", r"""
SELECT page_id, len(regexp_extract_all(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1)) AS headings, len([x for x in regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) if length(x) >= 40]) AS long_paragraphs FROM pages""")
def _(spark, d):
    long_ = F.filter(web.elements(F.col("html"), "p"), lambda x: F.length(x) >= 40)
    return read(spark, d, "pages").select("page_id", F.size(web.elements(F.col("html"), "h1")).cast("long").alias("headings"), F.size(long_).cast("long").alias("long_paragraphs"))


@query("a15_query_union", """
WITH t AS (SELECT 'b' || item_id AS query_id, text, 'benchmark' AS origin, 0 AS i FROM benchmark UNION ALL SELECT 'b' || conv_id, text, 'live', 1 FROM conversations WHERE role = 'user' AND turn % 2 = 0)
SELECT query_id, md5(text) AS digest, origin FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i, text) AS r FROM t) WHERE r = 1""")
def _(spark, d):
    """Sources in a fixed priority; every odd turn is routed away."""
    a = questions(spark, d).select(F.concat(F.lit("b"), "query_id").alias("query_id"), "text", F.lit(None).cast("string").alias("route"))
    c = read(spark, d, "conversations").where("role = 'user'")
    c = c.select(F.concat(F.lit("b"), "conv_id").alias("query_id"), "text", F.when(F.col("turn") % 2 != 0, "отброшен: нет").alias("route"))
    return files.union_queries([("benchmark", a), ("live", c)]).select("query_id", F.md5(F.col("text").cast("binary")).alias("digest"), "origin")


@query("a16_listing_union", "SELECT source AS number, lang AS issue, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def _(spark, d):
    return documents(spark, d).groupBy(F.col("source").alias("number"), F.col("lang").alias("issue")).agg(F.min("doc_id").alias("doc_id"))


@query("a17_beir_tables", "SELECT 'corpus' AS part, count(*) AS n FROM documents UNION ALL SELECT 'queries', count(*) FROM benchmark UNION ALL SELECT 'qrels', count(*) FROM qrels")
def _(spark, d):
    parts = (("corpus", documents(spark, d)), ("queries", questions(spark, d)), ("qrels", text_qrels(spark, d)))
    a, b, c = (t.agg(F.lit(n).alias("part"), F.count("*").alias("n")) for n, t in parts)
    return a.union(b).union(c)


@query("b1_beir_corpus", "SELECT chunk_id AS _id, d.source || ' от ' || '01.01.2020' || '. ' || 'Документ' || CASE WHEN position > 0 THEN ' // Часть ' || position ELSE '' END AS title, md5(c.text) AS digest FROM chunks c JOIN documents d USING (doc_id)")
def _(spark, d):
    c = chunks(spark, d).join(documents(spark, d).select("doc_id", F.col("source").alias("number")), "doc_id")
    section = F.when(F.col("position") > 0, F.concat(F.lit("Часть "), "position"))
    c = c.withColumns({"date": F.lit("01.01.2020"), "title": F.lit("Документ"), "section": section})
    return files.beir_corpus(c).select("_id", "title", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("b2_beir_queries", "SELECT item_id AS _id, text FROM benchmark WHERE item_id IN (SELECT query_id FROM qrels)")
def _(spark, d):
    return files.beir_queries(questions(spark, d), text_qrels(spark, d))


@query("b3_qrels_rows", """
SELECT r.query_id, r.doc_id, CASE WHEN r.doc_id % 2 = r.query_id % 2 THEN 2 ELSE 1 END AS grade FROM run_full r JOIN embeddings q ON q.vec_id = r.query_id JOIN embeddings c ON c.vec_id = r.doc_id WHERE q.label = c.label""")
def _(spark, d):
    """The labels of what a run retrieved, written and read back; zero grades are dropped on the way."""
    path = scratch(spark, "b3")
    files.write_qrels(graded_run(spark, d).select("query_id", "doc_id", "grade"), path)
    back = files.read_qrels(spark, path)
    return back.select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"), "grade")


@query("b4_run_lines", "SELECT CAST(query_id AS VARCHAR) AS query_id, string_agg(doc_id, ',' ORDER BY rank) AS ranked FROM run_words WHERE rank <= 10 GROUP BY query_id")
def _(spark, d):
    return files.run_lines(run_words(spark, d, 10)).select("query_id", F.array_join("ranked", ",").alias("ranked"))


@query("b6_export", "SELECT doc_id, md5(text) AS digest, length(text) AS chars FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("chars"))


@query("b9_resumable_append", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    """What a resumed run still has to do: the documents that the finished table lacks."""
    return documents(spark, d).select("doc_id").join(read(spark, d, "labels"), "doc_id", "left_anti")


@query("b9_append_new", "SELECT doc_id, md5(text) AS digest FROM documents")
def _(spark, d):
    """The labelled documents are there already when the run is taken up again: every document stands in the table once."""
    path, rows = scratch(spark, "b9"), documents(spark, d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    files.append_new(rows.join(read(spark, d, "labels"), "doc_id", "left_semi"), path, ["doc_id"])
    files.append_new(rows, path, ["doc_id"])
    return spark.read.parquet(path)


@query("a1_jsonl_scan", "SELECT doc_id, md5(text) AS digest, lang FROM documents")
def _(spark, d):
    """Documents as JSON lines with a blank line after each, read again."""
    path = scratch(spark, "a1")
    documents(spark, d).select(F.explode(F.array(F.to_json(F.struct("doc_id", "text", "lang")), F.lit(""))).alias("value")).write.text(path)
    return files.read_jsonl(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "lang")


@query("a2_jsonl_gz_scan", "SELECT doc_id, md5(text) AS digest, n_chars FROM documents")
def _(spark, d):
    path = scratch(spark, "a2")
    documents(spark, d).select("doc_id", "text", "n_chars").write.option("compression", "gzip").json(path)
    return files.read_jsonl(spark, path, "doc_id long, text string, n_chars long").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n_chars")


_RUN_ROWS = "SELECT '{0}' AS run, CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, rank FROM {1} WHERE rank <= 10"


@query("a4_run_scan", _RUN_ROWS.format("bm25-prefix", "run_stems") + " UNION ALL " + _RUN_ROWS.format("bm25-words-v1", "run_words"))
def _(spark, d):
    """Two runs of one config, written and read again; the run of another config isn't read."""
    folder = scratch(spark, "a4")
    words, stems = run_words(spark, d, 10), run_stems(spark, d, 10)
    for config, name, run in (("base", "bm25:words+v1", words), ("base", "bm25:prefix", stems), ("size-256", "bm25:words+v1", words)):
        files.write_run(run, folder, config, name)
    return files.read_runs(spark, folder, "base")


@query("a18_external_qrels", "SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, grade - 1 AS grade FROM qrels WHERE grade > 1")
def _(spark, d):
    """Labels as JSON lines, a grade less each; those of score 0 aren't read."""
    path, q = scratch(spark, "a18"), text_qrels(spark, d)
    q.select(F.col("query_id").cast("string").alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), (F.col("grade") - 1).alias("score")).write.json(path)
    return files.read_qrels_jsonl(spark, path)


PAGES = [
    (1, ["Колонтитул", "УКАЗАНИЕ БАНКА РОССИИ", "О порядке", "№ 5348-У", "Текст пер-", "вый", "1"]), (2, ["Колонтитул", "продолжение", "Инструкция", "Банка России", "№ 138-И", "2"]),
    (3, ["Колонтитул", "ПОЛОЖЕНИЕ", "О правилах", "учета", "", "тело"]), (4, ["Колонтитул", "№ 590–П", "конец"]),
]
ISSUE = Literal("issue string, page int, n int, line string", [("v1", p, i, line) for p, lines in PAGES for i, line in enumerate(lines)])
EXPECTED = Literal("issue string, number string", [("v1", "5348-У"), ("v1", "590-П"), ("v1", "999-П")])
FOUND = Literal("issue string, number string, kind string, title string, text string", [
    ("v1", "5348-У", "УКАЗАНИЕ", "О порядке", "УКАЗАНИЕ БАНКА РОССИИ\nО порядке\n№ 5348-У\nТекст первый\nпродолжение\nИнструкция\nБанка России\n№ 138-И"),
    ("v1", "590-П", "ПОЛОЖЕНИЕ", "О правилах учета", "ПОЛОЖЕНИЕ\nО правилах\nучета\nтело\n№ 590-П\nконец"),
])


@query("c4_chrome_lines", f"SELECT issue, line FROM {ISSUE.sql} WHERE line <> '' AND length(line) <= 120 GROUP BY ALL HAVING count(DISTINCT page) >= greatest(2, floor(0.3 * (SELECT count(DISTINCT page) FROM {ISSUE.sql})))")
def _(spark, d):
    return web.chrome_lines(ISSUE.df(spark))


@query("c4_chrome_lines_documents", """
WITH l AS (SELECT source AS issue, doc_id AS page, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT source AS issue, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source)
SELECT issue, md5(line) AS digest FROM l JOIN p USING (issue) WHERE line <> '' AND length(line) <= 120 GROUP BY issue, line, pages HAVING count(DISTINCT page) >= greatest(2, floor(0.05 * pages))""")
def _(spark, d):
    lines = documents(spark, d).select(F.col("source").alias("issue"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return web.chrome_lines(lines, 0.05).select("issue", F.md5(F.col("line").cast("binary")).alias("digest"))


@query("c5_act_starts", f"SELECT issue, number, kind, title FROM {FOUND.sql}")
def _(spark, d):
    lines = ISSUE.df(spark).select("issue", "page", "n", text.norm_line(F.col("line")).alias("line"))
    return web.act_starts(lines, EXPECTED.df(spark)).select("issue", "number", "kind", "title")


@query("c6_split_issue", f"SELECT * FROM {FOUND.sql}")
def _(spark, d):
    return web.split_issue(ISSUE.df(spark), EXPECTED.df(spark))


@query("c12_split_check", f"SELECT 'v1' AS issue, 2 AS hit, 1 AS miss, 0 AS extra")
def _(spark, d):
    return web.split_check(EXPECTED.df(spark), web.split_issue(ISSUE.df(spark), EXPECTED.df(spark)))


LISTING = Literal("number string, date string, title string, issue string", [
    ("590-П", "28.06.2017", "О порядке", "v1"), ("5348-У", "09.12.2019", "О правилах", "v1"), ("5349-У", "09.12.2019", "О внесении изменений в Положение", "v2"), ("1-И", "01.01.1999", "Старая", "v0"), ("7-Т", "01.01.2021", "Письмо", "v3"), ("590-П", "28.06.2017", "О порядке", "v4"),
])


@query("c7_select_corpus", f"SELECT number, date FROM {LISTING.sql} WHERE regexp_replace(number, '^.*?[-–]', '') IN ('П', 'И', 'У') AND NOT starts_with(lower(title), 'о внесении изменений') AND CAST(right(date, 4) AS INTEGER) >= 2000 GROUP BY ALL")
def _(spark, d):
    keep = text.act_type(F.col("number")).isin("П", "И", "У") & ~F.lower("title").startswith("о внесении изменений") & (text.year(F.col("date")) >= 2000)
    return LISTING.df(spark).where(keep).select("number", "date").distinct()


@query("c9_issues_by_act", f"SELECT number, date, string_agg(issue, ',' ORDER BY issue) AS issues FROM {LISTING.sql} GROUP BY ALL")
def _(spark, d):
    return LISTING.df(spark).groupBy("number", "date").agg(F.array_join(F.sort_array(F.collect_list("issue")), ",").alias("issues"))


@query("c10_build_corpus", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents), s AS (SELECT CASE WHEN r > 1 THEN 'later issue' WHEN n_chars < 500 THEN 'too short' ELSE 'kept' END AS reason FROM r)
SELECT reason, count(*) AS n FROM s GROUP BY reason""")
def _(spark, d):
    """The first issue that holds an act gives its text; short ones are rejected; counts by reason."""
    acts = documents(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"), F.min_by("n_chars", "doc_id").alias("chars"))
    later = F.struct(F.lit("later issue").alias("reason"), (F.col("n") - 1).alias("n"))
    first = F.struct(F.when(F.col("chars") < 500, "too short").otherwise("kept").alias("reason"), F.lit(1).cast("long").alias("n"))
    return acts.select(F.inline(F.array(later, first))).where("n > 0").groupBy("reason").agg(F.sum("n").alias("n"))


@query("c10_build_corpus_acts", """
WITH f AS (SELECT source AS number, lang AS issue, arg_min(text, doc_id) AS text FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), k AS (SELECT number, min(issue) AS issue FROM f GROUP BY number)
SELECT number, issue, length(text) AS chars, md5(text) AS digest, CASE WHEN length(text) < 500 THEN 'слишком короткий' END AS reason FROM k JOIN f USING (number, issue)""")
def _(spark, d):
    """Sources stand for acts and languages for issues; the texts aren't Russian, so no share of Cyrillic is asked for."""
    docs = documents(spark, d).where("source is not null and lang is not null").groupBy(F.col("source").alias("number"), F.col("lang").alias("issue"))
    found = docs.agg(F.min_by("text", "doc_id").alias("text"))
    wanted = found.select("number", F.lit("01.01.2020").alias("date"), F.lit("О правилах").alias("title"), "issue")
    return curation.build_corpus(wanted, found, least_cyrillic=0.0).select("number", "issue", "chars", F.md5(F.col("text").cast("binary")).alias("digest"), "reason")


@query("c10_build_corpus_cyrillic", f"""
WITH f AS (SELECT source AS issue, doc_id // 2 AS act, CASE WHEN doc_id % 5 = 0 THEN text ELSE translate(text, '{LATIN}', '{CYRILLIC}') END AS text FROM documents WHERE source IS NOT NULL),
k AS (SELECT act, arg_min(text, issue || chr(1) || text) AS text, min(issue) AS issue FROM f GROUP BY act),
s AS (SELECT *, len(regexp_extract_all(text, '[а-яёА-ЯЁ]')) AS c, len(regexp_extract_all(text, '[a-zA-Z]')) AS l FROM k)
SELECT act || '-П' AS number, issue, length(text) AS chars, md5(text) AS digest, CASE WHEN c + l = 0 OR c / (c + l) < 0.9 THEN 'мало кириллицы' WHEN length(text) < 500 THEN 'слишком короткий' END AS reason FROM s""")
def _(spark, d):
    """Two documents are two issues' texts of an act; letters are read as Cyrillic ones but in every fifth text, which the filter must reject."""
    docs = documents(spark, d).where("source is not null")
    texts = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.translate("text", LATIN, CYRILLIC))
    found = docs.select(F.col("source").alias("issue"), F.expr("concat(doc_id div 2, '-П')").alias("number"), texts.alias("text"))
    wanted = found.select("number", F.lit("01.01.2020").alias("date"), F.lit("О правилах").alias("title"), "issue").distinct()
    return curation.build_corpus(wanted, found).select("number", "issue", "chars", F.md5(F.col("text").cast("binary")).alias("digest"), "reason")


@query("c13_catalog_profile", "SELECT year(o_orderdate) AS year, o_orderpriority AS kind, count(*) AS n, count(DISTINCT o_custkey) AS issues, round(quantile_cont(o_totalprice, 0.5), 6) AS median FROM orders GROUP BY ALL")
def _(spark, d):
    """Counts by kind and year; orders stand for a listing with dates."""
    o = read(spark, d, "orders")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("kind")).agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("issues"), F.round(F.percentile("o_totalprice", 0.5), 6).alias("median")
    )


@query("c14_corpus_profile", "SELECT lang, count(*) AS n, sum(n_chars) AS total, quantile_cont(n_chars, 0.5) AS median, max(n_chars) AS longest FROM documents GROUP BY lang")
def _(spark, d):
    return documents(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.percentile("n_chars", 0.5).alias("median"), F.max("n_chars").alias("longest"))


@query("s1_stream_dedupe", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    """The streaming wrapper's transformation, run over the table as one batch."""
    from gleaner.streaming.judgements import counted

    return counted(read(spark, d, "events"))


@query("b5_embedding_sizes", "SELECT label, count(*) AS rows, max(len(embedding)) AS dim FROM embeddings GROUP BY label")
def _(spark, d):
    return read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("rows"), F.max(F.size("embedding")).cast("long").alias("dim"))


@query("j17_recipe_grid", "SELECT lr, epochs, stage FROM (SELECT unnest([1e-5, 2e-5]::DOUBLE[]) AS lr), (SELECT unnest([1, 2]) AS epochs), (SELECT unnest(['D', 'E']) AS stage)")
def _(spark, d):
    def rows(*v):
        return F.explode(F.array(*(F.lit(x) for x in v)))

    return spark.range(1).select(rows(1e-5, 2e-5).alias("lr")).select("lr", rows(1, 2).alias("epochs")).select("lr", "epochs", rows("D", "E").alias("stage"))


@query("d16_copy_alignment", """
WITH q AS (SELECT item_id, md5(text) AS h FROM benchmark), c AS (SELECT conv_id, md5(text) AS h FROM conversations)
SELECT CASE WHEN c.h IS NULL THEN 'missing' WHEN q.h = c.h THEN 'ok' ELSE 'mismatch' END AS state, count(*) AS n FROM q LEFT JOIN (SELECT conv_id, min(h) AS h FROM c GROUP BY conv_id) c ON c.conv_id = q.item_id GROUP BY state""")
def _(spark, d):
    q = questions(spark, d).select("query_id", F.md5(F.col("text").cast("binary")).alias("a"))
    c = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.min(F.md5(F.col("text").cast("binary"))).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "ok").otherwise("mismatch")
    return q.join(c, "query_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))
