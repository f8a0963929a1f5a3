"""Operators of acts, references, sheets and issues over whole tables.

The tables hold no acts, so acts are derived from them: each document gives one, with a number, kind and date that follow from its
id, and texts that carry its md5. What an operator must find is then known by construction, and the SQL says it from
the table and not from another run of the rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import stemmer, text
from gleaner.operators import chunking, judging
from gleaner.plans.base import CYRILLIC, LATIN, documents, query, questions, read, scratch
from gleaner.sources import files, web

_LETTER = "CASE doc_id % 4 WHEN 0 THEN 'П' WHEN 1 THEN 'У' WHEN 2 THEN 'И' ELSE 'Т' END"
_KIND = "CASE doc_id % 4 WHEN 0 THEN 'Положение' WHEN 1 THEN 'Указание' WHEN 2 THEN 'Инструкция' ELSE 'Письмо' END"


def _two(x: str) -> str:
    return f"lpad(CAST({x} AS STRING), 2, '0')"


#: An act of each document, in expressions that Spark and DuckDB share.
ACT = f"""doc_id, source, text, md5(text) AS h, {_LETTER} AS letter, {_KIND} AS kind, CAST(100 + doc_id AS STRING) || '-' || {_LETTER} AS number,
 {_two('1 + doc_id % 28')} || '.' || {_two('1 + doc_id % 12')} || '.' || CAST(1995 + doc_id % 30 AS STRING) AS date,
 CAST(1 + doc_id % 9 AS STRING) || '.' || CAST(1 + doc_id % 7 AS STRING) AS clause"""
ACTS = f"acts AS (SELECT {ACT} FROM documents)"


def acts(spark, d) -> DataFrame:
    docs = documents(spark, d)
    docs.createOrReplaceTempView("gleaner_documents")
    return spark.sql(f"SELECT {ACT.replace('md5(text)', 'md5(CAST(text AS BINARY))')} FROM gleaner_documents")


def act_query(name: str, made: str, wanted: str):
    """Register a query over acts: `made` is its input (columns of SQL over acts), `wanted` the SQL of its result; the function gets the input."""

    def add(f):
        def run(spark, d):
            return f(acts(spark, d).selectExpr("*", *made) if made else acts(spark, d))

        query(name, f"WITH {ACTS} {wanted}")(run)
        return f

    return add


# --- words and references ---


@query("e2_stem_vocabulary")
def _(spark, d):
    """The vocabulary of all documents, their Latin letters read as Cyrillic ones, with its stems; tests hold them against the plain stemmer."""
    words = documents(spark, d).select(F.explode(text.split_tokens(F.translate("text", LATIN, CYRILLIC))).alias("token")).distinct()
    return stemmer.stemmed(words.select(F.col("token").alias("word"), "token")).select("word", F.col("token").alias("stem"))


@query("e5_normalize_questions", """
SELECT item_id AS query_id, md5(text) || CASE item_id % 3 WHEN 0 THEN ' некредитная финансовая организация' WHEN 1 THEN ' банк россии' ELSE ' прочее' END || '?' AS normal FROM benchmark""")
def _(spark, d):
    opening = "CASE query_id % 4 WHEN 0 THEN 'Каков ' WHEN 1 THEN 'подскажите, ' WHEN 2 THEN ' Что такое ' ELSE '' END"
    body = "md5(CAST(text AS BINARY)) || CASE query_id % 3 WHEN 0 THEN ' НФО' WHEN 1 THEN ' цб' ELSE ' прочее' END || '?'"
    return questions(spark, d).selectExpr("query_id", f"{opening} || {body} AS q").select("query_id", text.normalize_query(F.col("q")).alias("normal"))


@act_query("e10_refers_to_itself_acts", ["CASE doc_id % 3 WHEN 0 THEN 'что сказано в данном фрагменте о ' || h WHEN 1 THEN 'Этот фрагмент ' || h ELSE 'о порядке ' || h END AS s"], "SELECT doc_id, doc_id % 3 < 2 AS self FROM acts")
def _(rows):
    return rows.select("doc_id", text.refers_to_itself(F.col("s")).alias("self"))


_SENTENCE = ["CASE doc_id % 3 WHEN 0 THEN 'по положению Банка России № ' || number || ' и ' || CAST(100 + doc_id AS STRING) || '-ФЗ ' || h WHEN 1 THEN 'без номера ' || h ELSE 'см. ' || number || ', ' || number END AS s"]


@act_query("e13_has_act_number_acts", _SENTENCE, "SELECT doc_id, doc_id % 3 <> 1 AS has FROM acts")
def _(rows):
    return rows.select("doc_id", text.has_act_number(F.col("s")).alias("has"))


@act_query("e14_act_numbers_acts", _SENTENCE, "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN number || ',' || CAST(100 + doc_id AS VARCHAR) || '-ФЗ' WHEN 1 THEN '' ELSE number END AS numbers FROM acts")
def _(rows):
    return rows.select("doc_id", F.array_join(text.act_numbers(F.col("s")), ",").alias("numbers"))


_REFERENCE = ["'Положение Банка России № ' || number || ' о ' || h || ', пункт ' || clause AS s"]


@act_query("e15_strip_numbers_acts", _REFERENCE, "SELECT doc_id, 'Положение Банка России о ' || h || ', пункт' AS bare FROM acts")
def _(rows):
    return rows.select("doc_id", text.strip_numbers(F.col("s")).alias("bare"))


@act_query("e16_strip_references_acts", _REFERENCE, "SELECT doc_id, 'о ' || h AS bare FROM acts")
def _(rows):
    return rows.select("doc_id", text.strip_references(F.col("s")).alias("bare"))


@act_query("e18_clean_clauses_acts", ["array(clause, CAST(doc_id AS STRING), date, clause || '.' || CAST(doc_id % 1500 AS STRING)) AS clauses"], "SELECT doc_id, clause || CASE WHEN doc_id % 1500 < 1000 THEN ',' || clause || '.' || CAST(doc_id % 1500 AS VARCHAR) ELSE '' END AS kept FROM acts")
def _(rows):
    return rows.select("doc_id", F.array_join(text.clean_clauses(F.col("clauses")), ",").alias("kept"))


@query("e19_act_of_questions", f"""
WITH {ACTS}, q AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE number END AS said, CAST(101 + doc_id AS VARCHAR) || '-' || CASE (doc_id + 1) % 4 WHEN 0 THEN 'П' WHEN 1 THEN 'У' WHEN 2 THEN 'И' ELSE 'Т' END AS asked FROM acts),
have AS (SELECT number FROM acts WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN said IN (SELECT number FROM have) THEN said WHEN asked IN (SELECT number FROM have) THEN asked END AS act FROM q""")
def _(spark, d):
    """A question's section may name its act, its words name the next one; the corpus holds every second act."""
    next_ = "CASE (doc_id + 1) % 4 WHEN 0 THEN 'П' WHEN 1 THEN 'У' WHEN 2 THEN 'И' ELSE 'Т' END"
    rows = acts(spark, d).selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN CAST(array() AS array<string>) ELSE array(number) END AS said", f"'как считать по ' || CAST(101 + doc_id AS STRING) || '-' || {next_} || '?' AS question")
    named = rows.select("doc_id", F.posexplode(F.concat("said", F.regexp_extract_all("question", F.lit(r"(?U)\b(\d{1,9}(?:/\d+)?-[А-ЯЁ]{1,2})\b"), F.lit(1)))).alias("pos", "number"))
    found = named.join(acts(spark, d).where("doc_id % 2 = 0").select("number").distinct(), "number").groupBy("doc_id").agg(F.min_by("number", "pos").alias("act"))
    return rows.select("doc_id").join(found, "doc_id", "left")


@act_query("e20_starts_clause_acts", ["CASE doc_id % 3 WHEN 0 THEN clause || '. ' || text WHEN 1 THEN 'см. п. ' || clause || '. ' || h ELSE h || chr(10) || '  ' || clause || '. ' || h END AS body"], "SELECT doc_id, doc_id % 3 <> 1 AS starts FROM acts WHERE text IS NOT NULL")
def _(rows):
    return rows.where("text is not null").select("doc_id", text.starts_clause(F.col("body"), F.col("clause")).alias("starts"))


@act_query("e21_clause_numbers_acts", ["h || ' пп. ' || clause || ' и ' || clause || '.8 и п. ' || clause || ', от ' || date AS s"], "SELECT doc_id, clause || ',' || clause || '.8' AS clauses FROM acts")
def _(rows):
    return rows.select("doc_id", F.array_join(text.clause_numbers(F.col("s")), ",").alias("clauses"))


@act_query("e23_topic_acts", ["CASE doc_id % 5 WHEN 0 THEN 'Форма 0409' || h WHEN 1 THEN 'Пандемия' WHEN 2 THEN NULL ELSE h END AS section", "CASE WHEN doc_id % 7 = 0 THEN array(CAST(doc_id AS STRING) || '-ФЗ') WHEN doc_id % 7 < 4 THEN array(number) ELSE CAST(array() AS array<string>) END AS named"], """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'форма отчетности' WHEN doc_id % 7 = 0 THEN 'федеральный закон' WHEN doc_id % 5 = 1 THEN 'мера поддержки или разъяснение без акта'
 WHEN doc_id % 7 < 4 THEN 'назван акт, которого нет в корпусе' ELSE 'акт не назван ни в разделе, ни в вопросе' END AS topic FROM acts""")
def _(rows):
    return rows.select("doc_id", text.topic(F.col("section"), F.col("named")).alias("topic"))


@act_query("e24_shape_acts", ["h || ' ' || number AS s"], "SELECT doc_id, regexp_replace(regexp_replace(h, '[0-9]+', '9+', 'g'), '[a-z]+', 'A+', 'g') || ' 9+-A+' AS shape FROM acts")
def _(rows):
    return rows.select("doc_id", text.shape(F.col("s")).alias("shape"))


_SLUG = "CASE doc_id % 4 WHEN 0 THEN 'polozhenie' WHEN 1 THEN 'ukazanie' WHEN 2 THEN 'instruktsiya' ELSE 'pismo' END || '-banka-rossii-' || CAST(100 + doc_id AS VARCHAR) || '-' || CASE doc_id % 4 WHEN 0 THEN 'p' WHEN 1 THEN 'u' WHEN 2 THEN 'i' ELSE 't' END || '-ot-' || replace(date, '.', '-')"


@act_query("e25_slug_acts", ["kind || ' Банка России № ' || number || ' от ' || date AS s"], f"SELECT doc_id, {_SLUG} AS slug FROM acts")
def _(rows):
    return rows.select("doc_id", text.slug(F.col("s")).alias("slug"))


@act_query("e27_clean_answer_acts", ["CASE doc_id % 3 WHEN 0 THEN '- «' || h || '?»' || chr(10) || 'пояснение' WHEN 1 THEN '\"' || h || '?\"' ELSE '  — ' || h || '? ' END AS s"], "SELECT doc_id, h || '?' AS clean FROM acts")
def _(rows):
    return rows.select("doc_id", text.clean_answer(F.col("s")).alias("clean"))


@act_query("c2_normalize_number_acts", ["'  ' || CAST(100 + doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN ' – ' WHEN 1 THEN '‑' ELSE '-' END || lower(letter) || ' ' AS n"], "SELECT doc_id, number FROM acts")
def _(rows):
    return rows.select("doc_id", text.normalize_number(F.col("n")).alias("number"))


@act_query("c8_type_and_year_acts", ["CASE WHEN doc_id % 9 = 0 THEN left(date, 6) || '20x' ELSE date END AS d"], "SELECT doc_id, letter AS type, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 1995 + doc_id % 30 END AS year FROM acts")
def _(rows):
    return rows.select("doc_id", text.act_type(F.col("number")).alias("type"), text.year(F.col("d")).cast("long").alias("year"))


# --- listings and issues ---


@act_query("c7_select_corpus_acts", ["CASE WHEN doc_id % 6 = 0 THEN 'О внесении изменений в ' || h ELSE 'О порядке ' || h END AS title"], "SELECT DISTINCT number, date FROM acts WHERE letter <> 'Т' AND doc_id % 6 <> 0 AND 1995 + doc_id % 30 >= 2000")
def _(rows):
    keep = text.act_type(F.col("number")).isin("П", "И", "У") & ~F.lower("title").startswith("о внесении изменений") & (text.year(F.col("date")) >= 2000)
    return rows.where(keep).select("number", "date").distinct()


@act_query("c9_issues_by_act_documents", ["CAST(doc_id % 50 AS STRING) || '-П' AS listed"], "SELECT CAST(doc_id % 50 AS VARCHAR) || '-П' AS number, string_agg(DISTINCT source, ',' ORDER BY source) AS issues FROM acts WHERE source IS NOT NULL GROUP BY ALL")
def _(rows):
    # an act's issues are few; collect_set keeps each once on the way
    return rows.where("source is not null").groupBy(F.col("listed").alias("number")).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("issues"))


def issue_lines(spark, d):
    """Each source is an issue, each of its documents a page that begins an act: kind, title, number and a line of text."""
    rows = acts(spark, d).where("source is not null").selectExpr("source AS issue", "doc_id AS page", "posexplode(array(upper(kind), 'О  ' || h, '№ ' || number, 'тело ' || h || ' регули-', 'рование ' || number, CAST(doc_id % 1000 AS STRING))) AS (n, line)")
    return rows


def issue_listing(spark, d):
    """issue, number of all acts but every fifth, and of some that no issue holds."""
    a = acts(spark, d).where("source is not null")
    return a.where("doc_id % 5 <> 4").selectExpr("source AS issue", "number").union(a.where("doc_id % 7 = 0").selectExpr("source AS issue", "'9' || number || 'Ф' AS number"))


_ISSUES = ACTS + """,
page AS (SELECT source AS issue, doc_id AS page, kind, number, h, doc_id % 5 <> 4 AS listed FROM acts WHERE source IS NOT NULL),
often AS (SELECT issue, kind FROM page GROUP BY issue, kind HAVING count(*) >= (SELECT greatest(2, floor(count(*) * 0.3)) FROM page p WHERE p.issue = page.issue)),
owned AS (SELECT *, max(CASE WHEN listed THEN page END) OVER (PARTITION BY issue ORDER BY page) AS own FROM page),
body AS (SELECT o.issue, own, o.page, CASE WHEN f.kind IS NULL THEN upper(o.kind) || chr(10) ELSE '' END || 'О ' || h || chr(10) || '№ ' || number || chr(10) || 'тело ' || h || ' регулирование ' || number AS t FROM owned o LEFT JOIN often f ON f.issue = o.issue AND f.kind = o.kind WHERE own IS NOT NULL)"""


@query("c5_act_starts_issues", f"WITH {_ISSUES} SELECT issue, number, upper(kind) AS kind, 'О ' || h AS title FROM page WHERE listed")
def _(spark, d):
    lines = issue_lines(spark, d).withColumn("line", text.norm_line(F.col("line")))
    return web.act_starts(lines, issue_listing(spark, d)).select("issue", "number", "kind", "title")


@query("c6_split_issues", f"""
WITH {_ISSUES} SELECT p.issue, p.number, md5(string_agg(b.t, chr(10) ORDER BY b.page)) AS digest FROM page p JOIN body b ON b.issue = p.issue AND b.own = p.page GROUP BY p.issue, p.number""")
def _(spark, d):
    return web.split_issue(issue_lines(spark, d), issue_listing(spark, d)).select("issue", "number", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("c12_split_check_issues", f"WITH {_ISSUES} SELECT issue, count(*) FILTER (listed) AS hit, count(*) FILTER (page % 7 = 0) AS miss, 0 AS extra FROM page GROUP BY issue HAVING count(*) FILTER (listed OR page % 7 = 0) > 0")
def _(spark, d):
    return web.split_check(issue_listing(spark, d), web.split_issue(issue_lines(spark, d), issue_listing(spark, d)))


# --- headings ---

_TITLE = "repeat(h, CAST(1 + doc_id % 4 AS INT))"
_TAIL = "CASE WHEN doc_id % 2 = 0 THEN '. Глава ' || CAST(doc_id % 9 AS STRING) ELSE '' END"


@act_query("d5_header_acts", [f"'Положение Банка России ' || {_TITLE} AS title", f"substring({_TAIL}, 3) AS section", "CAST(24 + doc_id % 60 AS INT) AS most"], f"""
, parts AS (SELECT doc_id, kind || ' Банка России № ' || number || ' от ' || date AS stem, {_TITLE} AS name, {_TAIL} AS tail, 24 + doc_id % 60 AS most FROM acts),
room AS (SELECT *, most - greatest(1, CAST(floor(length(stem || tail) / 3.2) AS BIGINT)) - 2 AS room FROM parts)
SELECT doc_id, CASE WHEN room <= 4 THEN stem || tail WHEN ceil(length(name) / 3.0) > room THEN stem || '. ' || substring(name, 1, room * 3) || '…' || tail ELSE stem || '. ' || name || tail END AS head FROM room""")
def _(rows):
    return rows.select("doc_id", chunking.header(*(F.col(c) for c in ("kind", "number", "date", "title", "section", "most"))).alias("head"))


@act_query("d12b_body_under_formula_acts", ["CASE WHEN doc_id % 2 = 0 THEN kind || ' Банка России № ' || number || ' от ' || date || '. О' ELSE 'Другое' END || chr(10) || chr(10) || h || chr(10) || chr(10) || 'ещё' AS s"], "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Другое' || chr(10) || chr(10) END || h || chr(10) || chr(10) || 'ещё' AS body FROM acts")
def _(rows):
    return rows.select("doc_id", text.body_under_formula(F.col("s"), F.col("number"), F.col("date")).alias("body"))


# --- sheets and answers ---


def labels(spark, d):
    return read(spark, d, "labels").select("doc_id", "quality", "toxic")


@query("a3_qrels_file", "SELECT CAST(doc_id % 7 AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS INTEGER) AS grade FROM labels WHERE quality > 0")
def _(spark, d):
    """Labels written as a tab-separated file with a header and read back; zero grades are left out on the way."""
    path = scratch(spark, "qrels")
    files.write_qrels(labels(spark, d).select((F.col("doc_id") % 7).alias("query_id"), "doc_id", F.col("quality").alias("grade")), path)
    return files.read_qrels(spark, path)


@query("a6_sheet_dialects_labels", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN quality WHEN quality = 1 THEN 2 WHEN doc_id % 4 = 1 THEN NULL WHEN toxic = 1 THEN 1 ELSE 0 END AS grade FROM labels")
def _(spark, d):
    """Three dialects of a sheet: the grade itself, two answers, two numbered answers; the second answer is sometimes blank."""
    yes = "CASE WHEN {0} = 1 THEN '{1}' ELSE 'нет' END"
    second = "CASE WHEN doc_id % 4 = 1 THEN ' ' ELSE " + yes.format("toxic", "ДА ") + " END"
    rows = labels(spark, d).selectExpr(
        "doc_id", "CASE WHEN doc_id % 3 = 0 THEN CAST(quality AS STRING) ELSE '' END AS otsenka_0_1_2",
        f"CASE WHEN doc_id % 3 = 1 THEN {yes.format('quality', 'Да')} END AS otvet_celikom", f"CASE WHEN doc_id % 3 = 2 THEN {yes.format('quality', 'да')} END AS otvet1_celikom",
        f"CASE WHEN doc_id % 3 = 1 THEN {second} END AS otvet_vmeste", f"CASE WHEN doc_id % 3 = 2 THEN {second} END AS otvet2_vmeste",
    )
    return rows.select("doc_id", judging.sheet_grade().alias("grade"))


@query("f1_f2_parse_answers_labels", """
SELECT doc_id, quality = 1 AS whole, toxic = 1 AS together, CASE WHEN quality = 1 OR toxic = 0 OR doc_id % 3 = 1 THEN '-' WHEN doc_id % 3 = 0 THEN 'часть' ELSE 'общая' END AS kind,
 CASE WHEN quality = 1 THEN 2 WHEN toxic = 1 THEN 1 ELSE 0 END AS grade FROM labels""")
def _(spark, d):
    """Labels as answers of a judge in three forms: numbered, numbered with a word, bare."""
    one, two = ("CASE WHEN {} = 1 THEN 'да' ELSE 'нет' END".format(c) for c in ("quality", "toxic"))
    raw = f"CASE doc_id % 3 WHEN 0 THEN '1: ' || {one} || chr(10) || '2: ' || {two} || chr(10) || 'тип: часть' WHEN 1 THEN 'Вопрос 1: ' || {one} || chr(10) || 'вопрос 2: ' || {two} ELSE {one} || ' ' || {two} || ' тип: общая' END"
    rows = labels(spark, d).selectExpr("doc_id", f"{raw} AS raw").withColumn("a", judging.parse_answer(F.col("raw")))
    return rows.select("doc_id", "a.whole", "a.together", "a.kind", judging.grade(F.col("a")).alias("grade"))


_TURNS = "conv_id % 20 AS query_id, turn % 3 AS chunk_id, conv_id * 1000 + turn AS line, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 END AS grade"


@query("f3_clean_sheet_turns", f"SELECT line, query_id, chunk_id, grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY line) AS r FROM (SELECT {_TURNS} FROM conversations) WHERE grade IS NOT NULL) WHERE r = 1")
def _(spark, d):
    return judging.cleaned(read(spark, d, "conversations").selectExpr(*_TURNS.split(", "))).select("line", "query_id", "chunk_id", "grade")


@query("a7_fill_down_turns", "SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations")
def _(spark, d):
    sheet = read(spark, d, "conversations").selectExpr("conv_id", "turn", "turn AS line", "CASE turn % 3 WHEN 0 THEN md5(CAST(text AS BINARY)) WHEN 1 THEN ' ' END AS question")
    return files.filled_down(sheet, "question", ["conv_id"]).select("conv_id", "turn", "question")


@query("a8_split_files", "SELECT lang AS part, CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    """A split as JSON documents of bounded size, one for each thousandth of the ids, written and read back."""
    path = scratch(spark, "split")
    rows = documents(spark, d).where("lang is not null and source is not null")
    lists = rows.groupBy(F.floor(F.col("doc_id") / 1000).alias("part"), "lang").agg(F.collect_list(F.col("doc_id").cast("string")).alias("ids"))
    lists.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("lang", "ids"))).alias("groups")).select("groups").write.json(path)
    return files.exploded_split(spark.read.text(path))


@query("f7_kappa_verdict_events", """
SELECT event_id, CASE WHEN k < 0.0 THEN 'хуже случайного' WHEN k < 0.20 THEN 'ничтожное согласие' WHEN k < 0.40 THEN 'слабое согласие' WHEN k < 0.60 THEN 'умеренное согласие' WHEN k < 0.80 THEN 'существенное согласие' ELSE 'почти полное согласие' END AS verdict
FROM (SELECT event_id, (event_id % 241 - 120) / 120.0::DOUBLE AS k FROM events)""")
def _(spark, d):
    return read(spark, d, "events").select("event_id", judging.kappa_verdict((F.col("event_id") % 241 - 120) / 120.0).alias("verdict"))


# --- models and routes ---


@query("g13_truncated_families", "SELECT 'm' || a.vec_id AS name, 'm' || b.vec_id AS member FROM embeddings a JOIN embeddings b ON a.vec_id // 4 = b.vec_id // 4 AND b.vec_id % 4 <> 0 WHERE a.vec_id % 4 = 0")
def _(spark, d):
    """Each run of four vectors stands for a model and its truncations."""
    m = read(spark, d, "embeddings").selectExpr("concat('m', vec_id) AS name", "concat('path', vec_id div 4) AS path", "vec_id % 4 * 16 AS truncate_dim")
    members = m.where("truncate_dim <> 0").select("path", F.col("name").alias("member"))
    return m.where("truncate_dim = 0").join(members, "path").select("name", "member")


@query("j17_recipe_grid_languages", "SELECT lang, lr, epochs, stage FROM (SELECT DISTINCT lang FROM documents), (SELECT unnest([1e-5, 2e-5]::DOUBLE[]) AS lr), (SELECT unnest([1, 2]) AS epochs), (SELECT unnest(['D', 'E']) AS stage)")
def _(spark, d):
    """The recipes to train for each language of the corpus."""

    def rows(*v):
        return F.explode(F.array(*(F.lit(x) for x in v)))

    return documents(spark, d).select("lang").distinct().select("lang", rows(1e-5, 2e-5).alias("lr")).select("*", rows(1, 2).alias("epochs")).select("*", rows("D", "E").alias("stage"))


@query("i3_clause_routing_acts", f"""
WITH {ACTS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'отброшен' WHEN clause = CAST(1 + doc_id % 4 AS VARCHAR) || '.1' AND doc_id % 2 = 0 THEN 'по пунктам' ELSE 'в пул' END AS route FROM acts""")
def _(spark, d):
    """Questions that name an act and a clause; every second act has one clause that can be labelled."""
    asked = acts(spark, d).selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE number END AS act", "array(clause) AS clauses")
    has = acts(spark, d).where("doc_id % 2 = 0").selectExpr("number AS act", "CAST(1 + doc_id % 4 AS STRING) || '.1' AS clause")
    named = asked.select("doc_id", "act", F.explode("clauses").alias("clause")).join(has, ["act", "clause"], "left_semi").select("doc_id").distinct().withColumn("hit", F.lit(True))
    route = F.when(F.col("act").isNull(), "отброшен").when(F.col("hit"), "по пунктам").otherwise("в пул")
    return asked.join(named, "doc_id", "left").select("doc_id", route.alias("route"))
