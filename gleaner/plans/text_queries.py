"""Queries of the text functions: on literal rows where the wording matters, and over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import stemmer, text
from gleaner.operators import chunking
from gleaner.plans.base import Literal, documents, query, questions, read, tokens_sql

LINES = Literal("id int, s string", [
    (1, "Положение Банка России № 590-П от 28.06.2017"), (2, "  «О порядке»   формирования – резервов  "), (3, "отчётность по форме ИН-03-23/109 и 1/801-п"),
    (4, "кредитно-денежный регулятор 86-ФЗ"), (5, "п. 3.12 Положения № 590-П, абз. 2"), (6, "Basel 2026, IFRS (9)"), (7, ""), (8, None), (9, "(далее — 590-П) и указания от 01.01.2020 № 5348-У, ()"),
    (10, "Каков порядок расчета резерва НФО и ЦБ?"), (11, "Что такое ПВР"), (12, "Каков"), (13, "в этом фрагменте указано что?"), (14, "яка ставка їх банку?"), (15, "What is a bank?"), (16, "12345 !!!"),
    (17, "данный фрагмент говорит о 3.1.3 и 27.03.2020"), (18, "«3054–У» и 3054-У; в соответствии с пунктами 3.9.2, 3.14.1 Инструкции № 138-И"),
])

DASH = r"regexp_replace({0}, '[‐‑‒–—―−]', '-', 'g')"


@query("e1_split_tokens_literals", f"SELECT id, array_to_string({tokens_sql('s')}, ' ') AS tokens FROM {LINES.sql}")
def _(spark, d):
    return LINES.df(spark).select("id", F.array_join(text.split_tokens(F.col("s")), " ").alias("tokens"))


@query("e1_split_tokens_documents", "SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM doctok")
def _(spark, d):
    t = text.split_tokens(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@query("e3_tokenize_documents", "SELECT token, count(*) AS n FROM tok GROUP BY token")
def _(spark, d):
    rows = documents(spark, d).select(F.explode(text.split_tokens(F.col("text"))).alias("token"))
    return stemmer.stemmed(rows).groupBy("token").agg(F.count("*").alias("n"))


WORDS = Literal("token string", [("принципы",), ("принципами",), ("принцип",), ("положение",), ("590-п",), ("basel",), ("нормативы",), ("норматив",), ("отчетности",), ("формирования",)])


@query("e2_stem")
def _(spark, d):
    words = WORDS.df(spark).withColumn("word", F.col("token"))
    return stemmer.stemmed(words).select("word", F.col("token").alias("stem"))


@query("e4_truncate_tokens", "SELECT doc_id, md5(array_to_string([substring(t, 1, 6) for t in tokens], ' ')) AS digest FROM doctok")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.md5(F.array_join(text.truncate_tokens(F.col("text")), " ").cast("binary")).alias("digest"))


# the answers are written out: they follow from the rule, not from another run of it
NORMAL = Literal("id int, normal string", [(10, "порядок расчета резерва некредитная финансовая организация и банк россии?"), (11, "подход на основе внутренних рейтингов"), (12, "Каков"), (15, "What is a bank?"), (7, "")])


@query("e5_normalize_query", f"SELECT * FROM {NORMAL.sql}")
def _(spark, d):
    return LINES.df(spark).where("id in (7, 10, 11, 12, 15)").select("id", text.normalize_query(F.col("s")).alias("normal"))


@query("e9_language_fault", f"""
SELECT id, CASE WHEN c = 0 AND l = 0 THEN 'без букв' WHEN l >= c THEN 'не по-русски' WHEN regexp_matches(s, '[іїєґІЇЄҐ]') THEN 'не по-русски (соседний язык)' END AS fault
FROM (SELECT id, s, len(regexp_extract_all(s, '[а-яёА-ЯЁ]')) AS c, len(regexp_extract_all(s, '[a-zA-Z]')) AS l FROM {LINES.sql}) WHERE s IS NOT NULL""")
def _(spark, d):
    return LINES.df(spark).where("s is not null").select("id", text.language_fault(F.col("s")).alias("fault"))


SELF = Literal("id int, self boolean", [(k, k in (13, 17)) for k, s in LINES.rows if s is not None])


@query("e10_refers_to_itself", f"SELECT * FROM {SELF.sql}")
def _(spark, d):
    return LINES.df(spark).where("s is not null").select("id", text.refers_to_itself(F.col("s")).alias("self"))


@query("e9_language_fault_documents", """
SELECT doc_id, CASE WHEN c = 0 AND l = 0 THEN 'без букв' WHEN l >= c THEN 'не по-русски' WHEN regexp_matches(text, '[іїєґІЇЄҐ]') THEN 'не по-русски (соседний язык)' END AS fault
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[а-яёА-ЯЁ]')) AS c, len(regexp_extract_all(text, '[a-zA-Z]')) AS l FROM documents)""")
def _(spark, d):
    return documents(spark, d).select("doc_id", text.language_fault(F.col("text")).alias("fault"))


@query("e12_good_source", r"""
SELECT doc_id, n >= 500 AND digits / n <= 0.18 AND cited <= n / 200.0 AND dots >= 3 AS good FROM (
  SELECT doc_id, length(b) AS n, len(regexp_extract_all(b, '\d')) AS digits, len(regexp_extract_all(b, 'ст\. ')) + len(regexp_extract_all(b, '№ ')) AS cited, len(regexp_extract_all(b, '\.')) AS dots
  FROM (SELECT doc_id, CASE WHEN instr(text, chr(10) || chr(10)) > 0 THEN substring(text, instr(text, chr(10) || chr(10)) + 2) ELSE text END AS b FROM documents))""")
def _(spark, d):
    return documents(spark, d).select("doc_id", text.good_source(F.col("text"), F.lit("")).alias("good"))


@query("e13_has_act_number", f"SELECT * FROM {Literal('id int, has boolean', [(k, k in (1, 3, 4, 5, 9, 18)) for k, s in LINES.rows if s is not None]).sql}")
def _(spark, d):
    return LINES.df(spark).where("s is not null").select("id", text.has_act_number(F.col("s")).alias("has"))


NAMED = Literal("id int, numbers string", [(1, "590-П"), (2, ""), (3, "ИН-03-23/109,801-П"), (4, "86-ФЗ"), (5, "590-П"), (6, ""), (7, ""), (9, "590-П,5348-У"), (10, ""), (18, "3054-У,138-И")])


@query("e14_act_numbers", f"SELECT * FROM {NAMED.sql}")
def _(spark, d):
    return LINES.df(spark).where("id in (1, 2, 3, 4, 5, 6, 7, 9, 10, 18)").select("id", F.array_join(text.act_numbers(F.col("s")), ",").alias("numbers"))


@query("e15_strip_numbers", f"SELECT * FROM {Literal('id int, bare string', [(1, 'Положение Банка России от 28.06.2017'), (5, 'п. Положения, абз.'), (6, 'Basel 2026, IFRS (9)'), (10, 'Каков порядок расчета резерва НФО и ЦБ?')]).sql}")
def _(spark, d):
    return LINES.df(spark).where("id in (1, 5, 6, 10)").select("id", text.strip_numbers(F.col("s")).alias("bare"))


@query("e16_strip_references", f"SELECT * FROM {Literal('id int, bare string', [(5, ''), (6, 'Basel 2026, IFRS (9)'), (10, 'Каков порядок расчета резерва НФО и ЦБ?')]).sql}")
def _(spark, d):
    return LINES.df(spark).where("id in (5, 6, 10)").select("id", text.strip_references(F.col("s")).alias("bare"))


@query("e17_tidy_documents", r"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\(\s*\)|«\s*»', '', 'g'), ',(\s*,)+', ',', 'g'), '[ \t]{2,}', ' ', 'g'),
 '\s+([,.;:?!)»])', '\1', 'g'), '([(«])\s+', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), ' ,;')) AS digest FROM documents""")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.md5(text.tidy(F.col("text")).cast("binary")).alias("digest"))


@query("c1_norm_line", rf"SELECT doc_id, md5(trim(regexp_replace({DASH.format('text')}, '\s+', ' ', 'g'))) AS digest FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.md5(text.norm_line(F.col("text")).cast("binary")).alias("digest"))


NUMBERS = Literal("id int, n string", [(1, "590 – п"), (2, "1/801‑П"), (3, " 3054-у "), (4, ""), (5, "ИН-03-23/109")])


@query("c2_normalize_number", rf"SELECT id, upper(regexp_replace({DASH.format('n')}, '\s+', '', 'g')) AS number FROM {NUMBERS.sql}")
def _(spark, d):
    return NUMBERS.df(spark).select("id", text.normalize_number(F.col("n")).alias("number"))


SPLIT = Literal("id int, s string", [(1, "регули-\nрование"), (2, "а-\nб-\nв"), (3, "Банк-\nРоссии"), (4, "no-\nbreak and и-\nя"), (5, "1-\n2")])
_JOIN = r"regexp_replace({0}, '([а-яёa-z])-\n([а-яёa-z])', '\1\2', 'g')"


@query("c3_dehyphenate", f"SELECT id, {_JOIN.format(_JOIN.format('s'))} AS joined FROM {SPLIT.sql}")
def _(spark, d):
    return SPLIT.df(spark).select("id", text.dehyphenate(F.col("s")).alias("joined"))


@query("c3_dehyphenate_documents", f"SELECT doc_id, md5({_JOIN.format(_JOIN.format('text'))}) AS digest FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.md5(text.dehyphenate(F.col("text")).cast("binary")).alias("digest"))


ACTS = Literal("id int, number string, date string", [(1, "590-П", "28.06.2017"), (2, "ИН-03-23/109", "01.02.2023"), (3, "1/801–П", "05.05.202x"), (4, "86", "")])


@query("c8_type_and_year", rf"SELECT id, regexp_replace(number, '^.*?[-–]', '') AS type, CASE WHEN regexp_matches(right(date, 4), '^\d{{4}}$') THEN CAST(right(date, 4) AS INTEGER) ELSE 0 END AS year FROM {ACTS.sql}")
def _(spark, d):
    return ACTS.df(spark).select("id", text.act_type(F.col("number")).alias("type"), text.year(F.col("date")).alias("year"))


@query("c11_text_verdict", r"""
SELECT doc_id, chars, CASE WHEN chars / pages < 400 THEN 'скан без текстового слоя' WHEN cyr < 0.9 THEN 'скан с латинским OCR' ELSE 'цифровой' END AS verdict FROM (
 SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS chars, 1 + doc_id % 3 AS pages, CASE WHEN c + l > 0 THEN c / (c + l) ELSE 0 END AS cyr
 FROM (SELECT *, len(regexp_extract_all(text, '[а-яёА-ЯЁ]')) AS c, len(regexp_extract_all(text, '[a-zA-Z]')) AS l FROM documents))""")
def _(spark, d):
    chars, pages = F.length(F.trim(F.regexp_replace("text", r"\s+", " "))), 1 + F.col("doc_id") % 3
    return documents(spark, d).select("doc_id", chars.cast("long").alias("chars"), text.text_verdict(chars, pages, text.cyrillic_share(F.col("text"))).alias("verdict"))


CLAUSES = Literal("id int, clauses array<string>", [(1, ["3.1.3", "27.03.2020", "12"]), (2, ["1.2", "3.7.2.2"]), (3, [])])


@query("e18_clean_clauses", rf"SELECT id, array_to_string([c for c in clauses if regexp_full_match(c, '\d{{1,3}}(\.\d{{1,3}})+')], ',') AS kept FROM {CLAUSES.sql}")
def _(spark, d):
    return CLAUSES.df(spark).select("id", F.array_join(text.clean_clauses(F.col("clauses")), ",").alias("kept"))


ASKED = Literal("id int, acts array<string>, text string", [(1, ["590-П"], "по 611-П"), (2, [], "как считать по 611-П и 590-П?"), (3, ["999-П"], "без номера"), (4, ["999-П"], "см. 590-П")])
CORPUS = Literal("number string", [("590-П",), ("611-П",)])


@query("e19_act_of", rf"""
WITH q AS (SELECT id, list_concat(acts, regexp_extract_all(text, '\d{{1,4}}(?:/\d+)?-[А-ЯЁ]{{1,2}}')) AS named FROM {ASKED.sql})
SELECT id, ([n for n in named if n IN ('590-П', '611-П')])[1] AS act FROM q""")
def _(spark, d):
    named = ASKED.df(spark).select("id", F.posexplode(F.concat("acts", F.regexp_extract_all("text", F.lit(r"(?U)\b(\d{1,4}(?:/\d+)?-[А-ЯЁ]{1,2})\b"), F.lit(1)))).alias("pos", "number"))
    found = named.join(F.broadcast(CORPUS.df(spark)), "number").groupBy("id").agg(F.min_by("number", "pos").alias("act"))
    return ASKED.df(spark).select("id").join(found, "id", "left")


BODIES = Literal("id int, body string, clause string", [(1, "3.1.3. Банк обязан", "3.1.3"), (2, "см. п. 3.1.3. и далее", "3.1.3"), (3, "x\n  3.1. Текст", "3.1"), (4, "3x1. Текст", "3.1"), (5, "3.1.3 Текст", "3.1.3")])


@query("e20_starts_clause", rf"SELECT id, regexp_matches(body, '(?:^|\n)\s*' || replace(clause, '.', '\.') || '\.\s') AS starts FROM {BODIES.sql}")
def _(spark, d):
    return BODIES.df(spark).select("id", text.starts_clause(F.col("body"), F.col("clause")).alias("starts"))


@query("e22_assign_ids", """
WITH known AS (SELECT text, 'exp' || lpad(CAST(min(item_id) AS VARCHAR), 4, '0') AS qid FROM benchmark GROUP BY text),
fresh AS (SELECT DISTINCT text FROM conversations WHERE role = 'user' AND text NOT IN (SELECT text FROM benchmark)),
top AS (SELECT max(CAST(substring(qid, 4) AS BIGINT)) AS m FROM known)
SELECT text, qid FROM known UNION ALL SELECT text, 'exp' || lpad(CAST(m + row_number() OVER (ORDER BY md5(text), text) AS VARCHAR), CAST(greatest(4, length(CAST(m + row_number() OVER (ORDER BY md5(text), text) AS VARCHAR))) AS INTEGER), '0') FROM fresh, top""")
def _(spark, d):
    """Known texts keep their id, new ones get the next free numbers. The order is global, so ranks come from two steps: within a hash range, then by range."""
    from gleaner.operators.ids import numbered

    known = questions(spark, d).groupBy("text").agg(F.min("query_id").alias("n"))
    fresh = read(spark, d, "conversations").where("role = 'user'").select("text").distinct().join(known, "text", "left_anti")
    top = known.agg(F.max("n").alias("m"))
    new = numbered(fresh.withColumn("h", F.md5(F.col("text").cast("binary"))), ["h", "text"], "i").crossJoin(F.broadcast(top)).select("text", (F.col("m") + F.col("i")).alias("n"))
    width = F.greatest(F.lit(4), F.length(F.col("n").cast("string")))
    return known.union(new).select("text", F.concat(F.lit("exp"), F.lpad(F.col("n").cast("string"), width, F.lit("0"))).alias("qid"))


@query("e24_number_shape", rf"SELECT id, regexp_replace(regexp_replace(n, '\d+', '9+', 'g'), '[A-Za-zА-ЯЁа-яё]+', 'A+', 'g') AS shape FROM {NUMBERS.sql}")
def _(spark, d):
    return NUMBERS.df(spark).select("id", text.shape(F.col("n")).alias("shape"))


@query("e25_slug", f"SELECT * FROM {Literal('id int, slug string', [(1, 'polozhenie-banka-rossii-590-p-ot-28-06-2017'), (6, 'basel-2026-ifrs-9'), (7, '')]).sql}")
def _(spark, d):
    return LINES.df(spark).where("id in (1, 6, 7)").select("id", text.slug(F.col("s")).alias("slug"))


@query("e26_question_key", r"SELECT conv_id, turn, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS key FROM conversations")
def _(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", F.md5(text.question_key(F.col("text")).cast("binary")).alias("key"))


ANSWERS = Literal("id int, s string", [(1, "- «Какой порядок?»\nпояснение"), (2, '"Что делать?"'), (3, "  — Вопрос"), (4, "plain")])


@query("e27_clean_answer", f"SELECT * FROM {Literal('id int, clean string', [(1, 'Какой порядок?'), (2, 'Что делать?'), (3, 'Вопрос'), (4, 'plain')]).sql}")
def _(spark, d):
    return ANSWERS.df(spark).select("id", text.clean_answer(F.col("s")).alias("clean"))


@query("e28_probability_and_logit", """
SELECT event_id, round(1 / (1 + exp(-s)), 9) AS p, round(ln(least(greatest(u, 1e-6), 1 - 1e-6) / (1 - least(greatest(u, 1e-6), 1 - 1e-6))), 9) AS logit FROM (
 SELECT event_id, (event_id % 41 - 20) / 2.0 AS s, (event_id % 11) / 10.0 AS u FROM events)""")
def _(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.round(text.sigmoid((F.col("event_id") % 41 - 20) / 2), 9).alias("p"), F.round(text.logit((F.col("event_id") % 11) / 10), 9).alias("logit"))


@query("e28_detect_scale", "SELECT event_type, CASE WHEN min(value) >= 0 AND max(value) <= 1 THEN 'sigmoid' ELSE 'logit' END AS scale FROM events GROUP BY event_type")
def _(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.when((F.min("value") >= 0) & (F.max("value") <= 1), "sigmoid").otherwise("logit").alias("scale"))


@query("e29_provenance", "SELECT doc_id, md5(text) AS md5 FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


_TAGS = "regexp_replace(html, '<[^>]+>', '{0}', 'g')"
_ENTITIES = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query("a12_html_text", r"SELECT page_id, md5(trim(regexp_replace(" + _ENTITIES.format(_TAGS.format(" ")) + r", '\s+', ' ', 'g'))) AS digest FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(text.html_text(F.col("html")).cast("binary")).alias("digest"))


@query("a12b_html_text_no_gap", r"SELECT page_id, md5(trim(regexp_replace(" + _ENTITIES.format(_TAGS.format("")) + r", '\s+', ' ', 'g'))) AS digest FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(text.html_text(F.col("html"), "").cast("binary")).alias("digest"))


@query("d12_body_of", "SELECT page_id, md5(CASE WHEN instr(html, chr(10) || chr(10)) > 0 THEN substring(html, instr(html, chr(10) || chr(10)) + 2) ELSE html END) AS digest FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(text.body_of(F.col("html")).cast("binary")).alias("digest"))


@query("d13_heading_share", "SELECT doc_id, CASE WHEN instr(text, chr(10)) > 0 THEN round((instr(text, chr(10)) - 1) / length(text), 6) END AS share FROM documents")
def _(spark, d):
    at = F.instr("text", "\n")
    return documents(spark, d).select("doc_id", F.when(at > 0, F.round((at - 1) / F.length("text"), 6)).alias("share"))


@query("d1_count_tokens", "SELECT doc_id, CAST(greatest(1, floor(length(text) / 3.2)) AS INTEGER) AS n FROM documents")
def _(spark, d):
    return documents(spark, d).select("doc_id", chunking.count_tokens(F.col("text")).alias("n"))


@query("d3_calibrate", "SELECT lang, round(sum(length(text)) / sum(greatest(1, floor(length(text) / 3.2))), 6) AS chars_per_token FROM documents GROUP BY lang")
def _(spark, d):
    return documents(spark, d).groupBy("lang").agg(F.round(F.sum(F.length("text")) / F.sum(chunking.count_tokens(F.col("text"))), 6).alias("chars_per_token"))


TOPIC = Literal("id int, section string, acts array<string>", [
    (1, "Форма 0409101", []), (2, "", ["115-ФЗ"]), (3, "Информационные сообщения", ["x"]), (4, "Пандемия", []), (5, "Национальная платежная система", []), (6, "Прочее", ["999-П"]), (7, None, None)
])
TOPIC_OF = Literal("id int, topic string", [
    (1, "форма отчетности"), (2, "федеральный закон"), (3, "письмо или информационное сообщение"), (4, "мера поддержки или разъяснение без акта"), (5, "акт не назван ни в разделе, ни в вопросе"), (6, "назван акт, которого нет в корпусе"), (7, "акт не назван ни в разделе, ни в вопросе")
])


@query("e23_topic", f"SELECT * FROM {TOPIC_OF.sql}")
def _(spark, d):
    return TOPIC.df(spark).select("id", text.topic(F.col("section"), F.col("acts")).alias("topic"))


CLAUSED = Literal("id int, s string", [(1, "пп. 3.12.2.8 и п. 3.10, 3.10"), (2, "пункт 5"), (3, "п.п. 3.13 и 3.14 Инструкции"), (4, "от 27.03.2020")])


@query("e21_clause_numbers", f"SELECT * FROM {Literal('id int, clauses string', [(1, '3.12.2.8,3.10'), (2, ''), (3, '3.13,3.14'), (4, '')]).sql}")
def _(spark, d):
    return CLAUSED.df(spark).select("id", F.array_join(text.clause_numbers(F.col("s")), ",").alias("clauses"))


HEADED = Literal("id int, s string", [(1, "Указание Банка России № 1-У от 01.01.2020. О\n\nтело\n\nещё"), (2, "Другое\n\nтело"), (3, "без шапки")])


@query("d12b_body_under_formula", f"SELECT * FROM {Literal('id int, body string', [(1, 'тело' + chr(10) * 2 + 'ещё'), (2, 'Другое' + chr(10) * 2 + 'тело'), (3, 'без шапки')]).sql}")
def _(spark, d):
    return HEADED.df(spark).select("id", text.body_under_formula(F.col("s"), F.lit("1-У"), F.lit("01.01.2020")).alias("body"))


SHEETS = Literal("id int, otsenka_0_1_2 string, otvet_celikom string, otvet1_celikom string, otvet_vmeste string, otvet2_vmeste string", [
    (1, "2", "", None, "", None), (2, "", "Да", None, "", None), (3, None, None, "нет", None, "ДА "), (4, "", "нет", None, "нет", None), (5, "", "нет", None, "", None), (6, "7", "", "", "", "")
])


@query("a6_sheet_dialects", f"SELECT * FROM {Literal('id int, grade int', [(1, 2), (2, 2), (3, 1), (4, 0), (5, None), (6, None)]).sql}")
def _(spark, d):
    from gleaner.operators.judging import sheet_grade

    return SHEETS.df(spark).select("id", sheet_grade().alias("grade"))


@query("d2_offsets", "SELECT doc_id, CAST(ceil(length(text) / 3.0) AS BIGINT) AS n, CAST(length(text) - 3 * (ceil(length(text) / 3.0) - 1) AS BIGINT) AS last FROM documents WHERE text <> ''")
def _(spark, d):
    n = F.ceil(F.length("text") / chunking.STEP)
    return documents(spark, d).where("text <> ''").select("doc_id", n.cast("long").alias("n"), (F.length("text") - chunking.STEP * (n - 1)).cast("long").alias("last"))


@query("g11_encoder_stub", """
SELECT doc_id, [CAST(len([1 for t in tokens if ('0x' || substring(md5(t), 1, 8))::UBIGINT % 16 = i]) AS DOUBLE) for i in range(16)] AS embedding FROM doctok""")
def _(spark, d):
    from gleaner.operators.models import hash_embedding

    return documents(spark, d).select("doc_id", hash_embedding(F.col("text")).alias("embedding"))


@query("f13_judge_stub", """
WITH s AS (SELECT r.query_id, r.doc_id, len(list_intersect(list_distinct(q.tokens), t.tokens)) / greatest(len(list_distinct(q.tokens)), 1) AS share FROM run_words r JOIN questok q USING (query_id) JOIN doctok t USING (doc_id) WHERE rank <= 10)
SELECT query_id, doc_id, CASE WHEN share >= 0.5 THEN 2 WHEN share >= 0.25 THEN 1 ELSE 0 END AS grade FROM s""")
def _(spark, d):
    """The judging loop with a stub for the model: answers as text, parsed and graded."""
    from gleaner.operators.judging import grade, parse_answer
    from gleaner.operators.models import overlap_judge
    from gleaner.plans.base import run_words, texts_of

    q = questions(spark, d).withColumnRenamed("text", "question")
    run = run_words(spark, d, 10).select("query_id", "doc_id")
    pairs = run.join(q, "query_id").join(texts_of(documents(spark, d).select("doc_id", "text"), run), "doc_id")
    return pairs.select("query_id", "doc_id", grade(parse_answer(overlap_judge(F.col("question"), F.col("text")))).alias("grade"))
