"""Rows from catalog pages, and acts from the pages of an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import dehyphenate, html_text, norm_line, normalize_number

# Kinds of acts and the forms of their lines.
KINDS = "ПОЛОЖЕНИЕ|ИНСТРУКЦИЯ|УКАЗАНИЕ|МЕТОДИЧЕСКИЕ РЕКОМЕНДАЦИИ|ОФИЦИАЛЬНОЕ РАЗЪЯСНЕНИЕ|ПИСЬМО"
KIND_LINE = rf"(?iU)^({KINDS})(\s+БАНКА\s+РОССИИ)?$"
NUMBER_LINE = r"(?U)^№\s*([\d/]+-[А-ЯЁ]{1,3})$"
PAGE_NUMBER = r"^\d{1,4}$"


def elements(html: Column, tag: str) -> Column:
    """The insides of all elements of a tag."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, text of every link."""
    found = F.regexp_extract_all("html", F.lit(r"""(?is)(<a\b[^>]*>.*?</a>)"""), F.lit(1))
    a = pages.select("page_id", F.posexplode(found).alias("pos", "a"))
    return a.select("page_id", "pos", F.regexp_extract("a", r"""(?is)href\s*=\s*["']([^"']*)["']""", 1).alias("href"), html_text(F.col("a")).alias("text"))


def table_rows(pages: DataFrame, least: int = 4) -> DataFrame:
    """page_id, pos, cells array<string> of table rows with at least `least` cells."""
    rows = pages.select("page_id", F.posexplode(elements(F.col("html"), "tr")).alias("pos", "row"))
    return rows.select("page_id", "pos", F.transform(elements(F.col("row"), "td"), lambda c: html_text(c)).alias("cells")).where(F.size("cells") >= least)


def chrome_lines(lines: DataFrame, share: float = 0.30, most: int = 120) -> DataFrame:
    """issue, line: short lines that stand on many pages of an issue.

    lines: issue, page, n, line.
    """
    pages = lines.groupBy("issue").agg(F.countDistinct("page").alias("pages"))
    seen = lines.where((F.col("line") != "") & (F.length("line") <= most)).groupBy("issue", "line").agg(F.countDistinct("page").alias("on"))
    return seen.join(pages, "issue").where(F.col("on") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))).select("issue", "line")


def act_starts(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """issue, page, n, number, kind, title: where acts begin.

    A line with a kind opens the act whose number line stands nearest on the page (else among the first 20 lines of
    the next one), if the issue's listing (expected: issue, number) has it; its first opening counts.
    """
    size = lines.groupBy("issue", "page").agg((F.max("n") + 1).alias("size"))
    kind = lines.where(F.col("line").rlike(KIND_LINE)).select("issue", "page", "n", F.upper(F.regexp_extract("line", KIND_LINE, 1)).alias("kind")).join(size, ["issue", "page"])
    number = lines.where(F.col("line").rlike(NUMBER_LINE)).select("issue", F.col("page").alias("p2"), F.col("n").alias("n2"), normalize_number(F.regexp_extract("line", NUMBER_LINE, 1)).alias("number"))
    same, next_ = F.col("p2") == F.col("page"), (F.col("p2") == F.col("page") + 1) & (F.col("n2") < 20)
    both = kind.join(number, "issue").where(same | next_)
    away = F.when(same, F.abs(F.col("n2") - F.col("n"))).otherwise(F.col("size") + F.col("n2"))
    best = both.groupBy("issue", "page", "n", "kind").agg(F.min(F.struct(F.when(same, 0).otherwise(1).alias("later"), away.alias("away"), "number")).alias("m"))
    best = best.select("issue", "page", "n", "kind", F.col("m.number").alias("number")).join(expected, ["issue", "number"], "left_semi")
    first = Window.partitionBy("issue", "number").orderBy("page", "n")
    best = best.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    after = lines.select("issue", "page", F.col("n").alias("n3"), "line")
    near = best.join(after, ["issue", "page"], "left").where("n3 > n and n3 <= n + 5")
    stop = (F.col("line") == "") | F.col("line").rlike(NUMBER_LINE) | F.col("line").rlike(PAGE_NUMBER)
    w = Window.partitionBy("issue", "page", "n").orderBy("n3").rowsBetween(Window.unboundedPreceding, 0)
    head = near.withColumn("stopped", F.max(stop.cast("int")).over(w)).where("stopped = 0")
    title = head.groupBy("issue", "page", "n").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n3", "line")))["line"], " ").alias("title"))
    return best.join(title, ["issue", "page", "n"], "left").select("issue", "page", "n", "number", "kind", F.coalesce(F.btrim("title", F.lit("“”\"«» ")), F.lit("")).alias("title"))


def split_issue(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """issue, number, kind, title, text: lines from each start to the next one, without page furniture, joined."""
    lines = lines.select("issue", "page", "n", norm_line(F.col("line")).alias("line"))
    starts = act_starts(lines, expected)
    marked = lines.join(starts, ["issue", "page", "n"], "left")
    w = Window.partitionBy("issue").orderBy("page", "n").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("act", F.last("number", ignorenulls=True).over(w)).where("act is not null")
    body = marked.join(chrome_lines(lines), ["issue", "line"], "left_anti").where((F.col("line") != "") & ~F.col("line").rlike(PAGE_NUMBER))
    text = body.groupBy("issue", F.col("act").alias("number")).agg(F.sort_array(F.collect_list(F.struct("page", "n", "line")))["line"].alias("all"))
    joined = text.select("issue", "number", F.trim(dehyphenate(F.array_join("all", "\n"))).alias("text"))
    return starts.join(joined, ["issue", "number"], "left").select("issue", "number", "kind", "title", F.coalesce("text", F.lit("")).alias("text"))


def split_check(expected: DataFrame, found: DataFrame) -> DataFrame:
    """issue, hit, miss, extra: numbers that were listed and found, only listed, only found."""
    e, f = expected.select("issue", "number").distinct().withColumn("e", F.lit(1)), found.select("issue", "number").distinct().withColumn("f", F.lit(1))
    both = e.join(f, ["issue", "number"], "full_outer")
    return both.groupBy("issue").agg(F.count_if((F.col("e") == 1) & (F.col("f") == 1)).alias("hit"), F.count_if(F.col("f").isNull()).alias("miss"), F.count_if(F.col("e").isNull()).alias("extra"))
