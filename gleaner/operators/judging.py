"""Judges' answers, votes between judges, agreement and samples for humans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The forms of an answer.
NUMBERED = r"(?iUm)^\s*(?:вопрос\s*)?{}\s*[:.)]\s*(да|нет|-)"
KIND = r"(?iU)\bтип\s*[:.)]\s*(общая|часть|иное|-)"
BARE = r"(?iU)(?<![а-яё])(да|нет|-)(?![а-яё])"
KINDS = ("общая", "часть", "иное")


def parse_answer(raw: Column) -> Column:
    """struct<whole boolean, together boolean, kind string>, null if no answer can be read.

    Numbered answers count (the last of a number wins); where one is missing, the first two bare answers before the
    word for the kind stand in. The second answer matters only if the first is no.
    """

    def numbered(k):
        found = F.regexp_extract_all(raw, F.lit(NUMBERED.format(k)), F.lit(1))
        return F.when(F.size(found) > 0, F.lower(F.element_at(found, -1)))

    head = F.split(raw, r"(?iU)\bтип\b", 2)[0]
    bare = F.transform(F.regexp_extract_all(head, F.lit(BARE), F.lit(1)), lambda x: F.lower(x))
    enough = F.size(bare) >= 2
    first, second = F.coalesce(numbered(1), F.when(enough, F.get(bare, F.lit(0)))), F.coalesce(numbered(2), F.when(enough, F.get(bare, F.lit(1))))
    whole, together = first == "да", F.coalesce(second == "да", F.lit(False))
    kind = F.lower(F.regexp_extract(raw, KIND, 1))
    kind = F.when(kind.isin(*KINDS) & ~whole & together, kind).otherwise("-")
    fits = first.isin("да", "нет") & (whole | F.coalesce(second.isin("да", "нет"), F.lit(False)))
    return F.when(fits, F.struct(whole.alias("whole"), together.alias("together"), kind.alias("kind")))


def grade(answer: Column) -> Column:
    return F.when(answer["whole"], 2).when(answer["together"], 1).when(answer.isNotNull(), 0)


def cleaned(sheet: DataFrame) -> DataFrame:
    """The first row of each (query_id, chunk_id) with a grade; order of rows: line."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy("line")
    return sheet.where("grade is not null and query_id is not null and chunk_id is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def vote(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, doc_id, a, b, verdict: agreed, disputed, only a or only b."""
    x, y = a.select("query_id", "doc_id", F.col("grade").alias("a")), b.select("query_id", "doc_id", F.col("grade").alias("b"))
    both = x.join(y, ["query_id", "doc_id"], "full_outer")
    verdict = F.when(F.col("b").isNull(), "only a").when(F.col("a").isNull(), "only b").when(F.col("a") == F.col("b"), "agreed").otherwise("disputed")
    return both.withColumn("verdict", verdict)


def confusion(votes: DataFrame, grades=(0, 1, 2)) -> DataFrame:
    """One row for each grade of a, a column for each grade of b."""
    out = votes.where("a is not null and b is not null").groupBy("a").pivot("b", list(grades)).count()
    return out.select("a", *(F.coalesce(F.col(str(g)), F.lit(0)).alias(f"b{g}") for g in grades))


def kappa(votes: DataFrame, weighted: bool = False) -> DataFrame:
    """n, kappa of the pairs that both judged: agreement beyond chance, with quadratic weights over the span of labels if weighted.

    Only the table of counts (labels x labels) is ever paired with itself.
    """
    cell = votes.where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("c"))
    ends = cell.agg(F.greatest(F.max("a"), F.max("b")).alias("hi"), F.least(F.min("a"), F.min("b")).alias("lo"), F.sum("c").alias("n"))
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    off = F.pow((F.col("a") - F.col("b")) / span, F.lit(2.0)) if weighted else (F.col("a") != F.col("b")).cast("double")
    ca, cb = cell.groupBy("a").agg(F.sum("c").alias("ca")), cell.groupBy("b").agg(F.sum("c").alias("cb"))
    seen = cell.crossJoin(F.broadcast(ends)).agg(F.sum(off * F.col("c") / F.col("n")).alias("observed"), F.max("n").alias("n"))
    chance = ca.crossJoin(F.broadcast(cb)).crossJoin(F.broadcast(ends)).agg(F.sum(off * F.col("ca") * F.col("cb") / (F.col("n") * F.col("n"))).alias("expected"))
    value = F.when(F.col("expected") == 0, F.when(F.col("observed") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("observed") / F.col("expected"))
    return seen.crossJoin(F.broadcast(chance)).select("n", F.round(value, 6).alias("kappa"))


def kappa_verdict(k: Column) -> Column:
    return (
        F.when(k < 0.0, "хуже случайного").when(k < 0.20, "ничтожное согласие").when(k < 0.40, "слабое согласие")
        .when(k < 0.60, "умеренное согласие").when(k < 0.80, "существенное согласие").otherwise("почти полное согласие")
    )


def stratified(items: DataFrame, stratum: str, key: str, size: int, seed: int = 13) -> DataFrame:
    """`size` rows: an equal share of each stratum by md5 order, topped up from the rest by md5 order."""
    placed = items.withColumn("_o", F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")))
    share = max(1, size // max(1, items.agg(F.countDistinct(stratum)).first()[0]))
    # the number of rows kept is known, so each task keeps as many of a stratum at most
    head = placed.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_o", key))).where(F.col("_r") <= share).drop("_r")
    head = head.orderBy("_o", key).limit(size)
    rest = placed.orderBy("_o", key).limit(2 * size).join(head.select(key), key, "left_anti")
    both = head.withColumn("_late", F.lit(0)).union(rest.select(*head.columns, F.lit(1)))
    return both.orderBy("_late", "_o", key).limit(size).drop("_o", "_late")


def sheet_grade(row: dict[str, Column] | None = None) -> Column:
    """The grade of a sheet row in either dialect: the filled mark, else from the two answers under their old or numbered names."""
    row = row or {n: F.col(n) for n in ("otsenka_0_1_2", "otvet_celikom", "otvet1_celikom", "otvet_vmeste", "otvet2_vmeste")}

    def filled(*names):
        return F.lower(F.coalesce(*(F.nullif(F.trim(row[n]), F.lit("")) for n in names), F.lit("")))

    mark = F.trim(row["otsenka_0_1_2"])
    first, second = filled("otvet_celikom", "otvet1_celikom"), filled("otvet_vmeste", "otvet2_vmeste")
    return (
        F.when(mark.isin("0", "1", "2"), mark.cast("int")).when(first == "да", 2)
        .when((first == "нет") & (second == "да"), 1).when((first == "нет") & (second == "нет"), 0)
    )
