"""Control of question generation: batches in a seeded order, the least-used style next, a cap on what a source's act gives.

Only accepted questions use up an act's places and a style's turn, so each batch depends on the verdicts of those before:
batches follow one another, but each is a Spark job, and all that the driver holds is a count for each style. Sources and
batches are files; a run that broke off goes on after its last whole batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import language_fault, refers_to_itself, split_tokens
from gleaner.operators.copying import longest_runs
from gleaner.operators.ids import numbered
from gleaner.sources.durable import cut, exists


@dataclass(frozen=True)
class Style:
    name: str
    asks: bool = True  # whether its questions must end with a question mark


# The limits of a question.
LEAST_TOKENS, MOST_RUN, MOST_SHARE, LEAST_IDF = 4, 5, 0.6, 3.0


def idf_of(questions: DataFrame, df: DataFrame, n: int, key: str, text: str = "question") -> DataFrame:
    """key, mean_idf, tokens of questions; df: token, df over the whole corpus of n documents."""
    tokens = questions.select(key, F.explode(split_tokens(F.col(text))).alias("token"))
    asked = F.broadcast(tokens.select("token").distinct())  # of one batch
    known = tokens.join(F.broadcast(df.join(asked, "token", "left_semi").select("token", "df")), "token", "left")
    return known.groupBy(key).agg(F.avg(F.ln((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1))).alias("mean_idf"), F.count("*").alias("tokens"))


def judged(rows: DataFrame, asks: bool, df: DataFrame, n: int, key: str, russian: bool = True) -> DataFrame:
    """rows (key, body, question) with reason, the first rule that a question breaks, or null.

    russian: whether a question must be in Russian, as it must where the corpus is.
    """
    q = rows.select(F.col(key).alias("query_id"), F.col("question").alias("text"))
    copied = longest_runs(q, rows.select(F.col(key).alias("doc_id"), F.col("body").alias("text")), rows.select(F.col(key).alias("query_id"), F.col(key).alias("doc_id")))
    facts = rows.join(F.broadcast(copied.select(F.col("query_id").alias(key), "run", "share")), key, "left").join(F.broadcast(idf_of(rows, df, n, key)), key, "left")
    text, run, share = F.col("question"), F.coalesce("run", F.lit(0)), F.coalesce("share", F.lit(0.0))
    reason = (
        F.when(F.lit(russian) & language_fault(text).isNotNull(), language_fault(text)).when(refers_to_itself(text), "refers to itself")
        .when(F.coalesce("tokens", F.lit(0)) < LEAST_TOKENS, "too short").when(F.lit(asks) & ~F.trim(text).endswith("?"), "no question")
        .when((run > MOST_RUN) | (share > MOST_SHARE), "copied").when(F.coalesce("mean_idf", F.lit(0.0)) < LEAST_IDF, "too common")
    )
    return facts.select(*rows.columns, reason.alias("reason"))


def next_style(counts: dict[str, int], styles: tuple[Style, ...]) -> Style:
    """The style of fewest accepted questions, the first of several."""
    return min(styles, key=lambda s: counts.get(s.name, 0))


class Generation:
    """A run of generation in a folder.

    sources: key, act, body of the fragments that can carry a question (each key once); write: (rows, style) -> rows with
    `question`, a model's or a stub's; judge: (rows, style) -> rows with `reason`, null for what is accepted.
    """

    def __init__(self, spark: SparkSession, folder: str, styles: tuple[Style, ...], write: Callable[[DataFrame, Style], DataFrame], judge: Callable[[DataFrame, Style], DataFrame],
                 key: str = "doc_id", per_act: int = 12, batch: int = 256, seed: int = 13, prefix: str = "syn"):
        self.spark, self.folder, self.styles, self.write, self.judge = spark, folder, styles, write, judge
        self.key, self.per_act, self.batch, self.seed, self.prefix = key, per_act, batch, seed, prefix

    def _sources(self, sources: DataFrame) -> DataFrame:
        """The sources by place in the seeded order; files cover stretches of places, so a batch reads a few row groups."""
        path = f"{self.folder}/sources"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            order = F.md5(F.concat(F.lit(f"{self.seed}|"), F.col(self.key).cast("string")).cast("binary"))
            placed = numbered(sources.select(self.key, "act", "body").withColumn("_order", order), ["_order", self.key], "place").drop("_order")
            placed.repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @property
    def attempts(self) -> DataFrame | None:
        """All questions written so far: batch, place, key, act, style, question, reason, number (of an accepted one)."""
        path = f"{self.folder}/batches"
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def _state(self) -> tuple[int, int, dict[str, int]]:
        """(the next batch, the place of the last source that was taken, accepted questions by style): a row for each style."""
        rows = self.attempts
        if rows is None:
            return 0, 0, {}
        told = rows.groupBy("style").agg(F.max("batch").alias("b"), F.max("place").alias("p"), F.count("number").alias("n")).collect()
        return max(r.b for r in told) + 1, max(r.p for r in told), {r.style: r.n for r in told}

    def _next(self, sources: DataFrame, after: int, last: int) -> DataFrame | None:
        """The next batch of sources whose acts have places left; None when there are none."""
        left = sources
        if (rows := self.attempts) is not None:
            full = rows.where("number is not null").groupBy("act").agg(F.count("*").alias("c")).where(F.col("c") >= self.per_act)
            # full acts are as many as target / per_act at most
            left = left.join(F.broadcast(full.select(F.col("act").alias("_full"))), F.col("act").eqNullSafe(F.col("_full")), "left_anti")
        span = 2 * self.batch
        while True:
            picked = cut(left.where((F.col("place") > after) & (F.col("place") <= after + span)).orderBy("place").limit(self.batch))
            n = picked.count()
            if n == self.batch or after + span >= last:
                return picked if n else None
            span *= 4

    def run(self, sources: DataFrame, target: int) -> DataFrame:
        """query_id, style, question, key, act of `target` accepted questions, or of as many as the sources give."""
        placed = self._sources(sources)
        last = placed.agg(F.max("place")).first()[0] or 0
        number, at, counts = self._state()
        while sum(counts.values()) < target and (picked := self._next(placed, at, last)) is not None:
            style, have = next_style(counts, self.styles), sum(counts.values())
            made = cut(self.judge(self.write(picked, style), style).select("place", self.key, "act", F.lit(style.name).alias("style"), "question", "reason"))
            said = numbered_batch(made, have, self.batch).where(F.col("before") < target)
            said.drop("before").write.mode("overwrite").parquet(f"{self.folder}/batches/batch={number}")
            number, at, counts = self._state()
        return self.accepted()

    def accepted(self) -> DataFrame:
        rows = self.attempts
        if rows is None:
            return self.spark.createDataFrame([], "query_id string, style string, question string").limit(0)
        return rows.where("number is not null").select(F.format_string(f"{self.prefix}%05d", F.col("number") - 1).alias("query_id"), "style", "question", self.key, "act")

    def report(self) -> DataFrame:
        """style, reason (null: accepted), n."""
        return self.attempts.groupBy("style", "reason").agg(F.count("*").alias("n"))


def numbered_batch(rows: DataFrame, have: int, most: int) -> DataFrame:
    """rows of one batch (`most` at most) with number, the running number of what is accepted, and before, how many were accepted before a row."""
    from pyspark.sql import Window

    so_far = F.sum(F.col("reason").isNull().cast("int")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) + have
    ok = F.col("reason").isNull()
    return rows.limit(most).withColumn("_n", so_far).select("*", F.when(ok, F.col("_n")).cast("long").alias("number"), (F.col("_n") - ok.cast("int")).alias("before")).drop("_n")


def every_second_word(first: int, count: int, mark: str) -> Callable[[Column], Column]:
    """A stub generator: every second word of a body from place `first` on, with a mark at the end."""

    def write(body: Column) -> Column:
        words = F.split(F.trim(body), r"\s+")
        places = F.sequence(F.lit(first), F.lit(first + 2 * (count - 1)), F.lit(2))
        return F.concat(F.array_join(F.transform(places, lambda i: F.get(words, i)), " "), F.lit(mark))

    return write
