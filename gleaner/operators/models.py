"""Places where a neural model plugs in: encoders, scorers, judges and generators, each a function over Arrow-backed batches.

The stubs are deterministic and stand in where no model is at hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let, split_tokens

Encoder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[tuple[str, str]]], list[float]]
Judge = Callable[[list[tuple[str, str]]], list[str]]
Generator = Callable[[list[str]], list[str]]


def encoded(texts: DataFrame, encoder: Encoder, prefix: str = "", batch: int = 256) -> DataFrame:
    """The rows of texts (key columns and text) with an embedding; the model is made once for each Python worker by its closure."""
    keys = [c for c in texts.columns if c != "text"]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.concat([part[keys].reset_index(drop=True), pd.Series(encoder([prefix + (t or "") for t in part.text]), name="embedding", dtype=object)], axis=1)

    schema = ", ".join(f"{n} {t}" for n, t in texts.dtypes if n != "text") + ", embedding array<double>"
    return texts.select(*keys, "text").mapInPandas(run, schema)


def hash_embedding(text: Column, dim: int = 16) -> Column:
    """A stub encoder as a column: counts of the tokens by a bucket of their md5."""
    bucket = F.transform(split_tokens(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dim)
    return let(bucket, lambda all_: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(all_, lambda b: b == i)).cast("double")))


def scored(pairs: DataFrame, scorer: Scorer, batch: int = 64) -> DataFrame:
    """query_id, doc_id, score of pairs (query_id, doc_id, question, text)."""

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield part[["query_id", "doc_id"]].assign(score=scorer(list(zip(part.question, part.text))))

    kinds = dict(pairs.dtypes)
    return pairs.select("query_id", "doc_id", "question", "text").mapInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")


def judged(pairs: DataFrame, judge: Judge, done: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """query_id, doc_id, raw of the pairs (query_id, doc_id, question, text) that `done` doesn't have yet."""
    if done is not None:
        pairs = pairs.join(done.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield part[["query_id", "doc_id"]].assign(raw=judge(list(zip(part.question, part.text))))

    kinds = dict(pairs.dtypes)
    return pairs.select("query_id", "doc_id", "question", "text").mapInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, raw string")


def overlap_judge(question: Column, text: Column) -> Column:
    """A stub judge as a column: the whole answer from half of the question's tokens on, part of it from a quarter on."""
    q = F.array_distinct(split_tokens(question))
    share = F.size(F.array_intersect(q, split_tokens(text))) / F.greatest(F.size(q), F.lit(1))
    return F.when(share >= 0.5, "1: да\n2: -").when(share >= 0.25, "1: нет\n2: да\nтип: часть").otherwise("1: нет\n2: нет")


def pdf_pages(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page, text from a `binaryFile` table and a function that gives the pages of a file."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                pages = extract(content)
                yield pd.DataFrame({"path": [path] * len(pages), "page": range(1, len(pages) + 1), "text": pages})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")
