"""Losses of retrieval training as evaluations over stored vectors: contrastive within batches, and listwise distillation.

Both can be summed over truncated dimensions, each cut and scaled to unit length anew. A batch is a matrix product in
blocks with running sums of exponentials; no table of pairs is made.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.operators.dense import unit
from gleaner.operators.ids import numbered


def cut_to(x: np.ndarray, dim: int) -> np.ndarray:
    """The first dim components (all for 0) of each row at unit length; zero rows stay zero."""
    x = x[:, :dim] if dim else x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def in_batch(anchor: np.ndarray, others: np.ndarray, scale: float, block: int = 256) -> np.ndarray:
    """For each anchor i, minus the log of the share that others[i] has in the sum of exp(scale * cosine) over all others."""
    most, total = np.full(len(anchor), -np.inf), np.zeros(len(anchor))
    for lo in range(0, len(others), block):
        s = scale * (anchor @ others[lo : lo + block].T)
        top = np.maximum(most, s.max(1))
        total = total * np.exp(most - top) + np.exp(s - top[:, None]).sum(1)
        most = top
    return most + np.log(total) - scale * np.einsum("nd,nd->n", anchor, others[: len(anchor)])


def contrastive(pairs: DataFrame, key: str, size: int = 64, dims: tuple[int, ...] = (0,), scale: float = 20.0, seed: int = 13) -> DataFrame:
    """batch, n, loss: mean loss of each batch, summed over the dims.

    pairs: key, anchor, positive (arrays of one length) and, where there is one, negative: within a batch each anchor competes
    for its positive with all others' positives and all negatives. Batches of `size` rows follow the md5 order of the
    key. Pairs without a vector drop out beforehand.
    """
    rows = pairs.where("anchor is not null and positive is not null").withColumn("_order", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")))
    placed = numbered(rows, ["_order", key], "_place")
    hard = "negative" in pairs.columns
    dealt = placed.select(F.expr(f"cast((_place - 1) div {size} as long)").alias("batch"), "anchor", "positive", *(["negative"] if hard else []))

    def run(pdf):
        import pandas as pd

        a, p = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("anchor", "positive"))
        more = [np.stack(x.to_numpy()).astype(float) for x in ([pdf.negative.dropna()] if hard else []) if len(x)]
        loss = sum(in_batch(cut_to(a, d), np.concatenate([cut_to(x, d) for x in (p, *more)]), scale).mean() for d in dims)
        return pd.DataFrame({"batch": [pdf.batch.iloc[0]], "n": [len(pdf)], "loss": [loss]})

    return dealt.groupBy("batch").applyInPandas(run, "batch long, n long, loss double")


def listwise(lists: DataFrame, key: str, dims: tuple[int, ...] = (0,), scale: float = 20.0, temperature: float = 1.0, teacher_temperature: float = 1.0) -> DataFrame:
    """key, n, loss: divergence of the student's shares from the teacher's over each list, summed over the dims.

    lists: key, anchor, doc (vectors), label (the teacher's score), a row for each document of a list. The teacher's shares are
    the softmax of label / teacher_temperature, the student's that of scale * cosine / temperature. A list of one document
    has nothing to be learned from and is an error. Lists are short; each ends in one row.
    """

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)

    def cosine(d):
        return let(unit(F.col("anchor"), d), lambda x: dot(x, unit(F.col("doc"), d)))

    sims = [cosine(d).alias(f"s{k}") for k, d in enumerate(dims)]
    each = lists.select(key, (F.col("label").cast("double") / teacher_temperature).alias("t"), *sims)
    many = each.groupBy(key).agg(F.count("*").alias("n"), *(F.collect_list(F.struct("t", F.col(f"s{k}").alias("s"))).alias(f"x{k}") for k in range(len(dims))))

    def log_share(x, value):
        """Of each row of x: (t, log of its share) by value."""
        top = F.array_max(F.transform(x, value))
        return let(top, lambda m: let(m + F.ln(F.aggregate(x, F.lit(0.0), lambda a, r: a + F.exp(value(r) - m))), lambda z: F.transform(x, lambda r: value(r) - z)))

    def divergence(x):
        teacher, student = log_share(x, lambda r: r["t"]), log_share(x, lambda r: r["s"] * scale / temperature)
        return F.aggregate(F.zip_with(teacher, student, lambda t, s: F.exp(t) * (t - s)), F.lit(0.0), lambda a, v: a + v)

    loss = sum((divergence(F.col(f"x{k}")) for k in range(len(dims))), F.lit(0.0))
    checked = F.when(F.col("n") < 2, F.raise_error(F.lit("a list of one document has no gradient"))).otherwise(loss)
    return many.select(key, "n", checked.alias("loss"))
