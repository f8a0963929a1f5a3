"""Language identification with string kernels.

The kernel of two texts is the blended spectrum of presence: for each length n, the number of n-grams of bytes
that both have, over the root of the product of how many each has; summed over the lengths. Nystroem landmarks
span the feature space, kernel ridge regression (one target of +1/-1 for each language) fits their weights, and as
the kernel is a scalar product of presence vectors, landmarks and weights fold into one matrix for each length. A
batch of texts is scored by multiplying its presence matrix with that one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.common import as_bytes, learned, learns

LENGTHS, SLOTS = (1, 2, 3), (256, 8192, 16384)
WIDTH = sum(SLOTS)
UNKNOWN = "und"


def presence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(0/1 matrix of the hashed n-grams that each text has, the matrix of 1 / root of their numbers by length)."""
    x = np.zeros((len(texts), WIDTH), np.float32)
    norm = np.zeros((len(texts), len(LENGTHS)), np.float32)
    for row, text in enumerate(texts):
        b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
        code, at = np.zeros(len(b), np.uint32), 0
        for k, (n, slots) in enumerate(zip(LENGTHS, SLOTS)):
            if len(b) < n:
                break
            code = code[: len(b) - n + 1] * np.uint32(256) + b[n - 1 :]
            slot = code if n == 1 else (code * np.uint32(2654435761)) >> np.uint32(32 - slots.bit_length() + 1)
            x[row, at + slot] = 1
            norm[row, k] = 1 / np.sqrt(max(x[row, at : at + slots].sum(), 1))
            at += slots
    return x, norm


def scaled(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return x * np.repeat(norm, SLOTS, axis=1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # WIDTH x languages
    sharpness: float = 6.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities: a softmax of the ridge outputs."""
        x, norm = presence(texts)
        out, at = np.zeros((len(texts), len(self.languages))), 0
        for k, slots in enumerate(SLOTS):
            out += (x[:, at : at + slots] @ self.weights[at : at + slots]) * norm[:, k : k + 1]
            at += slots
        e = np.exp(self.sharpness * (out - out.max(1, keepdims=True)))
        return e / e.sum(1, keepdims=True)


def fit(texts: list[bytes], languages: list[str], landmarks: int = 256, ridge: float = 1e-3, seed: int = 11) -> Model:
    """Nystroem approximation: z = k(x, landmarks) K^-1/2, ridge regression on z, weights folded back onto n-grams."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    by = {n: [i for i, l in enumerate(languages) if l == n] for n in names}
    chosen = sorted({int(i) for n in names for i in rng.permutation(by[n])[: max(1, landmarks // len(names))]})
    marks = scaled(*presence([texts[i] for i in chosen]))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate([scaled(*presence(texts[i : i + 64])) @ marks.T for i in range(0, len(texts), 64)]) @ root
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    w = np.array([len(texts) / (len(names) * len(by[l])) for l in languages])  # every language weighs the same
    beta = np.linalg.solve((z * w[:, None]).T @ z + ridge * len(texts) * np.eye(z.shape[1]), (z * w[:, None]).T @ y)
    return Model(names, (marks.T @ (root @ beta)).astype(np.float32))


def _rated(model: Model | None):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                known = [k for k, t in enumerate(part) if t and any(map(str.isalpha, t.decode("utf-8", "replace")))] if model else []
                said, score = [UNKNOWN] * len(part), [0.0] * len(part)
                for j in range(0, len(known), 64):
                    p = model.scores([part[k] for k in known[j : j + 64]])
                    for k, row in zip(known[j : j + 64], p):
                        said[k], score[k] = model.languages[int(row.argmax())], round(float(row.max()), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array(said), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def train(docs: DataFrame, sample: int = 3000, usual: tuple[int, int] = (20, 20_000), most_languages: int = 1000) -> Model | None:
    """The model from a bounded sample of the learning rows, balanced by language; None if there is no learning row.

    sample: learning rows of all languages together, but 8 a language at least; they are the first by hash of id and text,
    those with a usual number of characters before others, and every one is read whole. Where they would be more than 48 MB
    together, longer ones give way to later ones. Rows that repeat id, language and text count once.
    most_languages: bound of what a model holds; more learning languages raise an error, as none may be left out.
    Candidates for the sample are the rows whose hash lies under their language's threshold, which holds about twice as many
    as are wanted, so no task gets all rows of a language.
    """
    rows = docs.where(learns(2, 4, False)).where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.select("*", F.expr("cast(char_length(text) not between {} and {} as int)".format(*usual)).alias("odd"), F.xxhash64("doc_id", "text", F.lit(3)).alias("h"))
    found = rows.groupBy("lang", "odd").agg(F.count("*").alias("n"), F.min("h").alias("low")).limit(2 * most_languages + 2).collect()
    names = sorted({r.lang for r in found})
    if len(names) > most_languages:
        raise ValueError(f"more than {most_languages} languages to learn")
    if not names:
        return None
    want, under, have = max(8, sample // len(names)), [], {r.lang: r.n for r in found if not r.odd}
    for r in found:
        need = want - (have.get(r.lang, 0) if r.odd else 0)
        if need > 0:
            share = min(1.0, (2 * need + 50) / r.n)
            under.append((r.lang, r.odd, max(r.low, min(int(share * 2**64) - 2**63, 2**63 - 1))))
    limits = docs.sparkSession.createDataFrame(under, "lang string, odd int, most long")
    some = rows.join(F.broadcast(limits), ["lang", "odd"]).where("h <= most").groupBy("lang", "doc_id", "h", "odd").agg(F.min("text").alias("text"))
    return learned(some.select("text", "lang", "odd", "h", "doc_id"), want, fit)


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs with lang_pred and score (columns of these names are replaced), in the same pass as the scoring."""
    docs = docs.drop("lang_pred", "score")
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            inner = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], ["doc_id", "text"])
            out = pa.Table.from_batches(list(_rated(model)([inner])), pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])).combine_chunks()
            said = [out.column(c).combine_chunks() if out.num_rows else pa.array([], t) for c, t in (("lang_pred", pa.string()), ("score", pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), batch.column("text"), *said], [*rest, "text", "lang_pred", "score"])

    rows = docs.select(*rest, "text")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; a single pass without a shuffle.

    `und` with a score of 0 for a text that is null or has no letter, and for every text without a model.
    Texts count as a whole, whatever their length; repeated rows are rated each by itself.
    """
    d = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    out = d.mapInArrow(_rated(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(learns(2, 4, True), F.lit(False)).alias("held_out"), "lang_pred", "score")
