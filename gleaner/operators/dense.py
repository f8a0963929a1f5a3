"""Exact inner-product search, and vector utilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import let


def unit(vector: Column, dim: int = 0) -> Column:
    """The first dim components (all for 0) at unit length; a zero vector stays zero."""
    v = F.transform(F.slice(vector, 1, dim) if dim else vector, lambda x: x.cast("double"))

    def scaled(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return let(F.when(norm > 0, norm).otherwise(1.0), lambda n: F.transform(v, lambda x: x / n))

    return let(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _blocks(vectors: DataFrame, rows: int, name: str) -> DataFrame:
    """Blocks of vectors as bytes: at most about `rows` rows each, dealt by hash."""
    count = max(1, -(-vectors.count() // rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))

    def pack(pdf):
        import pandas as pd

        pdf = pdf.sort_values("vec_id")
        ids, v = pdf.vec_id.to_numpy(np.int64), np.stack(pdf.embedding.to_numpy()).astype(np.float64)
        return pd.DataFrame({f"{name}_block": [int(pdf.block.iloc[0])], f"{name}_ids": [ids.tobytes()], f"{name}_rows": [v.tobytes()], "dim": [v.shape[1]]})

    return dealt.groupBy("block").applyInPandas(pack, f"{name}_block int, {name}_ids binary, {name}_rows binary, dim int")


#: Bytes of a query matrix (doubles) up to which it goes to every task; larger ones are cut into blocks that meet by shuffle.
MOST_QUERY_BYTES = 32_000_000


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, dim: int = 0, block_rows: int = 4096, most_bytes: int = MOST_QUERY_BYTES, half: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: the k largest inner products of unit vectors for each query (six decimals); ties by vec_id.

    queries, corpus: vec_id, embedding. The queries are counted; where their matrix has at most most_bytes it goes to every
    task, and the corpus is read where it lies (`_scan`). More queries meet the corpus in pairs of blocks. Either way a
    task keeps k rows a query, and a window over those partial lists finishes.
    half: the first pass holds the corpus in half precision, its error bounded, as a device of little memory would.
    """
    q, c = (t.where("embedding is not null and size(embedding) > 0").select("vec_id", "embedding") for t in (queries, corpus))
    told = q.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    if 8 * told.n * (told.dim or 0) <= most_bytes:
        found = _scan(q, c, k, dim, half)
    else:
        found = _pairs(q, c, k, dim, block_rows)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def scaled(x: np.ndarray, dim: int) -> np.ndarray:
    """The first dim components (all for 0) of each row in double precision at unit length; zero rows stay zero."""
    x = np.asarray(x, np.float64)[:, : dim or None]
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1.0)


class Heaps:
    """The k best (score, id) of each query so far: rows in order of score, ties in order of id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    @property
    def worst(self) -> np.ndarray:
        return self.scores[:, -1]

    def push(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of several queries, any number for each."""
        if not len(rows):
            return
        k = self.scores.shape[1]
        touched = np.unique(rows)
        all_rows = np.concatenate([np.repeat(touched, k), rows])
        all_scores, all_ids = np.concatenate([self.scores[touched].ravel(), scores]), np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((all_ids, -all_scores, all_rows))
        all_rows, all_scores, all_ids = all_rows[order], all_scores[order], all_ids[order]
        starts = np.flatnonzero(np.append(True, all_rows[1:] != all_rows[:-1]))
        take = (starts[:, None] + np.arange(k)).ravel()
        self.scores[touched], self.ids[touched] = all_scores[take].reshape(-1, k), all_ids[take].reshape(-1, k)


def _matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def _scan(queries: DataFrame, corpus: DataFrame, k: int, dim: int, half: bool, rows: int = 2048) -> DataFrame:
    """Partial lists of each partition of the corpus: a first pass in low precision leaves out what its error bound rules out, the rest is scored in double precision."""
    told = queries.collect()  # of bounded size, counted by the caller
    ids, by_dim = np.array([r.vec_id for r in told], np.int64), {}
    for i, r in enumerate(told):
        by_dim.setdefault(len(r.embedding), []).append(i)
    groups = {d: (np.array(at), scaled(np.array([told[i].embedding for i in at]), dim)) for d, at in by_dim.items()}
    held = queries.sparkSession.sparkContext.broadcast((ids, groups))
    # unit vectors: rounding to half precision moves a product by 2^-11 at most, single precision sums of some thousand terms by far less than 1e-4
    slack = (2.0**-11 if half else 0.0) + 1e-4 + 1e-6

    def run(batches):
        import pyarrow as pa

        ids, groups = held.value
        heaps = {d: Heaps(len(at), k) for d, (at, _) in groups.items()}
        low = {d: q.astype(np.float32) for d, (_, q) in groups.items()}
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for d in set(sizes.tolist()) & set(groups):
                part = batch if (sizes == d).all() else batch.filter(pa.array(sizes == d))
                for i in range(0, part.num_rows, rows):
                    some = part.slice(i, rows)
                    x, names = scaled(_matrix(some.column(1), d), dim), some.column(0).to_numpy()
                    rough = low[d] @ (x.astype(np.float16).astype(np.float32) if half else x.astype(np.float32)).T
                    floor = heaps[d].worst
                    if not np.isfinite(floor).all() and len(x) > k:  # no list yet: the k-th best of these rows is a floor
                        floor = np.maximum(floor, -np.partition(-rough, k - 1, axis=1)[:, k - 1] - slack)
                    row, col = np.nonzero(rough >= (floor - slack)[:, None])
                    q = groups[d][1]
                    for j in range(0, len(row), 65_536):
                        r, c = row[j : j + 65_536], col[j : j + 65_536]
                        heaps[d].push(r, np.round(np.einsum("nd,nd->n", q[r], x[c]), 6), names[c])
        for d, (at, _) in groups.items():
            h = heaps[d]
            row, col = np.nonzero(np.isfinite(h.scores))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at][row]), pa.array(h.ids[row, col]), pa.array(h.scores[row, col])], ["query_id", "vec_id", "score"])

    typed = corpus.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.forall("embedding", lambda x: x.isNotNull()), F.col("embedding")).alias("embedding")).where("embedding is not null")
    return typed.mapInArrow(run, "query_id long, vec_id long, score double")


def _pairs(queries: DataFrame, corpus: DataFrame, k: int, dim: int, block_rows: int) -> DataFrame:
    """Queries and corpus are cut into blocks; each pair of blocks is one matrix product that keeps k rows a query, so neither side is broadcast whole."""
    q, c = (_blocks(t.select("vec_id", unit(F.col("embedding"), dim).alias("embedding")), block_rows, n) for t, n in ((queries, "q"), (corpus, "c")))
    n_q = q.count()
    pairs = c.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(max(n_q - 1, 0))))).join(q.drop("dim"), "q_block")

    def best(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples():
                a, b = (np.frombuffer(x).reshape(-1, r.dim) for x in (r.q_rows, r.c_rows))
                qi, ci = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.c_ids, np.int64)
                s = np.round(a @ b.T, 6)
                m = min(k, len(ci))
                cut = -np.sort(-s, axis=1)[:, m - 1 : m]
                row, col = np.nonzero(s >= cut)  # ties at the cut stay in, the window decides
                yield pd.DataFrame({"query_id": qi[row], "vec_id": ci[col], "score": s[row, col]})

    return pairs.mapInPandas(best, "query_id long, vec_id long, score double")


def compare_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many vectors both hold, median and least cosine, how many lie below 0.999 and 0.99."""
    both = a.select("vec_id", F.col("embedding").alias("x")).join(b.select("vec_id", F.col("embedding").alias("y")), "vec_id").select(F.round(cosine(F.col("x"), F.col("y")), 6).alias("c"))
    return both.agg(
        F.count("*").alias("n"),
        F.round(F.percentile("c", 0.5), 6).alias("median_cos"),
        F.round(F.min("c"), 6).alias("min_cos"),
        F.count_if(F.col("c") < 0.999).alias("below_0999"),
        F.count_if(F.col("c") < 0.99).alias("below_099"),
    )
