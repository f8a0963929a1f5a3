"""Toxicity: a linear-chain conditional random field over the tokens of a text.

Two tags, toxic and other. A token's emission sums the weights of its word and of its beginnings; transitions
link neighbours. Token labels come from the document labels: a token of a toxic document whose word or
beginning is found almost only in toxic documents. Scoring runs forward-backward over every token of every
text; a text's marginals give its score (a logistic function of the strongest marginal's log-odds and of the
expected number of toxic tokens) and the offsets of the tokens whose marginal reaches one half.

A chain is a whole text, which ends in `other`, in learning and in scoring alike. So that many texts step together, a
text is worked on in blocks of BLOCK tokens: the product of a block's transfer matrices carries the forward and the backward
message across it, and every block then starts with exactly the messages that its neighbours hand it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, learned, learns

BLOCK, SLOTS, BEGINNINGS, CLIP = 64, 1 << 18, (4, 5, 6, 7, 8), 12.0
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_TOKEN = re.compile(rb"[^ ]+")


def tokens(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def features(word: bytes) -> list[int]:
    """Slots of the word and, for longer words, of its beginnings."""
    names = [b"=" + word] + [b"%d^" % n + word[:n] for n in BEGINNINGS if len(word) >= n]
    return [zlib.crc32(x) % SLOTS for x in names]


class Emissions(dict):
    """Emission of a word under given weights; a full cache starts afresh."""

    LIMIT = 400_000

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = float(np.clip(self.bias + self.weights[features(word)].sum(), -CLIP, CLIP))
        return value


def blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grid, first block of each text, number of its blocks); grid: BLOCK x blocks, time first, the token's number in the texts put one after the other, -1 beyond a text's end."""
    count = -(-lengths // BLOCK)
    first, begin = np.cumsum(count) - count, np.cumsum(lengths) - lengths
    own = np.arange(count.sum()) - np.repeat(first, count)
    at = np.arange(BLOCK)[:, None] + own * BLOCK
    return np.where(at < np.repeat(lengths, count), at + np.repeat(begin, count), -1), first, count


def chain_marginals(emission: np.ndarray, lengths: np.ndarray, step: np.ndarray, want_pairs: bool = False):
    """P(toxic) of every token by forward-backward over whole texts.

    emission: log-odds of the tokens of all texts, one text after the other; lengths: tokens of each; step: 2 x 2 log weights
    from, to (0 other, 1 toxic). With want_pairs also the expected number of each transition between two tokens.
    """
    grid, first, count = blocks(lengths)
    n, inside = grid.shape[1], grid >= 0
    t = np.where(inside, np.exp(emission)[grid], 0.0)  # beyond its end a text goes on in `other`, which is how it ends anyway
    (a00, a01), (a10, a11) = np.exp(step - step.max())
    begins = np.zeros(n, bool)
    begins[first[count > 0]] = True
    # the block's transfer matrix: products of transition and emission; a text's first token has no transition
    p = np.zeros((2, 2, n))
    p[0, 0] = p[1, 1] = 1
    for i in range(BLOCK):
        q0, q1 = p[:, 0] * a00 + p[:, 1] * a10, p[:, 0] * a01 + p[:, 1] * a11
        if i == 0:
            q0, q1 = np.where(begins, p[:, 0], q0), np.where(begins, p[:, 1], q1)
        q1 *= t[i]
        z = 1 / (q0 + q1).sum(0)
        p[:, 0], p[:, 1] = q0 * z, q1 * z
    into, back = np.ones((2, n)), np.ones((2, n))
    back[0], back[1] = a00, a10
    order = np.argsort(-count, kind="stable")
    alive = np.searchsorted(-count[order], -np.arange(count.max(initial=0) + 1), side="left")  # texts with more than k blocks
    for k in range(1, count.max(initial=0)):
        b = first[order[: alive[k]]] + k
        v = (into[:, None, b - 1] * p[:, :, b - 1]).sum(0)
        into[:, b] = v / v.sum(0)
    for k in range(count.max(initial=0) - 2, -1, -1):
        b = first[order[: alive[k + 1]]] + k
        v = (p[:, :, b + 1] * back[None, :, b + 1]).sum(1)
        back[:, b] = v / v.sum(0)
    forward = np.empty((BLOCK, 2, n))
    q0, q1 = into
    for i in range(BLOCK):
        r0, r1 = q0 * a00 + q1 * a10, q0 * a01 + q1 * a11
        if i == 0:
            r0, r1 = np.where(begins, q0, r0), np.where(begins, q1, r1)
        r1 = r1 * t[i]
        z = 1 / (r0 + r1)
        q0, q1 = forward[i]
        np.multiply(r0, z, out=q0), np.multiply(r1, z, out=q1)
    m, pairs = np.empty((BLOCK, n)), np.zeros((2, 2))
    b0, b1 = back
    for i in range(BLOCK - 1, -1, -1):
        f0, f1 = forward[i]
        m[i] = f1 * b1 / (f0 * b0 + f1 * b1)
        r1 = b1 * t[i]
        if want_pairs:
            g0, g1 = forward[i - 1] if i else into
            w = np.array([[g0 * a00 * b0, g0 * a01 * r1], [g1 * a10 * b0, g1 * a11 * r1]])
            pairs += ((w / w.sum((0, 1))) * (inside[i] & ~(begins & (i == 0)))).sum(2)
        c0, c1 = a00 * b0 + a01 * r1, a10 * b0 + a11 * r1
        z = 1 / (c0 + c1)
        b0, b1 = c0 * z, c1 * z
    out = np.empty(len(emission))
    out[grid[inside]] = m[inside]
    return (out, pairs) if want_pairs else out


def marginals(emission: np.ndarray, step: np.ndarray, want_pairs: bool = False):
    """chain_marginals of texts of equal length; emission and P(toxic): tokens x texts."""
    n, texts = emission.shape
    found = chain_marginals(emission.T.ravel(), np.full(texts, n), step, want_pairs)
    m = (found[0] if want_pairs else found).reshape(texts, n).T
    return (m, found[1]) if want_pairs else m


def parts_of(texts: list, most: int = 2_000_000) -> list[slice]:
    """Slices of the texts of about as many bytes each, 512 texts at most; a longer text is alone in its slice."""
    out, begin, total = [], 0, 0
    for k, text in enumerate(texts):
        n = len(text or b"")
        if k > begin and (total + n > most or k - begin >= 512):
            out.append(slice(begin, k))
            begin, total = k, 0
        total += n
    return [*out, slice(begin, len(texts))] if texts else []


@dataclass
class Model:
    weights: np.ndarray = field(repr=False)
    bias: float
    step: np.ndarray
    head: tuple[float, float, float]  # constant, log-odds of the strongest token, log of the expected number

    def summaries(self, texts: list[bytes | None], cache: Emissions) -> tuple[np.ndarray, list[list[int]]]:
        """(highest marginal, expected number of toxic tokens) of each text, and its toxic tokens' numbers."""
        split = [tokens(t) for t in texts]
        lengths = [len(s) for s in split]
        out, hot = np.zeros((len(texts), 2)), [[] for _ in texts]
        if not sum(lengths):
            return out, hot
        e = np.fromiter((cache[w] for s in split for w in s), float, sum(lengths))
        owner, ends = np.repeat(np.arange(len(texts)), lengths), np.cumsum([0] + lengths)
        m = chain_marginals(e, np.array(lengths), self.step)
        np.maximum.at(out[:, 0], owner, m)
        out[:, 1] = np.bincount(owner, m, len(texts))
        for k in np.flatnonzero(m >= 0.5):
            hot[owner[k]].append(int(k - ends[owner[k]]))
        return out, hot

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(summary) @ np.array(self.head), -30, 30)))


def _inputs(summary: np.ndarray) -> np.ndarray:
    top = np.clip(summary[:, 0], 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(top)), np.log(top / (1 - top)), np.log(summary[:, 1] + 1e-4)], 1)


def strong_features(texts: list[np.ndarray], table: np.ndarray, toxic: np.ndarray, evidence: float = 7.5, share: float = 0.9) -> np.ndarray:
    """For each feature slot whether toxic texts almost only hold it. texts: word numbers of each; table: features of each word.

    A feature that many toxic texts hold by chance alone is unlikely; one of them is strong if the logarithm of that chance,
    were its holders drawn at random, lies below -evidence.
    """
    held = np.zeros((2, SLOTS + 1))
    for words, x in zip(texts, toxic):
        held[x, np.unique(table[np.unique(words)])] += 1
    n0, n1 = max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))
    other, c = held
    usual, rate = n1 / (n0 + n1), c / np.maximum(c + other, 1)
    chance = c * np.log(np.maximum(rate, 1e-12) / usual) + np.where(other > 0, other * np.log(np.maximum(1 - rate, 1e-12) / max(1 - usual, 1e-12)), 0)
    strong = (c > 1) & (rate > usual) & (chance >= evidence) & ((c / n1) / np.maximum(c / n1 + (other + 0.5) / n0, 1e-12) >= share)
    strong[SLOTS] = False
    return strong


def gradient(e: np.ndarray, y: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the negative log-likelihood of the tags y with respect to each token's emission and to step."""
    m, pairs = chain_marginals(e, lengths, step, True)
    ends = np.cumsum(lengths)
    inner = np.ones(len(y), bool)
    inner[ends[lengths > 0] - 1] = False
    at = np.flatnonzero(inner)
    seen = np.bincount((2 * y[at] + y[at + 1]).astype(int), minlength=4).reshape(2, 2)
    g = pairs - seen
    last = ends[lengths > 0] - 1  # the step into the `other` that ends every text
    g[1, 0] += (m[last] - y[last]).sum()
    g[0, 0] -= (m[last] - y[last]).sum()
    return m - y, g


def fit(texts: list[bytes], toxic: list[int], epochs: int = 5, rate: float = 0.3, decay: float = 1e-4, batch: int = 50_000, seed: int = 5) -> Model | None:
    """Maximum likelihood of the token labels by AdaGrad, then a logistic head on the document labels; None without both labels.

    Every epoch visits every whole text once, in random order, in batches of about `batch` tokens (a longer text is one).
    """
    toxic = np.array(toxic, int)
    if len(set(toxic.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    words = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in tokens(t)), np.int32) for t in texts]
    table = np.full((len(vocabulary), 1 + len(BEGINNINGS)), SLOTS)
    for w, i in vocabulary.items():
        f = features(w)
        table[i, : len(f)] = f
    marked_ = strong_features(words, table, toxic)[table].any(1)
    weights, bias, step = np.zeros(SLOTS + 1), -2.0, np.zeros((2, 2))
    seen, seen_bias, seen_step = np.full(SLOTS + 1, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    lengths = np.array([len(w) for w in words])
    for _ in range(epochs):
        order = rng.permutation(len(words))
        for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(lengths[order]) // batch)) + 1):
            token = np.concatenate([words[k] for k in part])
            if not len(token):
                continue
            y = (marked_[token] & np.repeat(toxic[part] == 1, lengths[part])).astype(float)
            used, inverse = np.unique(token, return_inverse=True)
            f = table[used]
            f[:, 0] = np.where(rng.random(len(used)) < 0.5, f[:, 0], SLOTS)  # half the time only beginnings, so that new words are known by them
            raw = bias + weights[f].sum(1)
            gap, gs = gradient(np.clip(raw, -CLIP, CLIP)[inverse], y, lengths[part], step)
            units = len(token) / BLOCK
            own = np.bincount(inverse, gap, len(used)) / units
            grad = np.bincount(f.ravel(), np.repeat(own, f.shape[1]), SLOTS + 1) + decay * weights
            gs = gs / units + decay * step
            seen += grad**2
            weights -= rate * grad / np.sqrt(seen)
            weights[SLOTS] = 0
            seen_bias += own.sum() ** 2
            bias -= rate * own.sum() / np.sqrt(seen_bias)
            seen_step += gs**2
            step -= rate * gs / np.sqrt(seen_step)
    model = Model(weights[:SLOTS].astype(np.float32), float(bias), step, (0.0, 1.0, 0.0))
    cache = Emissions(model.weights, model.bias)
    x = _inputs(np.concatenate([model.summaries(texts[part], cache)[0] for part in parts_of(texts)]))
    d, head = toxic.astype(float), np.zeros(3)
    for _ in range(50):  # Newton steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        head -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (p - d) + 0.05 * head)
    model.head = tuple(head)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, usual: int = 20_000) -> Model | None:
    """The model from at most `sample` learning rows of either label; None unless both are there.

    The rows are the first by hash of id. Their texts are read whole, those of up to `usual` characters before longer ones,
    of which as many are left out as would make all texts more than 48 MB together.
    """
    named = labels.where(learns(0, 5, False)).where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(9)))
    chosen = [named.where(f"toxic = {k}").orderBy("h", "doc_id").limit(sample) for k in (0, 1)]
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    got = texts.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    return learned(got.select("text", "toxic", (F.char_length("text") > usual).alias("long"), "h", "doc_id"), sample, fit)


def _offsets(text: bytes, marks: list[int]) -> list[dict]:
    """Code point offsets of the tokens with these numbers."""
    found, out, at, seen = [x.span() for x in _TOKEN.finditer(text.translate(_TABLE))], [], 0, 0
    for k in marks:
        s, e = found[k]
        seen += len(text[at:s].decode())
        n = len(text[s:e].decode())
        out.append({"s": seen, "e": seen + n})
        at, seen = e, seen + n
    return out


def _scored(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        cache = Emissions(model.weights, model.bias) if model else None
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for at in parts_of(texts):
                part, i = texts[at], at.start
                summary, hot = model.summaries(part, cache) if model else (np.zeros((len(part), 2)), [[] for _ in part])
                spans = []
                for text, marks in zip(part, hot):
                    spans.append(_offsets(text, sorted(marks)) if marks else [])
                score = np.round(model.score(summary), 6) if model else np.zeros(len(part))
                kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return run


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans array<struct<s, e>>; a single pass without a shuffle.

    A null or empty text has no toxic token and scores what the head says to none; without a model all scores
    are 0. spans: code point offsets, end exclusive, of the tokens whose marginal reaches one half.
    The model goes out once as a broadcast; its size (a table of SLOTS weights) doesn't depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    out = d.mapInArrow(_scored(shared), "doc_id long, score double, spans array<struct<s: int, e: int>>")
    return out.select("doc_id", F.coalesce(learns(0, 5, True), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "spans")
