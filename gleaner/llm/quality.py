"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio, in DataFrame functions alone.

Words and word pairs are hashed into buckets. Two multinomials over the buckets, one from trusted documents and
one from the whole corpus, give every bucket a log ratio; a document's mean over its n-grams is its length-
normalised log-likelihood ratio. A threshold, the same for every document and learned from held-out labels, decides.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACE, WORD, checkpoint, let, marked

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
BUCKETS = 1 << 14
#: The half of the documents that a document is in.
FOLD = "cast(pmod(xxhash64(cast(doc_id as long), 17), 2) as int)"


def _words(text: str = "text") -> str:
    return rf"array_remove(split(coalesce({text}, ''), r'{SPACE}', -1), '')"


def _grams(words: str, buckets: int) -> str:
    """Bucket numbers of the words and the pairs of neighbours."""
    one = f"transform({words}, v -> cast(pmod(xxhash64(v), {buckets}) as int))"
    two = f"transform({words}, (v, i) -> cast(pmod(xxhash64(v, get({words}, i + 1)), {buckets}) as int))"
    return f"concat({one}, slice({two}, 1, greatest(size({words}) - 1, 0)))"


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, folds: bool = False) -> DataFrame:
    """bucket, n: n-grams of all texts by bucket, with folds also f0, f1: those of either half of the documents; partial sums leave at most `buckets` rows of a task to shuffle."""
    grams = docs.select(F.expr(FOLD).alias("fold"), F.explode(F.expr(let(_words(), "w", _grams("w", buckets)))).alias("bucket"))
    halves = [F.count_if(F.col("fold") == k).alias(f"f{k}") for k in (0, 1)] if folds else []
    return grams.groupBy("bucket").agg(F.count("*").alias("n"), *halves)


def log_ratios(t: list[int], r: list[int]) -> list[float]:
    """Smoothed log(p_target / p_raw) of every bucket."""
    buckets, all_t, all_r = len(t), sum(t), sum(r)
    if not all_t:
        return [0.0] * buckets
    # a target bucket is smoothed towards the corpus, with the weight of one n-gram a bucket
    prior = [(b + 1) / (all_r + buckets) for b in r]
    return [round(math.log((a + buckets * p) / (all_t + buckets) / p), 6) for a, p in zip(t, prior)]


def models(target: DataFrame, raw: DataFrame, buckets: int = BUCKETS) -> tuple[list[float], list[float]]:
    """Log ratios of the whole target, and, one after the other, those for the documents of either fold, whose target is the other fold."""
    t = target.withColumnRenamed("n", "t")
    rows = raw.join(t, "bucket", "full_outer").select("bucket", *(F.coalesce(c, F.lit(0)) for c in ("n", "t", "f0", "f1"))).collect()
    n, all_, f0, f1 = ([0] * buckets for _ in range(4))
    for k, *counts in rows:
        n[k], all_[k], f0[k], f1[k] = counts
    return log_ratios(all_, n), log_ratios(f1, n) + log_ratios(f0, n)


def best_cut(tally: list[tuple[float, int, int]]) -> float:
    """The threshold for (llr, good, bad) counts of labelled documents with the least sum of the shares of good ones dropped and bad ones kept.

    It lies halfway between two values, the higher pair where several are equal; below all of them where nothing bad
    is labelled, and at minus infinity, so that the base rule alone decides, where nothing good is.
    """
    tally = sorted(tally)
    good, bad = (sum(x[k] for x in tally) for k in (1, 2))
    if not good:
        return -math.inf
    lost, left = 0, bad
    best, cut = left / max(bad, 1), tally[0][0] - 0.001
    for (at, g, b), (after, *_) in zip(tally, tally[1:]):
        lost, left = lost + g, left - b
        wrong = lost / good + left / max(bad, 1)
        if wrong <= best:
            best, cut = wrong, (at + after) / 2
    return round(cut, 4)


def rate(docs: DataFrame, ratios: list[float], by_fold: list[float]) -> DataFrame:
    """doc_id, the base counts, base_failed, llr and held (the llr by the ratios that the document's fold is held out of) of every row."""
    buckets = len(ratios)
    table, held = (f"from_json('{json.dumps(x)}', 'array<double>')" for x in (ratios, by_fold))
    sums = f"named_struct('all', aggregate(g, 0D, (a, k) -> a + get({table}, k)), 'held', aggregate(g, 0D, (a, k) -> a + get({held}, k + {buckets} * fold)))"
    sorted_ = "array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i)))"
    at = "array_sort(transform(filter(t, (x, k) -> x.h = get(t, k - 1).h or x.h = get(t, k + 1).h), x -> x.i))"
    covered = f"aggregate({at}, named_struct('n', 0, 'end', 0), (a, i) -> named_struct('n', a.n + i + 8 - greatest(a.end, i), 'end', i + 8), a -> a.n)"
    repeated = f"if(size(array_distinct(h)) < size(h), {let(sorted_, 't', covered)}, 0)"
    windows = "if(size(w) < 8, cast(array() as array<bigint>), transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8))))"
    counts = f"""named_struct('n', size(w), 'word_chars', char_length(array_join(w, '')), 'repeated', {let(windows, 'h', repeated)},
        'sum', {let(_grams('w', buckets), 'g', sums)})"""
    lines = rf"filter(split(text, '\n', -1), x -> x rlike r'{WORD}')"
    d = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text", f"{FOLD} fold")
    d = d.select("doc_id", F.expr(let(_words(), "w", counts)).alias("c"), F.expr("regexp_count(text, r'[#*$%&|<>]')").alias("n_symbols"), F.expr(let(lines, "l", "size(l) - size(array_distinct(l))")).alias("n_dup_lines"))
    d = d.select("doc_id", "c.n", "c.word_chars", "n_symbols", "n_dup_lines", F.expr("cast(c.repeated as long)").alias("n_repeat_words"), "c.sum")
    failed = F.expr("n < 20 or 100 * n_repeat_words > 30 * n")
    grams = F.expr("2 * n - 1")
    llr, held = (F.when(F.col("n") > 0, F.round(F.col(f"sum.{c}") / grams, 6)).otherwise(F.lit(0.0)).alias(a) for c, a in (("all", "llr"), ("held", "held")))
    return d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        llr,
        held,
    )


def width(n: int) -> int:
    """Buckets for n documents: the power of two that holds n, 2^14 at least and 2^16 at most."""
    return min(max(BUCKETS, 1 << max(n - 1, 1).bit_length()), 1 << 16)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    docs: doc_id, text; labels: doc_id, quality. The target multinomial counts the texts of every document of quality
    1, the raw multinomial every document. Both have as many buckets as `width` gives where `buckets` doesn't say, so
    the ratios are a literal of bounded size.
    threshold: where it isn't given, labelled documents that pass the base rule decide (`best_cut`), each rated by a
    target of the other half of the documents, which its own text is no part of.
    Null and empty texts have no words and fail the base rule; without any trusted document all ratios are 0 and
    only the base rule decides. Repeated rows are rated each by itself.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = buckets or width(docs.count())
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # the marks spare the shuffle most texts that aren't trusted; the join is what decides
    target = marked(docs, good, "maybe_good").where("maybe_good").select("doc_id", "text").join(good.hint("shuffle_hash"), "doc_id", "left_semi")
    rated = rate(docs, *models(bucket_counts(target, buckets, folds=True), bucket_counts(docs, buckets), buckets))
    if threshold is None:
        rated = checkpoint(rated)
        known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
        judged = rated.where("not base_failed").join(known, "doc_id").groupBy(F.round("held", 3).alias("held"))
        threshold = best_cut([tuple(r) for r in judged.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).collect()])
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold)).select(*COLUMNS)
