"""Intervals and tests for paired metric values.

Two modes: relational, where a counter-based generator (md5 of seed, replicate and place) draws the resamples, so SQL
can repeat them; and numpy, where one group of bounded size (a value for each query) is resampled with PCG64.

Resampling needs all values of a group at hand. They are what people or models judged, a value for each query of a benchmark:
a group of more than MOST values is refused. Replicates are dealt out in chunks, and a chunk's task draws from the values in
place, so no draw is shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import let


def draw(n: Column, *parts: Column) -> Column:
    """A number in 0..n-1 from the md5 of the parts."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


MOST = 1_000_000


def _listed(values: DataFrame, by: str, key: str) -> DataFrame:
    """by, n, v array<double> without nulls, in the order of key."""
    kept = values.where("value is not null and not isnan(value)").select(by, F.struct(F.col(key).alias("k"), F.col("value").cast("double").alias("v")).alias("x"))
    few = kept.groupBy(by).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("x")).alias("x"))
    fits = F.when(F.col("n") > MOST, F.raise_error(F.lit(f"more than {MOST} values to resample"))).otherwise(F.col("n"))
    return few.select(by, fits.cast("long").alias("n"), F.col("x.v").alias("v"))


def _replicates(listed: DataFrame, by: str, reps: int, value, chunk: int = 250) -> DataFrame:
    """by, rep, m: value(v, n, rep) of each replicate."""
    chunks = -(-reps // chunk)
    dealt = listed.select(by, "n", "v", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).repartition(F.col(by), F.col("chunk"))
    first = F.col("chunk") * chunk
    numbers = F.sequence(first.cast("long"), F.least(first + chunk, F.lit(reps)).cast("long") - 1)
    made = F.transform(numbers, lambda rep: F.struct(rep.alias("rep"), value(F.col("v"), F.col("n"), rep).alias("m")))
    return dealt.select(by, F.inline(made))


def _mean(v: Column, n: Column, each) -> Column:
    """The mean of each(i) over the places."""
    return F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), F.lit(0.0), lambda a, i: a + each(i)) / n


def _resampled(seed: int):
    return lambda v, n, rep: _mean(v, n, lambda i: F.get(v, draw(n, F.lit(seed), rep, i).cast("int")))


def bootstrap(values: DataFrame, by: str, key: str, reps: int = 10_000, seed: int = 7) -> DataFrame:
    """by, n, mean, lo, hi: bootstrap interval of the mean (linear quantiles at 2.5 and 97.5 %)."""
    listed = _listed(values, by, key)
    means = _replicates(listed, by, reps, _resampled(seed))
    q = means.groupBy(by).agg(F.round(F.percentile("m", 0.025), 6).alias("lo"), F.round(F.percentile("m", 0.975), 6).alias("hi"))
    centre = listed.select(by, "n", F.round(_mean(F.col("v"), F.col("n"), lambda i: F.get("v", i.cast("int"))), 6).alias("mean"))
    return centre.join(q, by)


def paired(a: DataFrame, b: DataFrame, by: str, key: str) -> DataFrame:
    """by, key, value: differences a - b over the keys with both values."""
    x, y = a.select(by, key, F.col("value").alias("x")), b.select(by, key, F.col("value").alias("y"))
    return x.join(y, [by, key]).select(by, key, (F.col("x") - F.col("y")).alias("value"))


def sign_flip_p(differences: DataFrame, by: str, key: str, reps: int = 10_000, seed: int = 11) -> DataFrame:
    """by, p: the share of random sign flips whose mean is at least as far from 0 as the real one."""
    listed = _listed(differences, by, key)

    def flipped(v, n, rep):
        return F.abs(_mean(v, n, lambda i: F.get(v, i.cast("int")) * F.when(draw(F.lit(2), F.lit(seed), rep, i) == 0, 1).otherwise(-1)))

    real = listed.select(by, F.abs(_mean(F.col("v"), F.col("n"), lambda i: F.get("v", i.cast("int")))).alias("real"))
    means = _replicates(listed, by, reps, flipped)
    return means.join(real, by).groupBy(by).agg(F.round(F.avg((F.col("m") >= F.col("real") - 1e-12).cast("double")), 6).alias("p"))


def kappa_interval(votes: DataFrame, key: str, grades: int = 3, reps: int = 4000, seed: int = 7) -> DataFrame:
    """lo, hi: order statistics at 2.5 and 97.5 % of the resampled kappa of two judges (a, b: 0..grades-1; null votes drop out)."""
    cells = votes.where("a is not null and b is not null").select(F.lit("all").alias("by"), key, (F.col("a") * grades + F.col("b")).alias("value"))

    def kappa(v, n, rep):
        drawn = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(v, draw(n, F.lit(seed), rep, i).cast("int")))

        def of(votes_):
            def count(wanted):
                return F.size(F.filter(votes_, lambda x: wanted(x))).cast("double")

            def first(g):
                return count(lambda x: F.floor(x / grades) == g)

            def second(g):
                return count(lambda x: x % grades == g)

            off = count(lambda x: F.floor(x / grades) != x % grades)
            hit = sum((first(g) * second(g) for g in range(grades)), F.lit(0.0))
            return 1 - (off / n) / (1 - hit / (n * n))

        return let(drawn, of)

    every = _replicates(_listed(cells, "by", key), "by", reps, kappa).agg(F.sort_array(F.collect_list("m")).alias("k"))  # reps values
    return every.select(*(F.round(F.element_at("k", F.floor(q * F.size("k")).cast("int") + 1), 6).alias(c) for c, q in (("lo", 0.025), ("hi", 0.975))))


def gate(differences: DataFrame, by: str, key: str, tolerance: float = 0.02) -> DataFrame:
    """by, n, mean, lo, hi, accepted, established, detectable: rejected only if the mean falls below -tolerance."""
    ci = bootstrap(differences, by, key)
    return ci.select(
        "*",
        (F.col("mean") >= -tolerance).alias("accepted"),
        ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("established"),
        F.round((F.col("hi") - F.col("lo")) / 2, 6).alias("detectable"),
    )


def bootstrap_numpy(values: DataFrame, by: str, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """Like bootstrap, with numpy's generator in one group of values for each `by`."""

    def run(pdf):
        import pandas as pd

        v = pdf.value.dropna().to_numpy()
        if not len(v):
            return pd.DataFrame({by: pdf[by].iloc[:1], "n": [0], "mean": [None], "lo": [None], "hi": [None]})
        rng = np.random.default_rng(seed)
        means = np.concatenate([v[rng.integers(0, len(v), (min(500, reps - i), len(v)))].mean(1) for i in range(0, reps, 500)])
        return pd.DataFrame({by: pdf[by].iloc[:1], "n": [len(v)], "mean": [v.mean()], "lo": [np.quantile(means, 0.025)], "hi": [np.quantile(means, 0.975)]})

    return values.select(by, "value").groupBy(by).applyInPandas(run, f"{by} string, n long, mean double, lo double, hi double")


def unpaired_diff(a: DataFrame, b: DataFrame, by: str, key: str, reps: int = 10_000, seed: int = 7) -> DataFrame:
    """by, diff, lo, hi: interval of the difference of two means, either side resampled by itself."""

    def means(v, s, name):
        listed = _listed(v, by, key)
        real = listed.select(by, _mean(F.col("v"), F.col("n"), lambda i: F.get("v", i.cast("int"))).alias(f"{name}_real"))
        return _replicates(listed, by, reps, _resampled(s)).withColumnRenamed("m", name).join(real, by)

    both = means(a, seed, "x").join(means(b, seed + 1, "y"), [by, "rep"])
    d = both.groupBy(by).agg(
        F.round(F.max(F.col("x_real") - F.col("y_real")), 6).alias("diff"),
        F.round(F.percentile(F.col("x") - F.col("y"), 0.025), 6).alias("lo"), F.round(F.percentile(F.col("x") - F.col("y"), 0.975), 6).alias("hi"),
    )
    return d


def order_statistic(values: DataFrame, by: str, value: str, q: float = 0.95) -> DataFrame:
    """by, n, median, p: the value at place round(q (n - 1)) of the sorted values, half to even.

    A sketch cuts each group into ranges of some percent; their counts say which one holds the place, and only its distinct values are put in order.
    """
    rows = values.where(F.col(value).isNotNull()).select(by, F.col(value).alias("v"))
    cuts = rows.groupBy(by).agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)], 1000).alias("cuts"), F.percentile("v", 0.5).alias("median"), F.count("*").alias("n"))
    dealt = rows.join(cuts.select(by, "cuts"), by).select(by, "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("range"))
    counts = dealt.groupBy(by, "range").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(by).orderBy("range")) - F.col("c")  # 64 rows a group at most
    at = F.bround(F.lit(q) * (F.col("n") - 1), 0)
    held = counts.withColumn("before", before).join(cuts.select(by, "n", "median"), by).where((F.col("before") <= at) & (at < F.col("before") + F.col("c"))).select(by, "range", "before", "n", "median", at.alias("at"))
    few = dealt.join(F.broadcast(held), [by, "range"]).groupBy(by, "v").agg(F.count("*").alias("c"), *(F.first(x).alias(x) for x in ("before", "n", "median", "at")))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(by).orderBy("v"))
    return few.withColumn("upto", upto).where(F.col("upto") > F.col("at")).groupBy(by).agg(F.max("n").alias("n"), F.max("median").alias("median"), F.min("v").alias("p"))
