"""Mixing sources to target weights with a splitting tree of block quotas.

A source's documents fall into blocks by hash, more of them the more documents it has. Its target in words becomes a quota: whole
passes over all its blocks, then a last pass over a permuted prefix of them, the last of those in part. The
block quotas of all sources go down a binary tree over the output shards; at each node the left half's share
is a multivariate hypergeometric draw, so every leaf gets exact counts and they sum to the quotas. Leaves then
draw disjoint blocks from each source's permuted list, and the rows of a shard are ordered by hash.

Only the block table is planned on the driver and broadcast; its size is bounded (`block_numbers`), whatever the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint, unused

WEIGHTS, CEILING = (5, 2, 1), 3


def targets(sizes: list[int], weights: list[float], ceiling: float = CEILING) -> list[float]:
    """Shares of the sum of sizes by weight; none above ceiling x its size, the excess goes to the others by weight."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        scale = total / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * scale > ceiling * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * scale
            break
        for i in over:
            out[i] = float(ceiling * sizes[i])
            total -= out[i]
        free = [i for i in free if i not in over]
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """[shard, source] block counts: every column sums to its quota, every shard has as many blocks as any other, or one less."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = np.zeros_like(have)
        want, rest = int(have.sum()) * (mid - lo) // (hi - lo), int(have.sum())
        for k, n in enumerate(have):  # the multivariate draw as a chain of hypergeometric ones
            rest -= int(n)
            left[k] = rng.hypergeometric(n, rest, want) if want and n and rest else min(int(n), want)
            want -= int(left[k])
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "big")


def plan(block_words: dict, weights=WEIGHTS, ceiling=CEILING, shards: int = 16, seed: int = 7):
    """(source rows, block rows) from {(source or None, block): words}.

    Source: (source, size, target). Block: (source, block, copies, part, shards): how often it is taken whole, how
    many words of a further pass, and the output shard of each pass.
    """
    sources = sorted({s for s, _ in block_words}, key=lambda s: (s is None, s or ""))
    blocks: dict = {s: [] for s in sources}
    for s, b in sorted(block_words, key=lambda k: k[1]):
        blocks[s].append(b)
    sizes = [sum(block_words[s, b] for b in blocks[s]) for s in sources]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sources))], ceiling)
    drawn = []
    for s, size, goal in zip(sources, sizes, goals):
        passes, rest = (int(goal // size), goal - size * (goal // size)) if size else (0, 0.0)
        order, rng = [], np.random.default_rng(_seed(seed, s))
        for _ in range(passes):
            order += [(b, None) for b in rng.permutation(blocks[s]).tolist()]
        for b in rng.permutation(blocks[s]).tolist():
            if rest < 0.5:
                break
            n = block_words[s, b]
            if n:
                order.append((b, None if n <= rest else rest))
                rest -= n
        drawn.append(order)
    tree = splitting_tree([len(o) for o in drawn], shards, seed)
    rows = []
    for k, (s, order) in enumerate(zip(sources, drawn)):
        per: dict = {b: [0, 0.0, []] for b in blocks[s]}
        for (b, part), shard in zip(order, np.repeat(np.arange(shards), tree[:, k]).tolist()):
            per[b][2].append(shard)
            if part is None:
                per[b][0] += 1
            else:
                per[b][1] = float(part)
        rows += [(s, b, *v) for b, v in per.items()]
    return list(zip(sources, sizes, goals)), rows


def block_numbers(rows: dict, most: int = 65_536) -> dict:
    """Blocks of each source from its number of rows: one for every 20 000 of them, or for more where that would make over 3 x `most` blocks; at least 256, or as many as give all sources `most` together."""
    least, each = max(1, min(256, most // max(len(rows), 1))), max(20_000, sum(rows.values()) // (3 * most))
    return {s: max(least, -(-n // each)) for s, n in rows.items()}


#: Columns that the mix adds, under these names or, where the documents have such columns already, under others.
ADDED = ("size", "place", "source_size", "target", "copies", "taken", "shards")


def _mixed(docs: DataFrame, names: tuple[str, ...], weights, ceiling: int, shards: int, seed: int, most_sources: int) -> tuple[DataFrame, int]:
    """(the rows of docs with the columns ADDED under the given names, words that the mix takes)."""
    size, place, source_size, target, copies, taken, given = names
    spark = docs.sparkSession
    words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")
    # salted with the text, so that a repeated doc_id doesn't fill one block
    rows = docs.withColumn(size, words).withColumn(place, F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(seed)))
    slim = checkpoint(rows.select("source", F.col(size).alias("size"), F.col(place).alias("place")))
    totals = {r[0]: r[1] for r in slim.groupBy("source").agg(F.count("*")).limit(most_sources + 1).collect()}
    if len(totals) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    numbers = block_numbers(totals)
    counts = spark.createDataFrame(list(numbers.items()), "s string, blocks int")
    block = F.pmod(F.shiftright("place", 8), F.col("blocks")).cast("int").alias("block")
    slim = slim.join(F.broadcast(counts), F.expr("source <=> s")).select("source", "size", "place", block)
    found = slim.groupBy("source", "block").agg(F.sum("size").alias("words"))
    by_source, by_block = plan({(r[0], r[1]): r[2] for r in found.toLocalIterator()}, weights, ceiling, shards, seed)

    # a source has at most one block that is taken in part; equal rows are one row there, so a window never gets many of them
    parts = spark.createDataFrame([r[:2] + (r[3],) for r in by_block if r[3] > 0], "s string, k int, part double")
    head = slim.join(F.broadcast(parts), F.expr("source <=> s and block = k")).groupBy("source", "part", "place", "size").agg(F.count("*").alias("n"))
    before = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1))
    # of n equal rows those whose middle lies before the part's end
    takes = F.when(F.col("size") == 0, F.when(F.col("before") <= F.col("part"), F.col("n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least("n", F.floor((F.col("part") - F.col("before")) / F.col("size") + 0.5))))
    head = head.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("takes", takes.cast("long")).where("takes > 0")
    stops = {r[0]: tuple(r[1]) for r in head.groupBy("source").agg(F.max(F.struct("place", "takes", "n"))).collect()}

    goals = {s: (n, goal) for s, n, goal in by_source}
    table = [(s, k, numbers[s], whole, list(map(int, to)), *goals[s], *(stops.get(s, (None,) * 3) if part > 0 else (None,) * 3)) for s, k, whole, part, to in by_block]
    s, k, n, whole, to, goal_size, goal, stop, takes, ties = unused(rows, "s", "k", "n", "whole", "to", "goal_size", "goal", "stop", "takes", "ties")
    # one row a block, at most a few hundred thousand (block_numbers) and as many sources
    planned = F.broadcast(spark.createDataFrame(table, f"{s} string, {k} int, {n} int, {whole} int, {to} array<int>, {goal_size} long, {goal} double, {stop} long, {takes} long, {ties} long"))
    numbered = F.broadcast(spark.createDataFrame(list(numbers.items()), f"{s} string, {n} int"))
    (own,) = unused(rows.select("*", *(F.lit(0).alias(c) for c in (s, k, n))), "own")
    out = rows.join(numbered, F.expr(f"source <=> {s}")).withColumn(own, F.pmod(F.shiftright(place, 8), F.col(n)).cast("int")).drop(s, n)
    out = out.join(planned, F.expr(f"source <=> {s} and {own} = {k}"))
    tied = F.coalesce((F.col(place) == F.col(stop)) & (F.col(takes) < F.col(ties)), F.lit(False))

    def finished(part: DataFrame, more) -> DataFrame:
        part = part.withColumn(copies, F.col(whole) + F.when(more, 1).otherwise(0))
        part = part.withColumn(taken, (F.col(copies) * F.col(size)).cast("long")).withColumn(given, F.slice(to, F.lit(1), F.col(copies)))
        return part.select(*docs.columns, *(F.col(a).alias(b) for a, b in ((size, size), (place, place), (goal_size, source_size), (goal, target), (copies, copies), (taken, taken), (given, given))))

    done = finished(out.where(~tied), F.col(place) <= F.col(stop))
    if any(t < n_ for _, t, n_ in stops.values()):
        # equal rows that are taken in part: numbered, at most 100 000 in a window
        salts = F.ceil(F.col(ties) / 100_000)
        (salt, number) = unused(out, "salt", "number")
        some = out.where(tied).withColumn(salt, F.pmod(F.monotonically_increasing_id(), salts))
        some = some.withColumn(number, F.row_number().over(Window.partitionBy("source", place, salt).orderBy(F.lit(0))))
        quota = F.floor((F.col(salt) + 1) * F.col(takes) / salts) - F.floor(F.col(salt) * F.col(takes) / salts)
        done = done.union(finished(some, F.col(number) <= quota))
    return done, int(sum(goal for _, _, goal in by_source))


def mix(docs: DataFrame, weights=WEIGHTS, ceiling: int = CEILING, shards: int = 16, seed: int = 7, most_sources: int = 200_000) -> DataFrame:
    """The rows of docs with size, place, source_size, target, copies, taken, shards array<int>.

    docs: doc_id, text, source; other columns pass through (but those with the names added here are replaced).
    Sources by code point, null last, weigh `weights` in turn; more than most_sources of them raise an error, as their table
    is planned on the driver. copies: how often the mix takes the row, taken = copies x size. A block taken in part gives its
    first rows in hash order, up to the row that comes nearest to what is left; of rows that repeat id and text, as many as that
    takes. Empty and null texts have size 0 and are in the mix as often as their block. Equal input gives equal output:
    nothing depends on partitions or order, but for which of several equal rows are taken.
    """
    docs = docs.drop(*ADDED)
    return _mixed(docs, ADDED, weights, ceiling, shards, seed, most_sources)[0]


def mixed_documents(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """The documents of the mix, a row for each copy, with the columns of docs; a shard's rows are shuffled among themselves, in as many parts as its words ask for."""
    options = {"weights": WEIGHTS, "ceiling": CEILING, "seed": 7, "most_sources": 200_000} | options
    names = unused(docs, *ADDED)
    rows, words = _mixed(docs, names, shards=shards, **options)
    copy, shard, order = unused(rows, "copy", "shard", "order")
    taken = rows.select(*docs.columns, names[1], F.posexplode(names[-1]).alias(copy, shard)).withColumn(order, F.xxhash64(names[1], copy))
    parts = max(64, words // shards // 20_000_000)
    return taken.repartition(F.col(shard), F.pmod(order, F.lit(parts))).sortWithinPartitions(shard, order).select(docs.columns)
