"""What several of the training-data operators share."""

from __future__ import annotations

import pickle
import tempfile
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are what stands between these characters; bytes.split() and bytes.lower() act on just these and on A-Z.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a folder of its own; a cluster, whose machines couldn't see that, an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="gleaner-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores appended until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def learned(rows: DataFrame, each: int, fit, most_bytes: int = 48_000_000):
    """What fit(texts, labels) returns for the first rows of a bounded sample; None without rows, or where fit gives None.

    rows: text, label, and any columns that order them. The fitting is done in one task on an executor, which takes up to
    `each` whole texts of every label in that order, passing over those that would make all more than most_bytes (the first of
    a label is always taken). Only the model comes back to the driver.
    """
    text, label, *order = rows.columns

    def run(batches):
        import pandas as pd

        texts, labels, total, have = [], [], 0, Counter()
        for pdf in batches:
            for t, x in zip(pdf[text], pdf[label].tolist()):
                t = t.encode()
                if have[x] < each and (total + len(t) <= most_bytes or not have[x]):
                    texts.append(t), labels.append(x)
                    total += len(t)
                    have[x] += 1
        model = fit(texts, labels) if texts else None
        yield pd.DataFrame({"model": [] if model is None else [pickle.dumps(model)]})

    got = rows.repartition(1).sortWithinPartitions(*order).select(text, label).mapInPandas(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else None


def join_frequent(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, how: str = "inner", most: int = 20_000) -> DataFrame:
    """rows joined (inner or left) with keyed, which has one row a key and in `count` how many of the `total` rows have it.

    A key may be as frequent as it likes: those of more than a `most`-th of all rows, of which there are fewer than `most`
    whatever the data, are broadcast, and only rows of the others are shuffled.
    """
    (hot,) = unused(rows, "hot")
    limit = max(1, total // most)
    names = [c for c in keyed.columns if c not in (key, count)]
    often = keyed.where(F.col(count) > limit).select(key, F.struct(*names).alias(hot))
    seen = rows.join(F.broadcast(often), key, "left")
    by_broadcast = seen.where(F.col(hot).isNotNull()).select(*rows.columns, *(F.col(f"{hot}.{c}") for c in names))
    by_shuffle = seen.where(F.col(hot).isNull()).select(*rows.columns).join(keyed.where(F.col(count) <= limit).select(key, *names), key, how)
    return by_broadcast.union(by_shuffle.select(*rows.columns, *names))


def let(value: str, name: str, body: str) -> str:
    """SQL: body with value, evaluated once, under a name. A column would not do: a later filter on a result may put the column's expression back into a lambda, where every element evaluates it anew."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(values: str, join: str = "{} + {}", span: int = 256) -> str:
    """SQL: running sums (or maxima, with join 'greatest({}, {})') of an array of ints that aren't negative.

    An array grows by copying, so it's done in spans, then over the spans' totals: time is in proportion to length for all
    but extreme lengths.
    """
    none, at = "cast(array() as array<int>)", "coalesce(try_element_at(a, -1), 0)"
    spans = f"transform(sequence(0, greatest(size(v) - 1, 0) div {span}), k -> aggregate(slice(v, {span} * k + 1, {span}), {none}, (a, x) -> concat(a, array(cast({join.format(at, 'x')} as int)))))"
    starts = f"aggregate(p, array(0), (b, y) -> concat(b, array(cast({join.format('element_at(b, -1)', 'coalesce(try_element_at(y, -1), 0)')} as int))))"
    whole = f"flatten(transform(p, (y, k) -> transform(y, x -> cast({join.format('o[k]', 'x')} as int))))"
    return let(values, "v", let(spans, "p", let(starts, "o", whole)))


def learns(remainder: int, modulus: int, holds: bool):
    """Rows whose crc32 of the decimal doc_id leaves (or, with holds False, does not leave) the remainder."""
    left = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))
    return (left == remainder) if holds else (left != remainder)


class WordHashes(dict):
    """64-bit hashes of words, kept while they fit; a full cache starts afresh, so memory is bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def marked(rows: DataFrame, named: DataFrame, name: str, key: str = "doc_id", bits: int = 1 << 24) -> DataFrame:
    """The rows with a boolean column `name`: false only where the key (one column or several, with commas) isn't among those of `named`.

    The keys of `named` set bits in a table of fixed width, at most bits / 64 words, which is what is broadcast. A
    join of the marked rows alone then shuffles the few rows that it may keep instead of all of them.
    """
    s, w, b = unused(rows, "s", "w", "b")
    slot = f"pmod(xxhash64({key}), {bits}L)"
    slots = named.select(F.expr(slot).alias(s)).distinct()
    words = slots.groupBy(F.shiftright(s, 6).alias(w)).agg(F.expr(f"bit_or(shiftleft(1L, cast({s} & 63 as int)))").alias(b))
    looked = rows.withColumn(s, F.expr(slot)).join(F.broadcast(words), F.expr(f"shiftright({s}, 6) = {w}"), "left")
    return looked.select(*rows.columns, F.expr(f"coalesce(shiftright({b}, cast({s} & 63 as int)) & 1, 0) = 1").alias(name))


def _united(batches):
    """(node, root) of all links in the batches, by union-find."""
    import pandas as pd

    top: dict[int, int] = {}

    def find(x):
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf.a.tolist(), pdf.b.tolist()):
            a, b = find(a), find(b)
            if a != b:
                top[max(a, b)] = min(a, b)
    nodes = list(top)
    for i in range(0, max(len(nodes), 1), 65_536):
        part = nodes[i : i + 65_536]
        yield pd.DataFrame({"node": part, "root": [find(x) for x in part]}, dtype="int64")


def connected_components(links: DataFrame, max_rounds: int = 60, small: int = 400_000) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node it reaches.

    Up to `small` distinct links (counted first) are united in one task on an executor, which spares the rounds;
    that task never gets more. Beyond that, large-star and small-star steps alternate until the links form stars; each
    round is two aggregations with partial minima and two joins, and is checkpointed. Both ways give the same rows.
    Null ends and loops are left out. No link ever reaches the driver, only a count and a checksum for each round.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("ok"))
    now = checkpoint(ends.where("ok and a <> b").select("a", "b").distinct())
    if now.count() <= small:
        return now.coalesce(1).mapInPandas(_united, "node long, root long")
    state = None
    for _ in range(max_rounds):
        sum_ = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.min(F.xxhash64("b", "a"))).first()
        if state == sum_ or sum_[0] == 0:
            break
        state = sum_
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = checkpoint(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpoint(star.union(low.select("a", "m")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(now.select("b", "b").distinct()).toDF("node", "root")
