"""MinHash near-dedup with SetSketch registers.

Every set of word shingles becomes a SetSketch: `m` registers, each floor(1 - log_b(h)) of the smallest
exponentially distributed hash h of the set, truncated to 0..q+1. Registers merge by maximum and two sets
share a register about as often as their Jaccard similarity says. Bands of registers make candidates, the
likelihood of the registers' joint order estimates the similarity of a candidate pair, and the full sets
confirm it.

No link is lost inside a band bucket: members are first held against the bucket's pivot; where a bucket
then still spans several components, everything outside its largest component is held against all of
the bucket. Of a large bucket, a block of members and a block of outsiders meet at a time; that task compares
the sets of pairs that share no earlier band and gives back only links that join components. A member is read by
as many tasks as there are blocks of outsiders in its bucket: the price of losing no link where a bucket's members
don't belong together. A pair at the threshold misses all bands with a probability of (1 - 0.85^5)^32, below 1e-8.

The nodes that are linked are sets, each known by the number of one row that has it, not by a doc_id, which rows may share.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import WordHashes, as_bytes, checkpoint, connected_components, join_frequent, marked, mixed

BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
ROWS, BANDS = 5, 32
REGISTERS = ROWS * BANDS
_RNG = np.random.default_rng(20_240_117)
_FACTORS = (_RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1))[None, :]
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, its A-Z lowered. A text of fewer words is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    n = max(1, len(h) - width + 1)
    acc = np.full(n, min(len(h), width), np.uint64)
    for j in range(min(width, len(h))):
        acc = mixed(acc * _FOLD + h[j : j + n])
    return np.unique(acc)


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes, as big-endian 16-bit numbers."""
    if not len(elements):
        return np.zeros(REGISTERS, ">u2")
    x = (elements >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(low, (x[i : i + 512] * _FACTORS).min(axis=0), out=low)
    h = -np.log1p(-(low + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(">u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 28) -> np.ndarray:
    """Most likely Jaccard similarities of pairs, from how often either register is larger and both set sizes.

    a, b: registers, one pair a row. The log-likelihood is concave in J, so golden-section search finds its top.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / np.maximum(na + nb, 1)
    v = 1 - u

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)

    lo, hi, g = np.zeros(len(a)), np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-300), (5**0.5 - 1) / 2
    for _ in range(steps):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = fit(c) > fit(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2


def _sign(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def _sketched(width: int):
    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            sizes, signs, sketches = [], [], []
            for text in as_bytes(batch.column(1)):
                s = shingles(text, hashes, width)
                sizes.append(len(s))
                signs.append(_sign(s))
                sketches.append(registers(s).tobytes())
            made = [pa.array(sizes, pa.int64()), pa.array(signs, pa.binary()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], ["doc_id", "text_hash", "n_shingles", "sign", "sketch"])

    return run


def _sets(width: int, packed: bool):
    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for i in range(0, len(texts), 256):
                found = [shingles(t, hashes, width) for t in texts[i : i + 256]]
                values = pa.array([x.tobytes() for x in found], pa.binary()) if packed else pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([_sign(x) for x in found], pa.binary()), values], ["sign", "shingles"])

    return run


#: A pair of sets: their numbers, a document that has each, and their signatures.
PAIR = ["a", "b", "doca", "docb", "signa", "signb"]


def _likely(floor: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, REGISTERS) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            yield batch.select(PAIR).filter(pa.array(estimate(a, b, na, nb) >= floor))

    return run


def _common(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of the sets of a with those of b, by products of incidence matrices over slices of the elements."""
    words, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(words), columns):
        i, j = np.searchsorted(place, [lo, lo + columns])
        m = np.zeros((len(a) + len(b), columns), np.float32)
        m[owner[i:j], place[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _in_block(floor: float, percent: int):
    """Links between the outsiders of a bucket and one block of its members, as many as join their components, no more."""

    def run(pdf):
        import pandas as pd

        rest, own = pdf[pdf.outside].reset_index(drop=True), pdf[pdf.own].reset_index(drop=True)
        a, b = (np.frombuffer(b"".join(x.sketch), ">u2").reshape(-1, REGISTERS).astype(np.uint16) for x in (rest, own))
        na, nb = rest.n_shingles.to_numpy(float), own.n_shingles.to_numpy(float)
        ra, rb, band = rest.root.to_numpy(), own.root.to_numpy(), int(pdf.band.iloc[0])
        ia, ib = [], []
        for i in range(len(rest)):
            k = np.flatnonzero(((a[i] == b).mean(1) >= floor - 0.15) & (rb != ra[i]))  # a cheap first look, then the likelihood
            # pairs that share an earlier band meet in that one's bucket
            k = k[~(a[i, : band * ROWS] == b[k, : band * ROWS]).reshape(len(k), band, ROWS).all(2).any(1)] if band else k
            k = k[estimate(np.broadcast_to(a[i], (len(k), REGISTERS)), b[k], np.full(len(k), na[i]), nb[k]) >= floor] if len(k) else k
            ia.append(np.full(len(k), i)), ib.append(k)
        ia, ib = (np.concatenate(x) if x else np.empty(0, int) for x in (ia, ib))
        ua, pa_ = np.unique(ia, return_inverse=True)
        ub, pb_ = np.unique(ib, return_inverse=True)
        found: dict[int, int] = {}

        def top(x):
            while found.get(x, x) != x:
                x = found[x]
            return x

        out = []
        if len(ia):
            both = _common(*([np.frombuffer(x.shingles[i], np.uint64) for i in u] for x, u in ((rest, ua), (own, ub))))[pa_, pb_]
            linked = both * 100 >= (na[ia] + nb[ib] - both) * percent
            for i, j in zip(ia[linked], ib[linked]):
                x, y = top(int(ra[i])), top(int(rb[j]))
                if x != y:
                    found[max(x, y)] = min(x, y)
                    p, q = int(rest.rep[i]), int(own.rep[j])
                    out.append((max(p, q), min(p, q)))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, slack: float = 0.17, small_bucket: int = 64, block: int = 256) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    docs: columns doc_id (long) and text; others are ignored. Documents whose sets share percent/100 of their
    union are linked; component_id is the smallest doc_id of the component, kept tells whether the document
    is that one. Null, empty and wordless texts have no shingles and stay alone; a null doc_id is kept as a row
    without a component of others. Equal sets collapse before any pair is made, so copies cost one row each.
    Rows of one doc_id are linked by their own texts: where those differ, they can be in different components.
    slack: a candidate whose estimated similarity is lower than the threshold by more than this (over five
    standard errors of 160 registers) isn't confirmed.
    Very frequent sets and bands are joined by broadcast (`join_frequent`), so no task gets all rows of one.
    """
    floor = percent / 100 - slack
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    made = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketched(width), "doc_id long, text_hash long, n_shingles long, sign binary, sketch binary")
    sketched = checkpoint(made.withColumn("row", F.monotonically_increasing_id()))
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "sketch")]
    groups = checkpoint(full.groupBy("sign").agg(F.min("row").alias("rep"), F.min("doc_id").alias("doc"), F.count("*").alias("copies"), *firsts))
    n_rows, n_sets = (x or 0 for x in groups.agg(F.sum("copies"), F.count("*")).first())

    bands = groups.select("rep", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    bands = bands.select("rep", "band", F.expr(f"xxhash64(band, substring(sketch, {2 * ROWS} * band + 1, {2 * ROWS}))").alias("key"))
    # xor with the key orders the members of every bucket in another way, so a large group meets many pivots
    buckets = bands.groupBy("key").agg(F.count("*").alias("count"), F.min(F.col("rep").bitwiseXOR(F.col("key"))).alias("low")).where("count > 1")
    buckets = buckets.select("key", "count", F.col("count").alias("n"), F.col("low").bitwiseXOR(F.col("key")).alias("pivot"))
    inside = checkpoint(join_frequent(bands, buckets, "key", "count", n_sets * BANDS))

    def sets_of(named: DataFrame, packed: bool = False) -> DataFrame:
        """(sign, shingles) of the documents named (doc_id); a doc_id that rows of other texts share brings their sets too."""
        kind = "binary" if packed else "array<long>"
        there = marked(docs, named, "there").where("there").select("doc_id", "text")
        found = there.join(named, "doc_id", "left_semi").select("text").mapInArrow(_sets(width, packed), f"sign binary, shingles {kind}")
        return checkpoint(found.dropDuplicates(["sign"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        ra, rb = (groups.select(F.col("rep").alias(c), F.col("doc").alias(f"doc{c}"), F.col("sign").alias(f"sign{c}"), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
        pairs = checkpoint(pairs.join(ra, "a").join(rb, "b").where(close).mapInArrow(_likely(floor), "a long, b long, doca long, docb long, signa binary, signb binary"))
        sets = sets_of(pairs.select(F.col("doca").alias("doc_id")).union(pairs.select("docb")).distinct())
        xa, xb = (sets.select(F.col("sign").alias(f"sign{c}"), F.col("shingles").alias(f"x{c}")) for c in "ab")
        both = F.size(F.array_intersect("xa", "xb"))
        held = pairs.join(xa, "signa").join(xb, "signb").where(both * 100 >= (F.size("xa") + F.size("xb") - both) * percent)
        return checkpoint(held.select("a", "b"))

    star = inside.where("rep <> pivot").select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
    links = confirmed(star)
    roots = checkpoint(connected_components(links))

    labelled = inside.where("n > 2").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    per = labelled.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = per.groupBy("key").agg(F.max_by("root", "c").alias("main"), (F.sum("c") - F.max("c")).alias("outsiders"), F.sum("c").alias("count")).where("outsiders > 0")
    open_ = checkpoint(join_frequent(labelled, main, "key", "count", n_sets * BANDS).withColumn("outside", F.col("root") != F.col("main")))
    few = open_.where(f"n <= {small_bucket} and rep <> pivot")
    other = few.select("key", F.col("rep").alias("rep2"), F.col("root").alias("root2"))
    pairs = few.where("outside").join(other, "key").where("root <> root2").select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b")).distinct()
    more = [confirmed(pairs)]
    many = open_.where(f"n > {small_bucket}")
    if not many.isEmpty():
        sketches = groups.select("rep", F.col("doc").alias("doc_id"), "sign", "n_shingles", "sketch").join(many.select("rep").distinct(), "rep", "left_semi")
        many = many.join(sketches.join(sets_of(sketches.select("doc_id"), packed=True), "sign"), "rep")
        own_blocks, rest_blocks = (F.ceil(F.col(c) / block).cast("int") for c in ("n", "outsiders"))
        names = ["rep", "root", "band", "n_shingles", "sketch", "shingles"]
        dealt, dealt_rest = (F.pmod(F.xxhash64("rep"), n).cast("int") for n in (own_blocks, rest_blocks))
        own = many.select("key", dealt.alias("block"), F.explode(F.sequence(F.lit(0), rest_blocks - 1)).alias("rest_block"), *names, F.lit(True).alias("own"), F.lit(False).alias("outside"))
        rest = many.where("outside").select("key", F.explode(F.sequence(F.lit(0), own_blocks - 1)).alias("block"), dealt_rest.alias("rest_block"), *names, F.lit(False).alias("own"), F.lit(True).alias("outside"))
        more.append(checkpoint(own.union(rest).groupBy("key", "block", "rest_block").applyInPandas(_in_block(floor, percent), "a long, b long").distinct()))
    added = more[0] if len(more) == 1 else more[0].union(more[1])
    if not added.isEmpty():
        roots = checkpoint(connected_components(links.union(added)))

    # what each set belongs to: only sets with copies or links need a look, all other rows are components of their own
    held = groups.select("sign", "copies", "doc", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").where("root is not null or copies > 1")
    held = checkpoint(held.withColumn("root", F.coalesce("root", "rep")))
    component = held.groupBy("root").agg(F.min("doc").alias("component"), F.count("*").alias("count"))
    named = checkpoint(join_frequent(held, component, "root", "count", n_sets).select("sign", "copies", "component"))
    rows = join_frequent(sketched.select("doc_id", "n_shingles", "sign", "text_hash"), named, "sign", "copies", n_rows, "left")
    # a row without an id counts in no set
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"), "text_hash")
