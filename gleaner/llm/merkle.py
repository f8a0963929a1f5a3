"""Merkle manifest of a dataset: one tree of digests for each group of rows, and one over the groups' roots.

Leaves lie in order over range partitions and are cut into short runs. In a run, nodes are events: each goes into its
partial parent, which collects children by index until it has as many as the size of its level says, and then is an
event itself. Children whose parents stay partial are the run's frontier, a few nodes on each level; frontiers are
shuffled by the ancestor that they share, ever higher ones, until each group has its root. On the way back every
frontier node gets its path to the root, and what it was combined from gets that path after its own steps, so that
the leaves end with whole proofs. No task holds more than a run or some dozens of frontiers.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint

PATH = "array<struct<left:string,right:string>>"
NODE = "g string, size long, level int, index long, first long, digest string, src long"
UPPER = f"g string, src long, size long, level int, index long, first long, subroot string, root string, path {PATH}"
#: Names of the columns that a manifest makes.
OWN = {"g", "digest", "salt", "at", "run", "leaf", "subroot", "root", "path", "proof"}
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the strings, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column | str) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column | str) -> Column:
    return digest(*map(framed, values))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf leads to by its proof."""
    return F.aggregate(path, start, lambda a, s: digest(s["left"], a, s["right"]))


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings in a proof, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


class Combiner:
    """Partial parents of one tree of `size` leaves: they take children by index, in any order, until they have all."""

    def __init__(self, size: int, arity: int):
        self.arity, self.sizes = arity, [size]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // arity))
        self.partial: dict[tuple[int, int], dict[int, str]] = {}
        self.whole: dict[tuple[int, int], list[str]] = {}  # children of the parents that were combined here
        self.root: str | None = None

    def add(self, level: int, index: int, value: str) -> None:
        while level + 1 < len(self.sizes):
            parent = (level + 1, index // self.arity)
            children = self.partial.setdefault(parent, {})
            children[index] = value
            if len(children) < min(self.arity, self.sizes[level] - parent[1] * self.arity):
                return
            del self.partial[parent]
            self.whole[parent] = [children[i] for i in sorted(children)]
            value = hashlib.sha256("".join(self.whole[parent]).encode()).hexdigest()
            level, index = parent
        self.root = value

    def frontier(self):
        """(level, index, digest) of the nodes whose parents stay partial, or of the root."""
        if self.root is not None:
            yield len(self.sizes) - 1, 0, self.root
        for (level, _), children in self.partial.items():
            for index, value in children.items():
                yield level - 1, index, value

    def path(self, level: int, index: int, above: dict[tuple[int, int], list], known: dict[tuple[int, int], list]) -> list[tuple[str, str]]:
        """(left siblings, right siblings) on each level up to a node of `above`, then that node's path; known: paths found before."""
        climbed = []
        while (level, index) not in above and (level, index) not in known:
            children = self.whole[level + 1, index // self.arity]
            k = index % self.arity
            climbed.append(((level, index), ("".join(children[:k]), "".join(children[k + 1 :]))))
            level, index = level + 1, index // self.arity
        steps = above.get((level, index)) or known.get((level, index)) or []
        for node, step in reversed(climbed):
            known[node] = steps = [step, *steps]
        return steps


def _table(schema: str, columns: list):
    """An Arrow table of the columns; a path is a list of pairs."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, arrays = [], []
    for (name, kind), values in zip((c.split(" ", 1) for c in schema.split(", ")), columns):
        names.append(name)
        if kind == PATH:
            steps = pa.StructArray.from_arrays([pa.array([s[k] for p in values for s in p], pa.string()) for k in (0, 1)], ["left", "right"])
            arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), steps))
        else:
            arrays.append(pa.array(values, kinds[kind]))
    return pa.table(arrays, names)


def _nodes(g: str, src: int, size: int, arity: int, tree: Combiner):
    rows = [(g, size, level, index, index * arity**level, value, src) for level, index, value in tree.frontier()]
    return _table(NODE, list(zip(*rows)) if rows else [[] for _ in NODE.split(", ")])


def _leaves(table, first: int):
    """(places in the table, leaf numbers) of a run, in order."""
    at = table.column("at").to_numpy()
    order = np.argsort(at, kind="stable")
    return order, first + at[order] - (at.min() if len(at) else 0)


def _run_combined(arity: int):
    def run(rows, said):
        if not rows.num_rows:
            return _table(NODE, [[] for _ in NODE.split(", ")])
        (one,) = said.to_pylist()
        tree, order_first = Combiner(one["size"], arity), _leaves(rows, one["first"])
        values = rows.column("digest").to_pylist()
        for i, index in zip(*(x.tolist() for x in order_first)):
            tree.add(0, index, values[i])
        return _nodes(one["g"], one["run"], one["size"], arity, tree)

    return run


def _joined(rows: list[dict], arity: int) -> Combiner:
    tree = Combiner(rows[0]["size"], arity)
    for r in rows:
        tree.add(r["level"], r["index"], r["digest"])
    return tree


def _frontier_combined(arity: int):
    def run(table):
        rows = table.to_pylist()
        return _nodes(rows[0]["g"], rows[0]["ancestor"], rows[0]["size"], arity, _joined(rows, arity))

    return run


def _above(upper) -> dict[tuple[int, int], list]:
    return {(u["level"], u["index"]): [(s["left"], s["right"]) for s in u["path"]] for u in upper}


def _frontier_proved(arity: int):
    def run(table, upper):
        rows, upper = table.to_pylist(), upper.to_pylist()
        if not rows:
            return _table(UPPER, [[] for _ in UPPER.replace(f" {PATH}", "").split(", ")])
        tree, above, known = _joined(rows, arity), _above(upper), {}
        u = upper[0]
        out = [(r["g"], r["src"], r["size"], r["level"], r["index"], r["first"], u["subroot"], u["root"], tree.path(r["level"], r["index"], above, known)) for r in rows]
        return _table(UPPER, list(zip(*out)))

    return run


def _run_proved(arity: int, names: list[str]):
    def run(rows, upper):
        import pyarrow as pa

        upper = upper.to_pylist()
        order, index = _leaves(rows, min((u["first"] for u in upper), default=0))
        paths: list[list] = []
        if len(order):
            tree, above, known = Combiner(upper[0]["size"], arity), _above(upper), {}
            values = rows.column("digest").to_pylist()
            for i, k in zip(order.tolist(), index.tolist()):
                tree.add(0, k, values[i])
            paths = [tree.path(0, k, above, known) for k in index.tolist()]
        taken = rows.select(names).take(pa.array(order))
        said = [pa.array([upper[0][c] if upper else None] * len(order), pa.string()) for c in ("subroot", "root")]
        path = _table(f"path {PATH}", [paths]).column(0)
        return pa.table([*taken.columns, *said, path], [*names, "subroot", "root", "path"])

    return run


class Tree:
    """The trees of all groups, combined up to their roots.

    leaves: g (string, the group), digest, and any other columns, of which `order` names those that order the leaves of a
    group. Leaves that tie in them are ordered by their digests.
    """

    def __init__(self, leaves: DataFrame, order: list[str], arity: int, run_rows: int, part_rows: int, fan: int):
        self.names, self.arity = leaves.columns, arity
        n = leaves.count()
        least = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = max(1, min(least, -(-n // 16_384)), -(-n // part_rows))  # each takes a sample of its rows to the driver
        keys = ["g", *order, "digest", "salt"]  # the salt deals out rows that are equal
        salted = leaves.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
        placed = salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id())
        # a run is a stretch of a partition; its number holds both
        self.placed = checkpoint(placed.withColumn("run", F.expr(f"at - (at & {2**33 - 1}L) + (at & {2**33 - 1}L) div {run_rows}")))
        runs = self.placed.groupBy("g", "run").agg(F.count("*").alias("n"))
        in_order = Window.partitionBy("g").orderBy("run")  # one row a run, not a leaf
        first = F.sum("n").over(in_order) - F.col("n")
        self.runs = runs.select("g", "run", first.cast("long").alias("first"), F.sum("n").over(Window.partitionBy("g")).cast("long").alias("size"))
        self.stages: list[tuple[DataFrame, list[str]]] = []
        nodes = self.placed.select("g", "run", "at", "digest").groupBy("g", "run").cogroup(self.runs.groupBy("g", "run")).applyInArrow(_run_combined(arity), NODE)
        nodes = checkpoint(nodes)
        largest = nodes.agg(F.max("size")).first()[0] or 0
        span = arity
        while span < run_rows:
            span *= arity
        while True:
            grown = span
            while grown < fan * span and grown < largest:
                grown *= arity
            span = grown
            keyed = nodes.withColumn("ancestor", F.expr(f"first div {span}L"))
            self.stages.append(keyed)
            nodes = checkpoint(keyed.groupBy("g", "ancestor").applyInArrow(_frontier_combined(arity), NODE))
            if span >= largest:
                break
        self.roots = nodes  # of each group one node

    def proved(self, upper: DataFrame) -> DataFrame:
        """The leaves' columns (g too) with subroot, root and path; upper: the rows of UPPER of the groups' roots."""
        for keyed in reversed(self.stages):
            upper = keyed.groupBy("g", "ancestor").cogroup(upper.groupBy("g", "src")).applyInArrow(_frontier_proved(self.arity), UPPER)
            upper = checkpoint(upper)
        schema = ", ".join(f"`{n}` {t}" for n, t in self.placed.select(*self.names).dtypes) + f", subroot string, root string, path {PATH}"
        return self.placed.groupBy("g", "run").cogroup(upper.groupBy("g", "src")).applyInArrow(_run_proved(self.arity, self.names), schema)


def manifest(docs: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, carried: dict[str, Column] | None = None, arity: int = 2, run_rows: int = 8192, part_rows: int = 1_000_000, fan: int = 64) -> DataFrame:
    """One row per row of docs: key, group, leaf, subroot, root, proof, and the columns that `carried` computes from docs.

    leaf: digest of the framed fields; the leaves of each group ascend by key (null first), equal keys by digest. Up to
    `arity` neighbours are combined into a parent, level by level, the last run of a level being as short as it comes,
    until one is left, the subroot; a lone leaf is its group's subroot. Subroots in the order of their groups (null
    first, then by UTF-8 bytes) are the leaves of the tree of root. proof: on each level what stands left and right of the
    node among its siblings, from the leaf through the subroot to the root; `folded` leads from leaf to root. Nulls
    have a frame of their own, so they differ from empty texts; equal rows are leaves of their own; no rows give none.
    """
    carried = carried or {}
    if OWN & {x.lower() for x in (group, key, *carried)}:
        raise ValueError("group, key and carried columns mustn't have a name of the manifest's own columns")
    tagged = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = checkpoint(docs.select(tagged.alias("g"), key, group, leaf(*fields).alias("digest"), *(c.alias(n) for n, c in carried.items())))
    groups = Tree(leaves, [key], arity, run_rows, part_rows, fan)
    whole = Tree(groups.roots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest", "size"), ["name"], arity, run_rows, part_rows, fan)
    none = F.array().cast(PATH)
    top = whole.proved(whole.roots.select("g", F.lit(0).cast("long").alias("src"), "size", "level", "index", "first", F.col("digest").alias("subroot"), F.col("digest").alias("root"), none.alias("path")))
    roots = groups.roots.select(F.col("g").alias("name"), "level", "index", "first").join(top.drop("g"), "name")
    upper = roots.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("src"), "size", "level", "index", "first", F.col("digest").alias("subroot"), "root", "path")
    rows = groups.proved(upper)
    return rows.select(key, group, F.col("digest").alias("leaf"), *carried, "subroot", "root", F.col("path").alias("proof"))
