"""Embedding near-dedup: hierarchical navigable small-world graphs per shard.

Vectors are dealt evenly into shards of bounded size. A shard's graph holds one node for each ball: a vector that
lies within half the linking angle of a node (less a margin) joins that node's ball, and all members of a ball link
with each other for certain, however many there are. Then every shard is queried with the nodes of every shard, by
beam search from the top level down. A beam that fills up with hits is widened, and all beams of a shard are
widened until the audited queries miss nothing: some of the nodes, held against a scan of the shard, and, where these
have few links, planted queries at just the linking cosine to nodes of the shard. Two balls link wholly, not
at all, or (by the triangle inequality undecided) member by member; every undecided pair of vectors is verified by
cosine in double precision. Balls with a link are united.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import checkpoint, connected_components


def beam_search(near: np.ndarray, x: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the `width` best nodes that each query finds; -1 and -2 where it found fewer.

    near: neighbour lists (-1: none); entry: starting nodes of each query. All queries step together.
    """
    n, nq = len(x), len(q)
    ids, sims = np.full((nq, width), -1, np.int32), np.full((nq, width), -2.0, np.float32)
    open_, seen = np.zeros((nq, width), bool), np.zeros((nq, n + 1), bool)
    entry = entry[:, :width]
    ids[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("qmd,qd->qm", x[entry], q), -2)
    open_[:, : entry.shape[1]] = entry >= 0
    seen[np.arange(nq)[:, None], entry] = True
    at, expand = np.arange(nq), min(expand, width)
    while len(at):
        score = np.where(open_[at], sims[at], -3)
        pick = np.argpartition(-score, expand - 1, axis=1)[:, :expand]
        live = np.take_along_axis(score, pick, 1) > -2
        some = live.any(1)
        at, pick, live = at[some], pick[some], live[some]
        if not len(at):
            break
        rows = at[:, None]
        next_ = np.where(live[:, :, None], near[ids[rows, pick]], -1).reshape(len(at), -1)
        open_[rows, pick] = False
        next_.sort(axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
        next_[seen[rows, next_]] = -1
        seen[rows, next_] = True
        seen[:, n] = False
        r, c = np.nonzero(next_ >= 0)  # most neighbours have been seen: vectors are fetched for the others alone
        s = np.full(next_.shape, -2, np.float32)
        s[r, c] = np.einsum("nd,nd->n", x[next_[r, c]], q[at[r]])
        all_i, all_s, all_o = np.concatenate([ids[at], next_], 1), np.concatenate([sims[at], s], 1), np.concatenate([open_[at], next_ >= 0], 1)
        top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        ids[at], sims[at], open_[at] = (np.take_along_axis(a, top, 1) for a in (all_i, all_s, all_o))
    return ids, sims


def diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` neighbours of each node, nearest first, leaving out those nearer to a chosen one than to the node; room left goes to the nearest of them."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    v = x[cand]
    between = v @ v.transpose(0, 2, 1)
    state = np.where(cand >= 0, 1, 0)  # 1 free, 2 chosen, 0 out
    left, rows = state.copy(), np.arange(len(cand))
    out, filled = np.full((len(cand), most), -1, np.int32), np.zeros(len(cand), int)
    for j in range(cand.shape[1]):
        take = (left[:, j] == 1) & (filled < most)
        out[rows[take], filled[take]] = cand[take, j]
        filled[take] += 1
        state[take, j] = 2
        left[take] = np.where(between[take, j] > sims[take], 0, left[take])
    for j in range(cand.shape[1]):
        take = (state[:, j] == 1) & (filled < most)
        out[rows[take], filled[take]] = cand[take, j]
        filled[take] += 1
    return out


class Graph:
    """Levels of neighbour lists over the nodes of one shard; level 0 has all of them."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray], top: int):
        self.x, self.near, self.top = x, near, top

    def entries(self, q: np.ndarray, above: int, width: int = 4) -> np.ndarray:
        at = np.full((len(q), 1), self.top, np.int32)
        for level in range(len(self.near) - 1, above, -1):
            at, _ = beam_search(self.near[level], self.x, q, at, width, 2)
        return at

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return beam_search(self.near[0], self.x, q, self.entries(q, 0), max(4, min(width, len(self.x))))


def build(x: np.ndarray, absorb: float, links: int = 12, width: int = 48, batch: int = 256, seed: int = 3) -> tuple[Graph, np.ndarray]:
    """(graph over the nodes, for each row of x the row of its node). Rows within cosine `absorb` of a node join its ball."""
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(int), 6)
    node = np.full(n, -1)
    order = np.argsort(-level, kind="stable")
    tops = int(level[order[0]])
    near = [np.full((n + 1, links * (2 if k == 0 else 1)), -1, np.int32) for k in range(tops + 1)]
    graph = Graph(x, near, int(order[0]))
    for k in range(tops, -1, -1):
        have: list[int] = []
        upper = [i for i in order if level[i] > k and node[i] == i]
        fresh = [i for i in order if level[i] == k and node[i] < 0]
        for ids, joins in ((upper, False), (fresh, True)):
            lo, size = 0, 32
            while lo < len(ids):
                part = np.array(ids[lo : lo + size])
                lo, size = lo + size, min(2 * size, batch)
                q, most = x[part], near[k].shape[1]
                if have:
                    start = graph.entries(q, k) if joins and k < tops else np.full((len(q), 1), have[0], np.int32)
                    cand, sims = beam_search(near[k], x, q, start, min(width, max(4, len(have))))
                else:
                    cand, sims = np.full((len(q), 1), -1, np.int32), np.full((len(q), 1), -2.0, np.float32)
                own = q @ q.T
                keep = np.ones(len(part), bool)
                if joins:
                    best = sims.argmax(1)
                    hit = sims[np.arange(len(part)), best] >= absorb
                    node[part[hit]] = cand[hit, best[hit]]
                    keep &= ~hit
                    for i in np.flatnonzero(keep):
                        if keep[i]:
                            node[part[i]] = part[i]
                            later = np.flatnonzero((own[i] >= absorb) & keep)
                            later = later[later > i]
                            node[part[later]] = part[i]
                            keep[later] = False
                part, q, cand, sims, own = part[keep], q[keep], cand[keep], sims[keep], own[np.ix_(keep, keep)]
                if not len(part):
                    continue
                np.fill_diagonal(own, -2)
                m = min(links, len(part))
                close = np.argpartition(-own, m - 1, axis=1)[:, :m]
                s2 = np.take_along_axis(own, close, 1)
                cand, sims = np.concatenate([cand, np.where(s2 > -2, part[close], -1)], 1), np.concatenate([sims, s2], 1)
                near[k][part] = diverse(x, cand, sims, most)
                have += part.tolist()
                _link_back(near[k], x, part, most)
    return graph, node


def _link_back(near: np.ndarray, x: np.ndarray, part: np.ndarray, most: int) -> None:
    """Add the reverse of every new link; lists that grow too long are chosen anew."""
    to, from_ = near[part].ravel(), np.repeat(part, near.shape[1])
    ok = to >= 0
    to, from_ = to[ok], from_[ok]
    order = np.argsort(to, kind="stable")
    to, from_ = to[order], from_[order]
    heads, first, count = np.unique(to, return_index=True, return_counts=True)
    add = np.full((len(heads), int(count.max(initial=0))), -1, np.int32)
    add[np.repeat(np.arange(len(heads)), count), np.arange(len(to)) - np.repeat(first, count)] = from_
    for i in range(0, len(heads), 512):
        h = heads[i : i + 512]
        cand = np.sort(np.concatenate([near[h], add[i : i + 512]], 1), 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        sims = np.where(cand >= 0, np.einsum("qmd,qd->qm", x[cand], x[h]), -2).astype(np.float32)
        top = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        near[h] = diverse(x, np.take_along_axis(cand, top, 1), np.take_along_axis(sims, top, 1), most)


def _scan(x: np.ndarray, nodes: np.ndarray, q: np.ndarray, asked: np.ndarray, least: np.ndarray, block: int = 512) -> np.ndarray:
    """(query, node) of all pairs of the asked queries and the nodes that are similar enough."""
    out = [np.empty((0, 2), np.int64)]
    for i in range(0, len(asked) if len(nodes) else 0, block):
        t = asked[i : i + block]
        r, c = np.nonzero(q[t] @ x[nodes].T >= least[t, None])
        out.append(np.stack([t[r], nodes[c]], 1))
    return np.concatenate(out)


def _asked(graph: Graph, q: np.ndarray, least: np.ndarray, asked: np.ndarray, width: int, block: int) -> np.ndarray:
    """(query, node) of the pairs that the asked queries' beams hold; a query whose beam holds nothing but hits is asked again with twice the beam."""
    n, found = len(graph.x), [np.empty((0, 2), np.int64)]
    todo, w = asked, min(width, n)
    while len(todo):
        full = []
        for i in range(0, len(todo), block):
            t = todo[i : i + block]
            ids, sims = graph.search(q[t], w)
            hit = (sims >= least[t, None]) & (ids >= 0)
            over = hit.all(1) & (w < n)
            full.append(t[over])
            r, c = np.nonzero(hit & ~over[:, None])
            found.append(np.stack([t[r], ids[r, c]], 1))
        todo, w = np.concatenate(full), min(2 * w, n)
    return np.concatenate(found)


def _planted(x: np.ndarray, targets: np.ndarray, cosines: np.ndarray, seed: int = 11) -> np.ndarray:
    """One query for each target: a random unit vector with the given cosine to it."""
    v = x[targets].astype(np.float64)
    side = np.random.default_rng(seed).normal(size=v.shape)
    side -= (side * v).sum(1, keepdims=True) * v
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
    c = np.clip(cosines, -1, 1)[:, None]
    return (c * v + np.sqrt(1 - c * c) * side).astype(np.float32)


def hits(graph: Graph, q: np.ndarray, least: np.ndarray, width: int = 24, audits: int = 96, block: int = 512, wanted: int = 128, own: bool = False, slack: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all pairs with a similarity of `least` of the query or more, up to what the audits can't tell.

    Audited are `audits` of the queries, whose true hits a scan tells, and, where these hold fewer than `wanted` (with
    `own`, where the queries are the nodes, not counting themselves), planted queries that have just the linking
    similarity to a node, for nodes from all over the graph. slack: angles by which a node's bar is stricter than the
    queries' own; a hit below it is found or not, but no audit asks for it. So a shard that has few links is audited as well as others. As
    long as an audited query misses a hit, the beam is doubled, and all queries are asked with the beam that passes. Where
    even a beam as wide as the graph misses one, or where there are no more queries than audits, the scan is the answer.
    Nodes that no neighbour list names can't be reached and are always scanned. Pairs may repeat.
    """
    n, everything = len(graph.x), np.arange(len(q))
    asked = np.linspace(0, len(q) - 1, min(audits, len(q))).astype(int)
    truth = _scan(graph.x, np.arange(n), q, asked, least)
    if len(asked) == len(q):
        return truth[:, 0], truth[:, 1]
    named = np.zeros(n + 1, bool)
    named[graph.near[0][:n].ravel()] = True
    named = named[:n]
    lone = _scan(graph.x, np.flatnonzero(~named), q, everything, least)
    slack, reach = np.zeros(n) if slack is None else slack, np.arccos(np.clip(least, -1, 1))
    sims = np.clip(np.einsum("nd,nd->n", q[truth[:, 0]], graph.x[truth[:, 1]]), -1, 1)
    due = np.arccos(sims) <= reach[truth[:, 0]] - slack[truth[:, 1]]
    others = truth[due & named[truth[:, 1]] & ~(own & (truth[:, 0] == truth[:, 1]))]
    targets = np.flatnonzero(named)
    targets = targets[np.linspace(0, len(targets) - 1, min(max(wanted - len(others), 0), len(targets))).astype(int)]
    bars = np.cos(np.maximum(reach.min() - slack[targets], 0)) - 1e-4
    planted = _planted(graph.x, targets, bars + 2e-4)
    while True:
        pairs = _asked(graph, q, least, asked, width, block) @ [n, 1]
        made = _asked(graph, planted, bars, np.arange(len(planted)), width, block) @ [n, 1]
        if np.isin(others @ [n, 1], pairs).all() and np.isin(np.arange(len(planted)) * n + targets, made).all():
            found = np.concatenate([lone, _asked(graph, q, least, everything, width, block)])
            return found[:, 0], found[:, 1]
        if width >= n:
            found = _scan(graph.x, np.arange(n), q, everything, least)
            return found[:, 0], found[:, 1]
        width *= 2


def _save(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows in double precision times powers of two that bring their largest component near one, so that no square over- or underflows; cosines stay as they are."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _built(cosine: float):
    def run(pdf):
        import pandas as pd

        ids = pdf.vec_id.to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        v = np.stack(pdf.embedding.to_numpy())[order]
        v = v if v.dtype == np.float32 else v.astype(np.float64)
        unit = _scaled(v)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        x = np.append(unit, np.zeros((1, v.shape[1])), 0).astype(np.float32)  # row -1 stands for no neighbour
        absorb = np.sqrt((1 + cosine) / 2) + 3e-4
        graph, node = build(x[:-1], absorb)
        nodes, ball = np.unique(node, return_inverse=True)
        new = np.full(len(node) + 1, -1, np.int32)
        new[nodes] = np.arange(len(nodes))
        near = [new[g[nodes]] for g in graph.near]
        angle = np.arccos(np.clip(np.einsum("nd,nd->n", unit, unit[nodes][ball]), -1, 1))
        radius = np.zeros(len(nodes))
        np.maximum.at(radius, ball, angle)
        counts = np.bincount(ball)
        radius = np.where(counts > 1, radius + 1e-7, 0)
        label = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(label, ball, ids)
        blob = _save(ids=ids, v=v, ball=ball, nodes=nodes, radius=radius, label=label, top=new[graph.top], **{f"near{k}": g for k, g in enumerate(near)})
        return pd.DataFrame({"dim": [v.shape[1]], "shard": [int(pdf.shard.iloc[0])], "blob": [blob]})

    return run


class Shard:
    def __init__(self, blob: bytes):
        z = np.load(io.BytesIO(blob))
        self.ids, self.v, self.ball, self.nodes, self.radius, self.label = (z[k] for k in ("ids", "v", "ball", "nodes", "radius", "label"))
        self.v = _scaled(self.v)
        self.norm = np.linalg.norm(self.v, axis=1)
        self.size = np.bincount(self.ball, minlength=len(self.nodes))
        by = np.argsort(self.ball, kind="stable")
        self.members = np.split(by, np.cumsum(self.size)[:-1])
        x = (self.v[self.nodes] / self.norm[self.nodes, None]).astype(np.float32)
        near = [z[f"near{k}"] for k in range(len([k for k in z.files if k.startswith("near")]))]
        self.graph = Graph(x, near, int(z["top"]))

    def cosines(self, mine, other: Shard, others) -> np.ndarray:
        return (self.v[mine] @ other.v[others].T) / (self.norm[mine][:, None] * other.norm[others][None, :])


def compare(a: Shard, b: Shard, same: bool, cosine: float):
    """(links of whole balls by label, links of single members by place, linked balls) between two shards, or within one."""
    angle = np.arccos(cosine)

    def asks(one, two, **more):
        if two.radius.any():
            more["slack"] = two.radius.max() - two.radius
        return hits(two.graph, one.graph.x, np.cos(np.minimum(angle + one.radius + two.radius.max(), np.pi)) - 1e-4, **more)

    i, j = asks(a, b, own=True) if same else asks(a, b)
    if same:
        lo, hi = np.minimum(i, j), np.maximum(i, j)
        i, j = lo[lo < hi], hi[lo < hi]
    else:
        j2, i2 = asks(b, a)
        i, j = np.concatenate([i, i2]), np.concatenate([j, j2])
    i, j = np.divmod(np.unique(i.astype(np.int64) * len(b.nodes) + j), len(b.nodes))
    na, nb = a.nodes[i], b.nodes[j]
    between = np.concatenate([np.arccos(np.clip(np.einsum("nd,nd->n", a.v[na[k : k + 65536]], b.v[nb[k : k + 65536]]) / (a.norm[na[k : k + 65536]] * b.norm[nb[k : k + 65536]]), -1, 1)) for k in range(0, len(i), 65536)] or [np.empty(0)])
    around = a.radius[i] + b.radius[j]
    whole = (between + around <= angle - 1e-7) & (around > 0)
    near = ~whole & (between - around <= angle + 1e-7)
    wa, wb = np.bincount(i[whole], b.size[j[whole]], len(a.nodes)), np.bincount(j[whole], a.size[i[whole]], len(b.nodes))
    ma, mb, linked = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64), [np.stack([a.label[i[whole]], b.label[j[whole]]], 1)]
    for p, q in zip(i[near], j[near]):
        ga, gb = a.members[p], b.members[q]
        any_ = False
        for k in range(0, len(ga), 1024):
            link = a.cosines(ga[k : k + 1024], b, gb) >= cosine
            ma[ga[k : k + 1024]] += link.sum(1)
            mb[gb] += link.sum(0)
            any_ |= bool(link.any())
        if any_:
            linked.append(np.array([[a.label[p], b.label[q]]]))
    return (wa, wb), (ma, mb), np.concatenate(linked)


RESULT = "kind int, key long, n long, other long"


def _compared(cosine: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for da, sa, ba, sb, bb in zip(*(batch.column(k).to_pylist() for k in ("dim", "shard", "blob", "shard2", "blob2"))):
                a, b = Shard(ba), Shard(bb)
                whole, single, linked = compare(a, b, sa == sb, cosine)
                kind, key, n, other = [], [], [], []
                for s, shard, w, m in ((a, sa, whole[0], single[0]), (b, sb, whole[1], single[1])):
                    for k, found, name in ((0, w, s.label), (1, m, (np.int64(shard) << 32) + np.arange(len(s.ids)))):
                        hit = np.flatnonzero(found)
                        kind.append(np.full(len(hit), k)), key.append(name[hit]), n.append(found[hit].astype(np.int64)), other.append(np.zeros(len(hit), np.int64))
                kind.append(np.full(len(linked), 2)), key.append(linked[:, 0]), n.append(np.zeros(len(linked), np.int64)), other.append(linked[:, 1])
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip((kind, key, n, other), kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return run


def _members(batches):
    import pyarrow as pa

    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
            s = Shard(blob)
            columns = [s.ids, s.label[s.ball], s.size[s.ball], (np.int64(shard) << 32) + np.arange(len(s.ids))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["vec_id", "label", "size", "place"])


def link_embeddings(vectors: DataFrame, cosine: float = 0.9, shard_rows: int | None = None, shard_bytes: int = 16_000_000) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors: vec_id (long) and embedding (array of numbers); others are ignored. Vectors with a cosine of `cosine`
    or more link; those that are null, empty, zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. A null vec_id is a row without links. Repeated rows are vectors of their own.
    Exact within what the audits let pass: either shard of a pair is searched with the nodes of the other, and beams widen
    until 96 audited queries and as many planted ones as make 128 hits together miss none (`hits`).
    shard_rows: vectors of a shard, by default as many as shard_bytes holds at 8 bytes a component and as they are long on
    average; every pair of shards meets in one task, which holds both and what a search needs.
    The work of a search grows with the logarithm of a shard's size and the number of pairs with the square of
    the number of shards, so shards are as large as a task bears. The components travel as they came: floats as floats.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    all_ = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    good = F.expr("vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(cast(x as double)) = double('infinity')) and exists(embedding, x -> x <> 0)")
    all_ = all_.withColumn("good", F.coalesce(good, F.lit(False)))
    n, dim = all_.where("good").agg(F.count("*"), F.avg(F.size("embedding"))).first()
    alone = all_.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    shards = -(-n // (shard_rows or max(1024, int(shard_bytes / 8 / dim))))
    dealt = all_.where("good").select("vec_id", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    built = checkpoint(dealt.groupBy("dim", "shard").applyInPandas(_built(cosine), "dim int, shard int, blob binary"))
    a = built.withColumn("shard2", F.explode(F.sequence("shard", F.lit(shards - 1))))
    b = built.select(F.col("dim").alias("dim2"), F.col("shard").alias("shard2"), F.col("blob").alias("blob2"))
    pairs = a.join(b, (a["dim"] == b["dim2"]) & (a["shard2"] == b["shard2"])).select("dim", "shard", "blob", b["shard2"], "blob2")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = checkpoint(pairs.repartition(max(most, min(10 * most, shards * (shards + 1) // 2))).mapInArrow(_compared(cosine), RESULT))
    roots = connected_components(found.where("kind = 2").select(F.col("key").alias("a"), F.col("other").alias("b")))
    whole, single = (found.where(f"kind = {k}").groupBy("key").agg(F.sum("n").alias(f"n{k}")) for k in (0, 1))
    rows = built.mapInArrow(_members, "vec_id long, label long, size long, place long")
    rows = rows.join(whole.withColumnRenamed("key", "label"), "label", "left").join(single.withColumnRenamed("key", "place"), "place", "left")
    rows = rows.join(roots.withColumnRenamed("node", "label"), "label", "left")
    links = F.col("size") - 1 + F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
    root = F.coalesce("root", "label")
    return rows.select("vec_id", links.alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept")).union(alone)
