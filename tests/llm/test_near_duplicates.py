"""MinHash near-dedup and embedding near-dedup against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import embedding, minhash
from gleaner.llm.common import WordHashes, connected_components


def roots(ids, links):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(texts: dict, percent=85):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, roots(sets, links)


def group(rng, size, words, most):
    """Copies of one text, each with up to `most` words changed: a continuum around the threshold."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        t = list(base)
        for _ in range(rng.randrange(most)):
            t[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("small_bucket", [64, 4])
def test_minhash_equals_brute_force(spark, small_bucket):
    rng = random.Random(3)
    texts = group(rng, 150, 150, 9) + group(rng, 60, 12, 3) + group(rng, 30, 600, 20) + [" ".join(f"r{rng.randrange(99)}" for _ in range(rng.randrange(1, 90))) for _ in range(100)]
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, small_bucket=small_bucket, block=32).collect()}
    sizes, want = brute(texts)
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_minhash_odd_rows(spark, odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and not by[2].kept
    assert by[7].component_id == 6 and by[6].n_shingles == 1
    assert by[3].n_shingles == 0 and by[3].kept and by[4].kept and by[5].component_id == 5
    assert by[None].component_id is None and by[None].kept
    assert by[10].n_shingles == 1
    assert minhash.near_duplicates(none).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(2))
    both = np.concatenate([a, b])
    assert (minhash.merge(minhash.registers(a), minhash.registers(b)) == minhash.registers(both)).all()
    for shared in (500, 1500, 2700):
        x, y = a, np.concatenate([a[:shared], b[: 3000 - shared]])
        j = shared / (len(x) + len(y) - shared)
        got = minhash.estimate(minhash.registers(x)[None].astype(int), minhash.registers(y)[None].astype(int), np.array([len(x)]), np.array([len(y)]))[0]
        assert abs(got - j) < 0.15
    assert len(minhash.shingles(b"A b c", WordHashes())) == 1 == len(minhash.shingles(b"a B\tc", WordHashes()))


@pytest.mark.parametrize("small", [0, 400_000])
def test_components(spark, small):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), small=small).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = roots({x for l in real for x in l}, real)
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), small=small).count() == 0


def cosine_brute(vectors, t=0.9):
    ids = list(vectors)
    v = np.array([vectors[i] for i in ids], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hit = v @ v.T >= t
    n = {i: int(h.sum()) - 1 for i, h in zip(ids, hit)}
    return n, roots(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(hit, 1)))])


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for c, spread in zip(centres, np.linspace(0.02, 0.45, 12)):
        rows += list(c + spread * rng.normal(size=(60, 16)))
    rows += list(rng.normal(size=(800, 16))) + [centres[0]] * 40 + [3 * centres[1]] * 5
    rows = {i: [float(np.float32(x)) for x in r] for i, r in enumerate(rows)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding.link_embeddings(df, shard_rows=300).collect()}
    n, want = cosine_brute(rows)
    assert {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, nan]), (7, [inf, 0.0]), (8, [1.0, None]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, 5, True) for r in rows], "vec_id long, embedding array<float>, n_links int, kept boolean")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding.link_embeddings(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (9, 0, 9, True), (None, 0, None, True)] + [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8)], key=str)
    assert embedding.link_embeddings(df.limit(0)).count() == 0


def test_embeddings_of_extreme_sizes(spark):
    rows = [(1, [1e200, 1e200]), (2, [3e200, 3e200]), (3, [1e-200, 1e-200]), (4, [-1e-200, 0.0]), (5, [5e-324, 5e-324]), (6, [1.0, -1e308]), (7, [0.0, -1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 5: (3, 1), 4: (0, 4), 6: (1, 6), 7: (1, 6)}


def test_embedding_recall_at_production_parameters(spark):
    """20 000 vectors in five shards or so, among them partners planted at several cosines: links found against brute force."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(14_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    made = [x]
    for c in (0.89, 0.902, 0.92, 0.95, 0.99, 1.0):
        base = x[rng.integers(0, len(x), 1000)]
        side = rng.normal(size=base.shape)
        side -= (side * base).sum(1, keepdims=True) * base
        made.append(c * base + (1 - c * c) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True))
    x = np.concatenate(made).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    rows = embedding.link_embeddings(df).collect()
    v = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.zeros(len(x), int)
    links = []
    for i in range(0, len(v), 2000):
        a, b = np.nonzero(v[i : i + 2000] @ v.T >= 0.9)
        a, b = (a + i)[a + i != b], b[a + i != b]
        np.add.at(want, a, 1)
        links += list(zip(a.tolist(), b.tolist()))
    got = np.zeros(len(x), int)
    for r in rows:
        got[r.vec_id] = r.n_links
    assert want.sum() > 8000 and (got <= want).all() and got.sum() >= 0.98 * want.sum()
    root = roots(range(len(x)), links)
    assert sum(r.component_id == root[r.vec_id] for r in rows) >= 0.98 * len(rows)


def test_rows_of_one_id_with_different_texts(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join([*base[:-1], "other"])
    docs = spark.createDataFrame([(5, " ".join(base)), (5, "something else entirely in this text here"), (9, near), (5, "something else entirely in this text here"), (7, None), (7, near)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == sorted([(5, 56, 5, True), (5, 3, 5, True), (5, 3, 5, True), (9, 56, 5, False), (7, 0, 7, True), (7, 56, 5, False)])


def test_frequent_keys(spark):
    from pyspark.sql import functions as F

    from gleaner.llm.common import join_frequent

    rows = spark.range(1000).selectExpr("if(id < 600, 1, id) as k", "id", "'x' as hot")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("k <> 700")
    for how, n in (("inner", 999), ("left", 1000)):
        got = join_frequent(rows, keyed, "k", "n", 1000, how, most=10).collect()
        assert len(got) == n and all(r.low == (0 if r.k == 1 else None if r.k == 700 else r.k) and r.hot == "x" for r in got)


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, node = embedding.build(x, 2.0)
    assert (node == np.arange(3000)).all()
    q = x[:200] + 0.05 * rng.normal(size=(200, 24)).astype(np.float32)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]
    ids, sims = graph.search(q, 64)
    best = np.take_along_axis(ids, np.argsort(-sims, axis=1)[:, :10], 1)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(truth.tolist(), best.tolist())])
    assert recall >= 0.9


def _pairs(graph, q, **more):
    return set(zip(*(x.tolist() for x in embedding.hits(graph, q, np.full(len(q), 0.9), **more))))


def _unit(rng, n):
    x = rng.normal(size=(n, 24)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nodes_that_no_list_names_are_found():
    x = _unit(np.random.default_rng(4), 400)
    graph, _ = embedding.build(np.append(x, np.zeros((1, 24), np.float32), 0)[:-1], 2.0)
    lone = next(i for i in range(1, 400) if i != graph.top and i % 4)
    for near in graph.near:
        near[near == lone] = -1
    assert _pairs(graph, x, wanted=1) == {(i, i) for i in range(400)}


def test_few_links_are_not_left_to_chance():
    """Two halves without a link between them; only a query that no evenly spaced audit takes has a partner, in the half out of reach."""
    rng = np.random.default_rng(5)
    x, q = _unit(rng, 400), _unit(rng, 1000)
    graph, _ = embedding.build(x, 2.0)
    side = (np.arange(401) < 200) == (graph.top < 200)
    for near in graph.near:
        near[side[:, None] != side[near]] = -1
    far = int(np.flatnonzero(~side[:400])[5])
    q[1] = x[far]
    assert (1, far) in _pairs(graph, q)


def test_shards_are_searched_both_ways(monkeypatch):
    import pandas as pd

    x = _unit(np.random.default_rng(6), 300)
    a, b = (embedding.Shard(embedding._built(0.9)(pd.DataFrame({"vec_id": np.arange(300) + 1000 * s, "embedding": list(x), "dim": 24, "shard": s})).blob[0]) for s in (0, 1))
    real = embedding.hits
    monkeypatch.setattr(embedding, "hits", lambda graph, q, least: (np.empty(0, int), np.empty(0, int)) if graph is b.graph else real(graph, q, least))
    (_, _), (ma, mb), linked = embedding.compare(a, b, False, 0.9)
    assert ma.sum() == mb.sum() == len(linked) == 300


def test_shards_with_few_links_are_asked_by_their_graphs(monkeypatch):
    """Planted queries audit a graph that no audited query links with: all three links are found, and no scan takes all queries."""
    rng = np.random.default_rng(9)
    x, q = _unit(rng, 1500), _unit(rng, 900)
    graph, _ = embedding.build(x, 2.0)
    q[[100, 500, 899]] = 0.98 * x[[7, 700, 1400]] + 0.02 * q[[100, 500, 899]]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    scanned, real = [], embedding._scan
    monkeypatch.setattr(embedding, "_scan", lambda x, nodes, q, asked, least, **more: scanned.append(len(nodes) * len(asked)) or real(x, nodes, q, asked, least, **more))
    assert _pairs(graph, q) == {(100, 7), (500, 700), (899, 1400)}
    assert sum(scanned) < 0.2 * len(x) * len(q)


def test_audits_leave_out_the_node_itself():
    """Nodes that find themselves alone are no proof: a graph that falls into halves is scanned, and its one link between them found."""
    x = _unit(np.random.default_rng(10), 600)
    graph, _ = embedding.build(x, 2.0)
    side = (np.arange(601) < 300) == (graph.top < 300)
    inside, far = np.flatnonzero(side[:600])[1], np.flatnonzero(~side[:600])[5]
    graph.x[far] = graph.x[inside]
    for near in graph.near:
        near[side[:, None] != side[near]] = -1
    found = _pairs(graph, graph.x, own=True)
    assert (inside, far) in found and (far, inside) in found


def test_links_between_larger_shards(spark):
    """9000 vectors in three shards or so, a tenth with a partner at a cosine of 0.905 or 0.95: every link of single vectors and of copies."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(900, 64))
    side -= (side * x[:900]).sum(1, keepdims=True) * x[:900]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = np.where(np.arange(900) % 2, 0.905, 0.95)[:, None]
    x = np.concatenate([x, c * x[:900] + (1 - c * c) ** 0.5 * side, x[:100]]).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = {r.vec_id: r for r in embedding.link_embeddings(df, shard_rows=3000).collect()}
    v = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = v @ v.T >= 0.9
    want = hit.sum(1) - 1
    assert want.sum() >= 2000 and all(got[i].n_links <= n for i, n in enumerate(want.tolist()))
    assert sum(r.n_links for r in got.values()) >= 0.98 * want.sum()
