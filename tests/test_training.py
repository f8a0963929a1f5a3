"""Generation control, journals and losses against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import generation, journal, losses

STYLES = (generation.Style("a"), generation.Style("b"), generation.Style("c", asks=False))


def verdict_of(key, style):
    """A stand-in for all filters: which style's question about a source is refused."""
    x = (key * 7 + ord(style) * 3) % 5
    return None if x < 3 else "too short" if x == 3 else "copied"


def plain_loop(sources, target, per_act, batch, seed):
    order = sorted(sources, key=lambda s: (hashlib.md5(f"{seed}|{s[0]}".encode()).hexdigest(), s[0]))
    acts, styles, out, refused, pos = {}, {s.name: 0 for s in STYLES}, [], {}, 0
    while len(out) < target and pos < len(order):
        taken = []
        while len(taken) < batch and pos < len(order):
            key, act = order[pos]
            pos += 1
            if acts.get(act, 0) < per_act:
                taken.append((key, act))
        if not taken:
            break
        style = min(STYLES, key=lambda s: styles[s.name]).name
        for key, act in taken:
            if why := verdict_of(key, style):
                refused[style, why] = refused.get((style, why), 0) + 1
                continue
            acts[act] = acts.get(act, 0) + 1
            styles[style] += 1
            out.append((f"syn{len(out):05d}", style, f"{key}{style}", key, act))
            if len(out) >= target:
                break
    return out, refused


def spark_run(spark, folder, **more):
    def write(rows, style):
        return rows.withColumn("question", F.concat(F.col("doc_id").cast("string"), F.lit(style.name)))

    def judge(rows, style):
        x = (F.col("doc_id") * 7 + ord(style.name) * 3) % 5
        return rows.withColumn("reason", F.when(x == 3, "too short").when(x == 4, "copied"))

    return generation.Generation(spark, str(folder), STYLES, write, judge, **more)


@pytest.mark.parametrize("target, per_act, batch", [(40, 12, 16), (1000, 3, 8), (25, 100, 64)])
def test_generation_equals_a_plain_loop(spark, tmp_path, target, per_act, batch):
    rng = random.Random(target)
    sources = [(i, rng.choice(["x", "x", "x", "y", "z", None])) for i in range(150)]
    df = spark.createDataFrame([(k, a, "body") for k, a in sources], "doc_id long, act string, body string")
    run = spark_run(spark, tmp_path / "g", per_act=per_act, batch=batch)
    got = sorted(tuple(r) for r in run.run(df, target).collect())
    want, refused = plain_loop(sources, target, per_act, batch, 13)
    assert got == sorted(want)
    assert {(r.style, r.reason): r.n for r in run.report().where("reason is not null").collect()} == refused


def test_generation_goes_on_where_it_stood(spark, tmp_path):
    sources = [(i, "x" if i % 3 else "y") for i in range(120)]
    df = spark.createDataFrame([(k, a, "body") for k, a in sources], "doc_id long, act string, body string")
    first = spark_run(spark, tmp_path / "g", per_act=100, batch=16)
    whole = first.judge
    calls = []

    def judge(rows, style):
        calls.append(style)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return whole(rows, style)

    first.judge = judge
    with pytest.raises(RuntimeError):
        first.run(df, 60)
    again = sorted(tuple(r) for r in spark_run(spark, tmp_path / "g", per_act=100, batch=16).run(df, 60).collect())
    assert again == sorted(plain_loop(sources, 60, 100, 16, 13)[0])
    assert spark_run(spark, tmp_path / "none", batch=16).run(df.limit(0), 5).count() == 0


def test_question_filter(spark):
    body = "ссуда кредит залог оценка риск норматив капитал отчёт баланс аудит лицензия отзыв"
    rows = [(1, "Каков порядок расчёта резерва банком?"), (2, "резерв?"), (3, "Каков порядок расчёта резерва банком"), (4, "ссуда кредит залог оценка риск норматив?"), (5, "what is the order of this?"), (6, "частое частое частое частое частое?")]
    df = spark.createDataFrame([(k, q, body) for k, q in rows], "doc_id long, question string, body string")
    counts = spark.createDataFrame([("частое", 1000), ("порядок", 3)], "token string, df long")
    got = {r.doc_id: r.reason for r in generation.judged(df, True, counts, 1000, "doc_id").collect()}
    assert got == {1: None, 2: "too short", 3: "no question", 4: "copied", 5: "не по-русски", 6: "too common"}
    assert {r.doc_id: r.reason for r in generation.judged(df, False, counts, 1000, "doc_id").collect()}[3] is None


def entries_of(spark, told):
    """told: journal -> list of (tag, stage, {query: value})."""
    entries = [(j, i, tag, stage) for j, es in told.items() for i, (tag, stage, _) in enumerate(es)]
    values = [(j, i, q, v) for j, es in told.items() for i, (_, _, vs) in enumerate(es) for q, v in vs.items()]
    rows = journal.folded(spark.createDataFrame(entries, "journal string, seq int, tag string, stage string"), spark.createDataFrame(values, "journal string, seq int, key string, value double")).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.journal, r.place)):
        out.setdefault(r.journal, []).append(r)
    return out


def near(level, n, seed):
    rng = np.random.default_rng(seed)
    return {f"q{i:03d}": level + float(rng.normal(0, 0.01)) for i in range(n)}


def test_verdicts():
    assert journal.verdict(0.03, 0.01, 0.05, 0.001, False) == journal.ACCEPTED
    assert journal.verdict(0.01, -0.02, 0.04, 0.42, False) == journal.OPEN
    assert journal.verdict(-0.02, -0.05, 0.01, 0.30, False) == journal.verdict(0.0, -0.03, 0.03, 0.90, False) == journal.REJECTED
    assert journal.verdict(-0.004, -0.02, 0.01, 0.6, True) == journal.ACCEPTED
    assert journal.verdict(-0.05, -0.08, -0.02, 0.001, True) == journal.REJECTED


def test_journals_fold_apart(spark):
    flat = {f"q{i:03d}": 0.4 for i in range(40)}
    got = entries_of(spark, {
        "one": [("base", "base", flat), ("a", "A", near(0.5, 40, 1)), ("b", "B", {q: 0.45 for q in flat}), ("c", "C", near(0.56, 40, 2))],
        "redone": [("base", "base", flat), ("a", "A", {q: 0.45 for q in flat}), ("a", "A", {q: 0.55 for q in flat})],
        "harmless": [("base", "base", flat), ("d", "D", {q: 0.4 + (0.001 if q < "q020" else -0.0015) for q in flat}), ("e", "D", {q: 0.2 for q in flat})],
        "few": [("a", "A", near(0.5, 20, 1)), ("base", "base", flat), ("b", "B", {"q001": 0.9, "q777": 0.1}), ("empty", "C", {})],
    })
    assert [(r.tag, r.compared_with, r.verdict) for r in got["one"]] == [("base", None, None), ("a", "base", "accepted"), ("b", "a", "rejected"), ("c", "a", "accepted")]
    assert abs(got["one"][1].diff - 0.1) < 0.01 and got["one"][1].common == 40
    # an entry made anew is compared with what came before it, not with itself
    assert [(r.tag, r.compared_with, r.verdict, r.mean) for r in got["redone"]] == [("base", None, None, 0.4), ("a", "base", "accepted", 0.55)]
    assert [(r.tag, r.verdict) for r in got["harmless"]] == [("base", None), ("d", "accepted"), ("e", "rejected")]
    assert [(r.tag, r.compared_with, r.common, r.verdict) for r in got["few"]] == [("a", None, None, None), ("base", None, None, None), ("b", "base", 1, "not established"), ("empty", "base", 0, "not established")]


def test_draws_are_even():
    x = journal.mixed(7, np.arange(2000)[:, None], np.arange(50)[None, :])
    assert abs((x & np.uint64(1)).mean() - 0.5) < 0.01 and abs(((x * np.uint64(10)) >> np.uint64(32)).mean() - 4.5) < 0.05
    assert len(np.unique(x)) > 99_000


def test_contrastive_loss(spark):
    rng = np.random.default_rng(3)
    a, p, n = (rng.normal(size=(70, 8)) for _ in range(3))
    df = spark.createDataFrame([(i, a[i].tolist(), p[i].tolist(), n[i].tolist() if i % 2 else None) for i in range(70)] + [(99, None, p[0].tolist(), None)], "id long, anchor array<double>, positive array<double>, negative array<double>")
    order = sorted(range(70), key=lambda i: (hashlib.md5(f"13|{i}".encode()).hexdigest(), i))

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def loss(ids, negatives):
        total = 0
        for d in (8, 4):
            others = np.concatenate([unit(p[ids, :d])] + ([unit(n[[i for i in ids if i % 2], :d])] if negatives else []))
            s = 20 * unit(a[ids, :d]) @ others.T
            total += np.mean([math.log(sum(math.exp(x) for x in r)) - r[i] for i, r in enumerate(s)])
        return total

    for negatives in (False, True):
        got = {r.batch: (r.n, r.loss) for r in losses.contrastive(df if negatives else df.drop("negative"), "id", size=32, dims=(8, 4)).collect()}
        for b in range(3):
            ids = order[32 * b : 32 * b + 32]
            assert got[b][0] == len(ids) and got[b][1] == pytest.approx(loss(ids, negatives), abs=1e-9)
    assert losses.contrastive(df.limit(0), "id").count() == 0


def test_blocks_of_a_batch_add_up():
    rng = np.random.default_rng(4)
    a, p = (losses.cut_to(rng.normal(size=(50, 6)), 0) for _ in range(2))
    assert np.allclose(losses.in_batch(a, p, 20.0, block=7), losses.in_batch(a, p, 20.0, block=500), atol=1e-12)


def test_listwise_loss(spark):
    rng = np.random.default_rng(5)
    q, d, t = rng.normal(size=6), rng.normal(size=(5, 6)), rng.normal(size=5) * 3
    df = spark.createDataFrame([(1, q.tolist(), d[i].tolist(), float(t[i])) for i in range(5)], "query_id long, anchor array<double>, doc array<double>, label double")

    def shares(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    want = 0
    for k in (6, 3):
        s = np.array([q[:k] @ x[:k] / np.linalg.norm(q[:k]) / np.linalg.norm(x[:k]) for x in d])
        teacher, student = shares(t / 2.0), shares(20 * s / 0.5)
        want += (teacher * np.log(teacher / student)).sum()
    got = losses.listwise(df, "query_id", dims=(0, 3), temperature=0.5, teacher_temperature=2.0).first()
    assert got.n == 5 and got.loss == pytest.approx(want, abs=1e-9)
    with pytest.raises(Exception, match="no gradient"):
        losses.listwise(df.limit(1), "query_id").collect()
