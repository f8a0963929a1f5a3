"""Queries over whole tables that SQL can't follow, and operators with hot groups, against plain Python."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions.stemmer import stem
from gleaner.operators import copying, judging, metrics, qrels, stats
from gleaner.plans import base, registry, retrieval_queries, table_queries

SMALL = "/root/testdata/sf0.001"


def plain_units(text):
    """(number, section, start, text) line by line."""
    units, open_, section, start = [], None, "", 0
    for line in text.split("\n"):
        toc = re.search(r"\.\s*\.\s*\.|\.{4,}", line)
        chapter = not toc and re.match(r"Глава\s+(\d+)\.?\s*(.*)$", line)
        annex = not toc and re.match(r"(Приложение(?:\s+\d+)?)\b\s*(.*)$", line)
        unit = not toc and not chapter and not annex and re.match(r"(\d+(?:\.\d+)*)\.\s+(?=\S)", line)
        if chapter or annex:
            section = re.sub(r"\.+$", "", f"Глава {chapter[1]}. {chapter[2]}".strip()) if chapter else annex[1] + (f". {annex[2]}" if annex[2] else "")
            open_ = None
        elif unit or (open_ is None and not toc):
            open_ = [unit[1] if unit else "", section, start, line]
            units.append(open_)
        elif open_ is not None:
            open_[3] += "\n" + line
        start += len(line) + 1
    return [u for u in units if re.search(r"\S", u[3])]


def plain_chunks(units, budget, keep, cap, head):
    """(section, label, start, end, text) of clauses gathered in order; head(section) stands in front, cap(section) is what it leaves."""
    out, buf = [], []

    def size(t):
        return max(1, int(len(t) / 3.2))

    def emit(section, label, start, text):
        if -(-len(text) // 3) > cap(section):
            text = text[: max(0, cap(section) - 3) * 3]
        if full := (head(section) + text).strip():
            out.append((section, label, start, start + len(text), full))

    def flush():
        nonlocal buf
        if buf:
            named = [u[0] for u in buf if u[0]]
            text = "\n".join(u[3] for u in buf)
            if -(-len(text) // 3) > cap(buf[0][1]):
                emit(buf[0][1], f"{named[0]}–{named[-1]}" if len(named) > 1 else "".join(named), buf[0][2], text)
            elif full := (head(buf[0][1]) + text).strip():
                out.append((buf[0][1], f"{named[0]}–{named[-1]}" if len(named) > 1 else "".join(named), buf[0][2], buf[-1][2] + len(buf[-1][3]), full))
            tail, total = [], 0
            for u in reversed(buf):
                if total + size(u[3]) > keep:
                    break
                tail.insert(0, u)
                total += size(u[3])
            buf = tail if len(tail) < len(buf) else []

    for u in units:
        if size(u[3]) > budget:
            flush()
            pieces = -(-len(u[3]) // 3)
            for i in range(0, pieces, max(1, budget - keep)):
                emit(u[1], u[0], u[2] + 3 * i, u[3][3 * i : 3 * (i + budget)])
                if i + budget >= pieces:
                    break
            continue
        if buf and (sum(size(x[3]) for x in buf) + size(u[3]) > budget or buf[0][1] != u[1]):
            flush()
        buf.append(u)
    flush()
    return out


@pytest.mark.parametrize("name", ["d8_chunks_by_structure", "d9_headed_acts"])
def test_structure_of_all_texts_equals_a_plain_walk(spark, name):
    rows = registry.queries()[name](spark, SMALL).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.position)):
        digest = r.digest if "digest" in r else hashlib.md5(r.text.encode()).hexdigest()
        got.setdefault(r.doc_id, []).append((r.section, r.units, r.char_start, r.char_end, digest))
    docs = (retrieval_queries.structured if name.startswith("d9") else base.documents)(spark, SMALL).collect()
    want = {}
    for d in docs:
        stem_ = f"Положение Банка России № {d.source} от 01.01.2020. о правилах"

        def head(section):
            return (f"{stem_}. {section}" if section else stem_) + "\n\n" if name.startswith("d9") else ""

        def room(h):
            return 512 - max(1, int(len(h) / 3.2)) if h else 512

        chunks = plain_chunks(plain_units(d.text or ""), max(32, room(head(""))), int(512 * 0.15), lambda s: max(1, room(head(s))), head)
        if chunks:
            want[d.doc_id] = [(s, n, a, b, hashlib.md5(t.encode()).hexdigest()) for s, n, a, b, t in chunks]
    assert got == want and len(want) > 150


def test_stems_of_the_vocabulary(spark):
    rows = registry.queries()["e2_stem_vocabulary"](spark, SMALL).collect()
    assert len(rows) > 5000 and all(r.stem == stem(r.word) for r in rows)


def test_acts_of_documents(spark):
    rows = {r.doc_id: r for r in table_queries.acts(spark, SMALL).where("doc_id in (4, 31)").collect()}
    assert (rows[4].number, rows[4].kind, rows[4].date) == ("104-П", "Положение", "05.05.1999") and rows[31].number == "131-Т"


def test_metrics_from_counts_equal_those_from_labels(spark):
    rng = random.Random(1)
    labels = [(q, d, rng.choice([0, 1, 2])) for q in range(12) for d in range(60) if rng.random() < 0.3 * (q % 4)] + [(20, 1, 0)]
    run = [(q, d, i + 1) for q in [*range(13), 20] for i, d in enumerate(rng.sample(range(80), 15))]
    labels_df, run_df = spark.createDataFrame(labels, "query_id long, doc_id long, grade int"), spark.createDataFrame(run, "query_id long, doc_id long, rank int")
    totals = labels_df.groupBy("query_id", "grade").agg(F.count("*").alias("n"))
    got = metrics.per_query_counted(run_df.join(labels_df, ["query_id", "doc_id"], "left"), totals)
    want = metrics.per_query(run_df, labels_df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(got.columns).collect()), key=str)


def test_order_statistic_of_many_values(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(5000)] + [("b", float(rng.randrange(5))) for _ in range(3000)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: (r.n, r.p) for r in stats.order_statistic(df, "k", "x", q).collect()}
        for k in "abc":
            v = sorted(x for g, x in rows if g == k)
            assert got[k] == (len(v), v[round(q * (len(v) - 1))])


def test_stratified_sample(spark):
    rows = [(i, "x" if i % 10 else "y" if i % 20 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, s string")

    def order(i):
        return hashlib.md5(f"13|{i}".encode()).hexdigest()

    for size in (3, 40, 90, 1000):
        share = max(1, size // 2)
        head, rest = [], []
        for s in ("x", "y", None):
            mine = sorted((i for i, t in rows if t == s), key=order)
            head += mine[:share]
            rest += mine[share:]
        want = sorted(head, key=order)[:size]
        want += sorted(set(range(400)) - set(want), key=order)[: size - len(want)]
        assert sorted(r.id for r in judging.stratified(df, "s", "id", size).collect()) == sorted(want)


def test_review_neighbours(spark):
    chunks = spark.createDataFrame([(f"A#{i}", "A", i, "s" if i in (0, 7) else "", i * 100, i * 100 + 100 + 50 * (i == 1)) for i in range(9)] + [("B#0", "B", 0, "s", 0, 10)], "chunk_id string, doc_id string, position int, section string, char_start int, char_end int")
    gold = spark.createDataFrame([("q", "A#0"), ("p", "A#5"), ("p", "B#0"), ("z", "none")], "query_id string, doc_id string")
    got = sorted((r.query_id, r.gold, r.doc_id, r.distance, r.place) for r in qrels.review_neighbours(gold, chunks).collect())
    assert got == sorted([("q", "A#0", "A#1", 1, 1), ("q", "A#0", "A#2", 2, 2), ("q", "A#0", "A#7", 107, 3)] + [("p", "A#5", d, k, p) for d, k, p in (("A#4", 1, 1), ("A#6", 1, 2), ("A#3", 2, 3), ("A#7", 2, 4))])
    wide = spark.createDataFrame([("C#0", "C", 0, "", 0, 100), ("C#1", "C", 1, "", 60, 160)], "chunk_id string, doc_id string, position int, section string, char_start int, char_end int")
    assert qrels.review_neighbours(spark.createDataFrame([("q", "C#0")], "query_id string, doc_id string"), wide).count() == 0


def test_shared_runs_of_tokens(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "TWO three four two three four"), (3, None), (4, "two three")], "doc_id long, text string")
    wanted = spark.createDataFrame([("two three four",), ("three four five",), ("not there at",)], "gram string")
    for most in (copying.MOST_RUNS, 0):
        assert sorted(tuple(r) for r in copying.shared_grams(docs, wanted, 3, most).collect()) == [(1, "three four five"), (1, "two three four"), (2, "two three four")]


def test_no_query_leaves_data_in_the_session(spark):
    for name in ("g1_bm25_terms", "g3_bm25_top10", "h1_round_robin_pool"):
        assert registry.queries()[name](spark, SMALL).count()
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    base.forget_indexes(spark)
    assert math.isfinite(registry.queries()["g3_bm25_top10"](spark, SMALL).first().score)
