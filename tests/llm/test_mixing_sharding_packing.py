"""Mixing, sharding and packing: exact sums, round trips, and the plain rules."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleaner.llm import mixing, packing, sharding
from gleaner.llm.queries import SHARDS, op7_source_mixing, op8_sharding, vocabulary

DATA = "/root/testdata/sf0.01"


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.targets([0, 10], [5, 2]) == pytest.approx([0, 10])
    assert mixing.targets([], []) == []


def test_splitting_tree():
    t = mixing.splitting_tree([100, 7, 0, 33], 16, 3)
    assert t.sum(0).tolist() == [100, 7, 0, 33] and (t >= 0).all() and t.sum(1).max() - t.sum(1).min() <= 1
    assert (t == mixing.splitting_tree([100, 7, 0, 33], 16, 3)).all()
    assert mixing.splitting_tree([3], 1, 0).tolist() == [[3]]


def test_mix(spark):
    rows = op7_source_mixing(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.taken <= 3 * r["size"]
        by[r.source].append(r)
    names = sorted(by)
    sizes = [sum(r["size"] for r in by[n]) for n in names]
    goals = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for n, size, goal in zip(names, sizes, goals):
        assert {r.source_size for r in by[n]} == {size} and by[n][0].target == pytest.approx(goal)
        assert abs(sum(r.taken for r in by[n]) - goal) <= max(r["size"] for r in by[n]) / 2 + 1
    again = {r.doc_id: (r.taken, r.shards) for r in op7_source_mixing(spark, DATA).repartition(3).collect()}
    assert again == {r.doc_id: (r.taken, r.shards) for r in rows}
    assert all(len([x for x in r.shards.split(",") if x]) * r["size"] == r.taken for r in rows)


def test_mixed_documents(spark, odd, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = Counter(r.doc_id for r in mixing.mixed_documents(docs).select("doc_id").collect())
    assert got == Counter({k: v for k, v in copies.items() if v})
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.taken <= 3 * r["size"] for r in rows)
    assert {r.doc_id: r["size"] for r in rows}[4] == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mix_takes_equal_rows_in_part(spark):
    """1000 equal rows make one block of one place; the other source weighs less, so more of them are wanted than there are."""
    rows = [(1, "one two three", "a")] * 1000 + [(k, "four five six", "b") for k in range(10, 1010)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()
    assert all(r.n == 1000 and abs(r.taken - r.target) <= 2 for r in got)


def test_mix_with_names_that_clash(spark):
    clash = "k s n part whole stop to goal goal_size takes ties own salt number copy shard order size place source_size target copies taken shards _block _copy".split()
    docs = spark.createDataFrame([(1, "one two three", "a"), (1, "one two three", "a"), (2, "four", None), (None, None, "b")], "doc_id long, text string, source string")
    docs = docs.select("*", *(F.lit("mine").alias(c) for c in clash))
    rows = mixing.mixed_documents(docs).collect()
    assert rows and all(r[c] == "mine" for r in rows for c in clash) and list(rows[0].asDict()) == docs.columns
    assert mixing.mix(docs).count() == 4
    with pytest.raises(ValueError):
        mixing.mix(docs, most_sources=2)


def test_block_numbers():
    assert mixing.block_numbers({}) == {} and mixing.block_numbers({"a": 5, None: 30_000}) == {"a": 256, None: 256}
    assert mixing.block_numbers({"a": 40_000_000, "b": 1}) == {"a": 2000, "b": 256}
    assert sum(mixing.block_numbers({k: 10**9 for k in range(1000)}).values()) < 400_000


def test_lookup_table():
    table = sharding.lookup_table([f"s{i}" for i in range(7)], 211)
    counts = Counter(table)
    assert set(table) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table([f"s{i}" for i in range(6)], 211)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 211 * 0.25
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 211)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 210)


def brute_table(shards, slots):
    """Each shard's whole permutation, claimed turn by turn."""
    orders = []
    for s in shards:
        offset, skip = sharding.preference(s, slots)
        orders.append(iter([(offset + j * skip) % slots for j in range(slots)]))
    owner = {}
    while len(owner) < slots:
        for k, order in enumerate(orders):
            slot = next((x for x in order if x not in owner), None)
            if slot is not None:
                owner[slot] = k
    return [owner[i] for i in range(slots)]


def test_placement(spark, odd, none):
    import hashlib

    table = brute_table(SHARDS, sharding.SLOTS)
    rows = op8_sharding(spark, DATA).collect()
    assert len(rows) == 1000
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, SHARDS[table[slot]])
    placed = sharding.place(odd.withColumn("slot", F.lit("x")), "doc_id", SHARDS).collect()
    assert len(placed) == odd.count() and all(r.shard in SHARDS for r in placed)
    assert sharding.place(none, "doc_id", SHARDS).count() == 0


def check_packing(rows, texts):
    """texts: list of (doc_id, text). Every id once, offsets gapless, sequences of at most 1024."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for doc, text in texts:
        want[doc].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc, all_ in want.items():
        if len(all_) == 1:
            at = 0
            for start, length, crc, total in sorted(pieces[doc]):
                assert start == at and total == len(all_[0]) and crc == zlib.crc32(all_[0][start : start + length].tobytes())
                at += length
            assert at == len(all_[0])
        else:
            assert sum(p[1] for p in pieces[doc]) == sum(map(len, all_))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    return sum(r.length for r in rows) / 1024 / len(sequences)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(6)
    density = check_packing(packing.pack(docs, *vocabulary()).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert density > 0.97


def test_packing_odd_rows(spark, odd, none):
    special = spark.createDataFrame([(90, "a <|endoftext|> b", ), (91, "  tabs\t\t  <|endoftext|>")], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(special)
    check_packing(packing.pack(docs, *vocabulary()).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack(none, *vocabulary()).count() == 0


def test_packing_long_runs(spark):
    """Texts on which the rank file's pattern matcher gives up, or might."""
    docs = [(1, " " * 1_000_000), (2, "x" + " " * 300_000 + "y"), (3, "\n" * 200_000), (4, "a" * 100_000), (5, "\u3000" * 50_000), (6, "<|endoftext|>" * 1000 + "\t" * 400_000)]
    check_packing(packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), *vocabulary()).collect(), docs)


def test_fullest_window_goes_first():
    w = packing.Windows(100, 2, 30)
    assert not [*w.add(np.arange(60, dtype="<u4"), 1), *w.add(np.arange(80, dtype="<u4"), 2)]
    closed = list(w.add(np.arange(50, dtype="<u4"), 3))  # fits neither; the fullest has room for 20, too few for a cut
    assert [[(p[0], p[2]) for p in pieces] for _, pieces in closed] == [[(2, 80)]]
    assert sorted(room for room, _ in w.rooms) == [40, 50]
    closed = list(w.add(np.arange(70, dtype="<u4"), 4))  # now 40 of it fill the fullest up
    assert [[(p[0], p[1], p[2], p[5]) for p in pieces] for _, pieces in closed] == [[(1, 0, 60, 0), (4, 0, 40, 60)]]


def test_windows_stay_bounded():
    rng, w = np.random.default_rng(1), packing.Windows(100, 4, 8)
    closed = []
    for i in range(500):
        closed += list(w.add(np.arange(rng.integers(1, 180), dtype="<u4"), i))
        assert len(w.rooms) <= 4
    fills = [sum(p[2] for p in pieces) for _, pieces in closed]
    assert max(fills) <= 100 and np.mean(fills) > 96
