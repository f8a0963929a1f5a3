"""The pipeline's stages against brute force on the smallest tables."""

from collections import Counter, defaultdict

import pytest
from test_near_duplicates import brute

import corpus_pipeline
from gleaner.llm import mixing

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stage(spark, docs, SMALL).cache()
    return {k: v.collect() for k, v in out.items()} | {"columns": {k: v.columns for k, v in out.items()}}


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5
    assert all(stages["columns"][n] == list(corpus_pipeline.COLUMNS) for n in names[:-1])


def test_language_stage_keeps_every_text_with_a_letter(stages):
    want = {r.doc_id for r in stages["input"] if r.text and any(map(str.isalpha, r.text))}
    assert {r.doc_id for r in stages["language_id"]} == want


def test_one_document_of_each_group_stays(stages):
    _, root = brute({r.doc_id: r.text for r in stages["language_id"]}, percent=80)
    assert sorted(r.doc_id for r in stages["near_dedup"]) == sorted(i for i, x in root.items() if i == x)


def test_secrets_go_and_documents_stay(stages):
    before, after = ({r.doc_id: r.text for r in stages[n]} for n in ("near_dedup", "secret_scan"))
    assert set(before) == set(after)
    changed = [i for i in before if before[i] != after[i]]
    assert all(corpus_pipeline.REDACTED in after[i] for i in changed) and not any("AKIA" in t for t in after.values())
    assert all(r.n_chars == len(r.text) for r in stages["secret_scan"])


def test_mix_takes_what_it_should(stages):
    size, have = defaultdict(int), {r.doc_id: r for r in stages["secret_scan"]}
    for r in have.values():
        size[r.source] += len(r.text.split())
    names = sorted(size)
    goals = dict(zip(names, mixing.targets([size[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken, copies = defaultdict(int), Counter(r.doc_id for r in stages["source_mix"])
    for r in stages["source_mix"]:
        assert r.text == have[r.doc_id].text
        taken[r.source] += len(r.text.split())
    longest = max(len(r.text.split()) for r in have.values())
    assert max(copies.values()) <= 3 and all(abs(taken[n] - goals[n]) <= longest for n in names)


def test_packing_holds_every_copy(stages):
    copies = Counter(r.doc_id for r in stages["source_mix"])
    tokens, total = defaultdict(int), {}
    for r in stages["packing"]:
        tokens[r.doc_id] += r.length
        total[r.doc_id] = r.doc_tokens
    assert {k: copies[k] * total[k] for k in copies} == tokens


def test_odd_rows(spark, odd, none):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert {3, 4, 5}.isdisjoint(r.doc_id for r in docs.collect())
    empty = none.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0
