"""The SQL of op1 and op6 over tables that show what the test tables don't: links, and values that many share."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from compare import rows_of
from gleaner.llm import pipeline
from gleaner.llm.oracles import ORACLES
from gleaner.llm.queries import op1_embedding_near_dedup, op6_secret_scans

SMALL = "/root/testdata/sf0.001"


def same(spark, query, folder, table):
    db = duckdb.connect()
    db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, df = db.execute(ORACLES[query.__name__]), query(spark, str(folder))
    mine = rows_of(df.columns, df.collect())
    assert mine == rows_of([c[0] for c in got.description], got.fetchall())
    return [dict(zip(mine[0], r)) for r in mine[1]]


def test_secrets_that_owners_share(spark, tmp_path):
    key = "k3y0123456789abcdefGHIJKLMNOPqrstuv"
    held = {"one": ["a/x", "a/y"], "two": ["a/x", "b"], "three": ["a/x", "b/q", None], "repositories": [f"a/{i}" for i in range(6)], "five": [f"a/{i}" for i in range(5)], "none": [None, None], "slash": ["/x", "/y", "/z"]}
    rows = []
    for name, sources in held.items():
        for s in sources:
            value = f"{name}{key}"
            rows.append((len(rows), f"é see {value} and password = {name}Secret99, {'0123456789abcdef' * 2}{len(name):02x}", s))
    rows += [(len(rows), "nothing here", "a/x"), (len(rows) + 1, None, None), (len(rows) + 2, f"token: one{key}", "z")]
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}), tmp_path / "documents.parquet")
    told = same(spark, op6_secret_scans, tmp_path, "documents")
    live = {int(r["doc_id"]): int(r["n_live"]) for r in told}
    # of the three values of a row, all are shared alike
    assert live[0] == 3 and len(set(live.values())) > 2 and any("owned" in r["spans"] for r in told) and any("owned" not in r["spans"] for r in told if int(r["doc_id"]) < 20)


def test_planted_links(spark, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    for i in range(0, 120, 3):
        x[i + 1] = x[i] * 2 + (0.02 * i / 3) * rng.normal(size=64).astype(np.float32)
        x[i + 2] = x[i + 1] + 0.3 * rng.normal(size=64).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(400), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": np.zeros(400, np.int32)}), tmp_path / "embeddings.parquet")
    told = same(spark, op1_embedding_near_dedup, tmp_path, "embeddings")
    assert sum(int(r["n_links"]) for r in told) > 60 and sum(r["kept"] == "False" for r in told) > 30


def test_pipeline_packs_odd_rows_and_leaves_one_folder(spark, odd, tmp_path, monkeypatch):
    odd.select(*pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(pipeline, "shared_folder", lambda _: str(tmp_path / "shared"))
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert packed and {3, 4, 5}.isdisjoint(r.doc_id for r in packed)
    by: dict = {}
    for r in packed:
        by.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert all(n % total == 0 and n for n, total in by.values())
    (run,) = (tmp_path / "shared").iterdir()
    assert [p.name for p in run.iterdir()] == ["4-packing"]


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_spelling_variants", "op6_secret_scans"])
def test_queries_equal_their_sql(spark, name):
    from gleaner.llm import queries

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    got, df = db.execute(ORACLES[name]), queries.queries()[name](spark, SMALL)
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in got.description], got.fetchall())
