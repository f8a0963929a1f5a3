"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows_of
from gleaner.plans import registry

SMALL = "/root/testdata/sf0.001"
# one or two of every family; compare.py runs all of them
NAMES = """e1_split_tokens_literals e6_e7_copy_run a3_qrels_scan c6_split_issue g3_bm25_top10 g8_dense_top10 g15_rrf_text g21_parents d4_parse_units d6_windows h1_round_robin_pool
f1_f2_parse_answers f5_kappa_weighted i1_apply_judge i8_remap j1_split_acts j9_pick_negatives l1_l5_metrics_vectors l8_paired_diff l18_failure_causes
a1_jsonl_scan a2_jsonl_gz_scan a18_external_qrels b9_append_new c10_build_corpus_acts d9_headed_windows d9_headed_structure g19_filtered_search j7_negative_columns_weaker j15_train_report""".split()


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return db


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = registry.queries()[name](spark, SMALL)
    got = db.execute(registry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in got.description], got.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0
