"""What larger tables showed: rare values, and steps whose work must not grow faster than the input."""

import math

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.functions import plain
from gleaner.functions.stemmer import tokenize
from gleaner.functions.text import truncate_tokens
from gleaner.operators import bm25, chunking, inverted
from gleaner.plans import registry


def test_truncated_vectors_have_no_signed_zero(spark, tmp_path):
    """Small negative components round to zero; the SQL must not keep their sign."""
    rows = [(1, [-1e-7] + [0.5] * 40, 3), (2, [-0.0] * 64, 3), (3, [1e-8, -1e-8] * 16, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.v for r in registry.queries()["g7_truncate_vectors"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = dict(db.execute(registry.oracle_sql()["g7_truncate_vectors"]).fetchall())
    assert {k: list(map(repr, v)) for k, v in got.items()} == {k: list(map(repr, v)) for k, v in wanted.items()}
    assert not any(x == 0 and math.copysign(1, x) < 0 for v in wanted.values() for x in v)


ODD = [
    "", " ", "\n", "\nabc", " \nabc", "\t\n1. b", "\xa0", "\x0b", "\x1c\nb", "\r\n", "a\r\n1. b\r\n2. \r\nc", "a\n 1. b\nc", "a\n12. \nb", "a\n12.\nb", "a\n1.\xa0b", "a\n1.\x0bb", "a\n٣. b", "a\n1.2.3 b\n1..2. c",
    "… 12", "a\nb … 12 \nc", "a\n…12\r\nb", "... a", "a\n. .\t.\nb", "a\nГлава 3. Б.\nc", "a\nГлава 3 Б\nc", "a\nГлава  3. Б..\nc", "a\nГлава 3. Б.\r\nc", "a\nГлава 3. Б\u2028в\nc", "a\nГлава ٣. Б\nc",
    "a\nПриложение\nc", "a\nПриложение А\nc", "a\nПриложение 2\nc", "a\nПриложение 2. Б.\nc", "a\nПриложение 2 Б\x85в\nc", "a\nПриложение 2 . . . 3\nc", "a\nПриложения 2\nc", "\U0001f926\n1. \U0001f926", "a\n1" + ".1" * 20_000 + ". b", None,
]


def test_units_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    """Texts whose first line is blank, indented numbers, other ends of lines, bare headings, numbers of many parts; ids below zero."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(-5, "a\n1. b"), (10**12, "a\n1. b"), (None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0 n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["d4_parse_units_documents"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = db.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()['d4_parse_units_documents']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and len({r[0] for r in wanted}) == len(rows) - 2


def test_only_line_feeds_end_a_heading(spark):
    """A heading may hold other ends of lines; as blanks at its end they go from a chapter's name alone, and its dots go after them."""
    text = "Глава 1. А\u2028б..\r\n1. x\nПриложение 2 В\x85г\r\ny\nГлава 3\n1" + ".1" * 20_000 + ". z"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [(r.number[:3], len(r.number), r.section, r.text[-1]) for r in chunking.parse_units(docs).orderBy("start").collect()]
    assert got == [("1", 1, "Глава 1. А\u2028б", "x"), ("", 0, "Приложение 2. В\x85г\r", "y"), ("1.1", 40_001, "Глава 3", "z")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["d8_chunks_by_structure", "d9_headed_structure", "d9_headed_acts"])
def test_documents_are_walked_without_a_group_each(spark, name):
    """Where each document was a group of its own in pandas, most of the time went into making frames."""
    plan = plan_of(registry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_units_are_walked_in_order(spark):
    """Units of several documents in any order; some documents' last clauses open the next chunk, long ones are cut."""
    rows = [(d, u, f"{u}.1", "s" if u < 7 else "t", 100 * u, 100 * u + 60, "x" * (60 if u % 4 else 700)) for d in range(40) for u in range(1, 11)]
    random.Random(2).shuffle(rows)
    units = spark.createDataFrame(rows, "doc_id long, unit long, number string, section string, start int, end int, text string")
    got = chunking.pack_units(units.repartition(7), size=100).orderBy("doc_id", "position").collect()
    one = [tuple(r)[1:] for r in got if r.doc_id == 0]
    assert len(got) == 40 * len(one) and all(tuple(r)[1:] == one[r.position] for r in got)
    assert [r[0] for r in one] == list(range(len(one))) and [r[2] for r in one][:3] == ["1.1–3.1", "4.1", "4.1"]


def test_words_counted_first_give_the_same_tokens():
    rng = random.Random(5)
    parts = ["a-1", "12/3-ab", "12-abcd", "ab-1-2/3", "x_y", "word,word", "don't", "3.14", "é", "1-a-b", "ab-12-", "закон", "590-п", "\u2003", "\x1c", "\n", "--", "tail-9/9-9"]
    for _ in range(400):
        text = rng.choice([" ", "", "\u00a0", "\t"]).join(rng.choice(parts) for _ in range(rng.randrange(12)))
        for tokens in plain.PLAIN.values():
            assert plain.counted(text, tokens, plain.Words(tokens)) == dict(Counter(tokens(text))), text


@pytest.mark.parametrize("tokenizer", [tokenize, truncate_tokens])
def test_scores_are_added_up_where_a_document_lies(spark, tokenizer, monkeypatch):
    """Scores and best lists equal those by joins with the postings, and no pair of query and document is shuffled."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 90}-x tail" for _ in range(rng.randrange(30)))) for i in range(1500)] + [(9000 + i, "w1-x w2-x w2-x") for i in range(600)] + [(99_999, None)], "doc_id long, text string")
    q = spark.createDataFrame([("a", "w1 w2 w2 w88"), ("b", "tail"), ("c", "unknown"), ("d", None), ("e", "x w7")], "query_id string, text string")
    index = bm25.build(docs, tokenizer)
    all_, few = bm25.scores(index, q, "query_id", tokenizer), bm25.best(index, q, "query_id", tokenizer, 7)
    assert "Aggregate [query_id" not in plan_of(all_) and "MapInArrow" in plan_of(few)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", *(["rank"] if "rank" in df.columns else [])).collect()))
    mine = rows(all_), rows(few)
    monkeypatch.setattr(bm25, "MOST_TERMS", 0)
    joined = bm25.scores(index, q, "query_id", tokenizer)
    assert (rows(joined), rows(bm25.top(joined, "query_id", 7))) == mine and len(mine[1]) == 7 * 3
    assert rows(bm25.best(index, q, "query_id", tokenizer, 7)) == mine[1]
    monkeypatch.undo()
    named = bm25.build(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), tokenizer)  # ids that aren't numbers
    assert bm25.best(named, q, "query_id", tokenizer, 7).count() == 7 * 3


@pytest.mark.parametrize("ids", ["long", "string"])
def test_a_stored_search_shuffles_no_postings(spark, tmp_path, monkeypatch, ids):
    """A range's scores are added up in its row; many queries go in groups. Either way the rows are those of scoring everything."""
    rng = random.Random(4)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 70}" for _ in range(rng.randrange(25))) for _ in range(900)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1000, None)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(ids)).repartition(3)
    q = spark.createDataFrame([(i, f"w{i} w{i + 1} w{3 * i} w1 w1") for i in range(12)] + [(90, "none"), (91, None)], "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    want = rows(bm25.top(bm25.scores(bm25.build(docs), q, "query_id"), "query_id", 6))
    stored = inverted.Stored(spark, str(tmp_path / "i"), docs, range_docs=16)
    found = stored.search(q, "query_id", 6)
    assert "Aggregate" not in plan_of(found) and "Generate" not in plan_of(found) and "Generate" not in plan_of(stored.blocks)
    assert rows(found) == want and len(want) == 6 * 12
    assert stored.blocks.agg(F.sum(F.size("ids"))).first()[0] == 901 == stored.index.size.first()["n"]
    monkeypatch.setattr(inverted, "MOST_TERMS", 20)
    assert rows(stored.search(q, "query_id", 6)) == want
    empty = q.where("query_id > 89")
    assert stored.search(empty, "query_id", 6).count() == 0 == stored._searched(empty, "query_id", 6, 4)[1].count()


def test_plain_texts_are_split_without_the_pattern(monkeypatch):
    """Only texts with Cyrillic letters or with a hyphen between letter and digit need the pattern of tokens; the others are split by bytes, to the same tokens."""
    rng = random.Random(8)
    letters = "ab1- 9/.é٣я  ﹣-–ß\x1c_"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        wanted = [t.replace("ё", "е") for t in plain._TOKEN.findall(text)]
        assert plain.split_tokens(text) == [t for t in wanted if not plain._CYRILLIC.search(text) or t not in plain._STOPWORDS], repr(text)
        for tokens in plain.PLAIN.values():
            assert plain.counted(text, tokens, plain.Words(tokens)) == dict(Counter(tokens(text))), repr(text)
    monkeypatch.setattr(plain, "_TOKEN", None)
    assert plain.split_tokens("it's a well-known café, 2024-01-02 \ud800x") == ["it", "s", "a", "well", "known", "caf", "2024", "01", "02", "x"]
