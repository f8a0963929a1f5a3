"""SentencePiece rounds against the library, Merkle manifests and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import merkle, pieces, variants
from gleaner.llm.queries import op11_sentencepiece, op12_merkle_manifest, op13_spelling_variants, piece_model

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_model())


def odd_texts():
    rng = random.Random(1)
    out = ["", " ", "  ", "x", "x ", "  x  ", "▁▁ x▁", "<s></s><unk><0x41>", "🎉🎉👨‍👩‍👧 é", "\x00\x01", "漢字かな交じり文" * 9, "0123456789" * 9, "if (x) {\n        return;\n    }\n" * 4, "‘a’,”», ", "a" * 3000, "aab" * 999]
    out += [" " * n + "the" + " " * (n // 2) for n in (1, 2, 13, 14, 15, 16, 17, 29, 30, 31, 32, 33, 47, 48, 49, 63, 64, 65, 66, 79, 80, 999)]
    for alphabet, n in (("ab cdeéthing▁ \n.,(漢🎉0 ", 600), ("etaoin shrdlu   ", 400), ("abcdefghijklmnopqrstuvwxyz", 60)):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x110000), 32])) for _ in range(40)) for _ in range(200)]
    return out


def test_pieces_equal_the_library(library):
    texts, model = odd_texts(), pieces.Pieces(piece_model())
    got = model.encode_all([t.encode() for t in texts])
    want = library.encode(texts, num_threads=1)
    assert [g.tolist() for g in got] == want
    assert [model.decode(g) for g in got] == library.decode(want)


def test_any_ids_are_decoded_as_by_the_library(library):
    rng, model = random.Random(2), pieces.Pieces(piece_model())
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(260), rng.randrange(32_000), rng.randrange(3, 259), 28_705, 259]) for _ in range(rng.randrange(12))]
        assert model.decode(np.array(ids, int)) == library.decode(ids)
    with pytest.raises(ValueError):
        model.decode(np.array([32_000]))


def test_a_full_table_of_words_changes_nothing(library):
    texts = [f"number {i} of many words{i * 7919}" for i in range(300)]
    model = pieces.Pieces(piece_model(), most_words=50)
    assert [g.tolist() for t in texts for g in model.encode_all([t.encode()])] == library.encode(texts)


def test_long_texts_are_cut_between_words(library, monkeypatch):
    text = "".join(f"word{i}{' ' * (i % 5 + 1)}" for i in range(3000))
    model = pieces.Pieces(piece_model())
    slices = model._slices
    monkeypatch.setattr(model, "_slices", lambda texts: slices(texts, size=500))
    assert model.encode_all([text.encode(), None, b"a"])[0].tolist() == library.encode(text)


def test_pieces_query(spark, library):
    rows = {r.doc_id: r for r in op11_sentencepiece(spark, SMALL).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    for i, text in docs.items():
        ids = library.encode(text)
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_odd_rows(spark, odd, none, library):
    rows = pieces.encode(odd, piece_model())
    got = sorted((str(r.doc_id), r.ids) for r in rows.collect())
    assert got == sorted((str(r.doc_id), library.encode(r.text or "")) for r in odd.collect())
    back = pieces.decode(rows.withColumn("text_", F.lit("kept")), piece_model()).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in odd.collect()) and all(r.text_ == "kept" for r in back)
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>"), piece_model()).orderBy("k").collect()[:] == [(1, None), (2, "")]
    assert pieces.encode(none, piece_model()).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(nodes, arity=2):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def steps_of(levels, i, arity=2):
    out = []
    for nodes in levels[:-1]:
        lo = i - i % arity
        run = nodes[lo : lo + arity]
        out.append(("".join(run[: i - lo]), "".join(run[i - lo + 1 :])))
        i //= arity
    return out


def leaf_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_manifest(rows, arity=2):
    """{(doc_id, leaf): (subroot, root, proof)} of rows of documents."""
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r[0], r[3], r[2], r[4], r[1])))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(langs[g])], arity) for g in order}
    top = levels_of([trees[g][-1][0] for g in order], arity)
    out = defaultdict(list)
    for j, g in enumerate(order):
        for i, (has, doc, digest) in enumerate(sorted(langs[g])):
            out[(doc if has else None, digest)].append((trees[g][-1][0], top[-1][0], steps_of(trees[g], i, arity) + steps_of(top, j, arity)))
    return out


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("arity, run_rows, part_rows, fan", [(2, 8192, 1_000_000, 64), (2, 4, 50, 4), (3, 9, 40, 3), (2, 1, 30, 2)])
def test_manifest_equals_brute_force(spark, arity, run_rows, part_rows, fan):
    rng = random.Random(arity * 100 + run_rows)
    langs = ["en"] * 150 + ["fr"] * 33 + ["de"] * 2 + ["é"] + [None] * 7 + ["e"] * 16
    rows = [(i * 3, f"text {rng.random()}", g, "s", i) for i, g in enumerate(langs)] + [(3, "again", "en", "s", 1)] * 3 + [(None, None, "fr", None, None), (5, "", None, "", 0)]
    rng.shuffle(rows)
    made = merkle.manifest(spark.createDataFrame(rows, DOCS), arity=arity, run_rows=run_rows, part_rows=part_rows, fan=fan)
    want = brute_manifest(rows, arity)
    got = defaultdict(list)
    for r in made.withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).collect():
        assert r.folded == r.root
        got[(r.doc_id, r.leaf)].append((r.subroot, r.root, [(s.left, s.right) for s in r.proof]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_manifest_finds_tampering(spark):
    rows = op12_merkle_manifest(spark, SMALL).collect()
    assert len(rows) == 200 and {r.verified for r in rows} == {True, False}
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root)


def test_manifest_odd_rows(spark, odd, none):
    rows = merkle.manifest(odd).collect()
    plain = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd.collect()]
    want = brute_manifest(plain)
    assert Counter((r.doc_id, r.leaf) for r in rows) == Counter({k: len(v) for k, v in want.items()})
    assert {(r.doc_id, r.leaf, r.subroot, r.root) for r in rows} == {(*k, s, t) for k, v in want.items() for s, t, _ in v}
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(odd.where("doc_id = 10")).first()
    assert one.leaf == one.subroot == one.root and one.proof == []
    with pytest.raises(ValueError):
        merkle.manifest(odd, key="doc_id", carried={"root": F.lit(1)})


def test_a_partial_parent_takes_children_in_any_order():
    values = [sha(str(i)) for i in range(37)]
    for seed in range(5):
        tree, order = merkle.Combiner(37, 2), list(enumerate(values))
        random.Random(seed).shuffle(order)
        for i, v in order[:-1]:
            tree.add(0, i, v)
        assert tree.root is None and len(list(tree.frontier())) <= 6
        tree.add(0, *order[-1])
        assert tree.root == levels_of(values)[-1][0]


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, least=7):
    n = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: [v for v in n if v != w and one_apart(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def variant_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("crowd", [48, 2])
def test_variants_equal_brute_force(spark, crowd):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(7, 11))) for _ in range(25)]
    words = []
    for w in stems:
        words += [w] * rng.choice([3, 40, 600])
        for _ in range(12):
            v, i = w, rng.randrange(len(w))
            for _ in range(rng.randrange(1, 3)):
                v = v[:i] + rng.choice(["", "x", "ab", v[i : i + 1] * 2]) + v[i + 1 :]
            words += [v] * rng.choice([2, 3, 30])
        words += ["".join(rng.sample(w, len(w)))] * 2  # anagrams
    rng.shuffle(words)
    docs = [(i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    got = variant_rows(variants.group_variants(spark.createDataFrame(docs, "doc_id long, text string"), crowd=crowd))
    want = brute_variants(docs)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] and v[1] != v[0] for v in want.values())


def test_variants_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert variant_rows(op13_spelling_variants(spark, SMALL)) == brute_variants(docs)


def test_variants_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()] + [(20, "Straße " * 3 + "GRÖßER GRÖßER ÷×ÀÿÀÿÀÿ " + "z" * 100_000 + " " + "z" * 100_000)] + [(None, "straßen " * 40)]
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, word string, n long")
    got = variant_rows(variants.group_variants(df))
    assert got == brute_variants(docs) and "z" * 100_000 in got
    assert variants.group_variants(none).count() == 0
    assert variants.group_variants(df.where("text is null")).count() == 0
