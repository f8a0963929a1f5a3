"""Texts read once for given queries: of each document, what the queries ask for and no more.

One pass splits a text into tokens and counts them. From these counts come the forms of each tokenizer (they all begin with the same
tokens), and of those the document's length, the counts of the queries' tokens, written as numbers, and how many documents hold each
token at all. Runs of tokens that are wanted are looked up in the same pass. So several searches and labels over the same documents
don't split them anew, and a search reads numbers in place of strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.functions import plain
from gleaner.functions.text import split_tokens
from gleaner.operators import bm25
from gleaner.operators.copying import MOST_RUNS, grams
from gleaner.sources.durable import exists

#: Types of doc_id that a search can hold its best of (`bm25.best`).
WHOLE = ("bigint", "int", "smallint", "tinyint")
#: Tokens whose documents a task counts before it passes its counts on.
MOST_COUNTED = 500_000


def _split(texts: list[str], words: plain.Words):
    """(distinct tokens, code and row of each token of the texts in order, whether it is in a text with Cyrillic letters)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    told = [plain.blanked(t, words) if t else (b"", False) for t in texts]
    parts = pc.ascii_split_whitespace(pa.array([t for t, _ in told], pa.binary()).cast(pa.string()))
    coded = parts.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    empty = pc.index(coded.dictionary, "").as_py()  # white space at an end
    if empty >= 0:
        there = code != empty
        code, row = code[there], row[there]
    return coded.dictionary, code, row, np.array([c for _, c in told], bool)[row]


def _formed(tokens, code, cyrillic, form):
    """(distinct forms of the tokens, code of each token's form)."""
    import numpy as np
    import pyarrow as pa

    made = [f(tokens) if f else tokens for f in (form if cyrillic.any() else form[:1])]
    if made == [tokens]:
        return tokens, code
    coded = pa.concat_arrays(made).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)[code + len(tokens) * cyrillic]


def _standing(numbers, row, runs: dict[bytes, int], n: int):
    """(row, number of a run) of each run of n tokens that stands in a row, once; numbers: those of the tokens in runs, -1 for others."""
    import numpy as np

    known = np.cumsum(np.append(0, numbers >= 0))
    starts = np.flatnonzero(known[n:] - known[:-n] == n)
    starts = starts[row[starts] == row[starts + n - 1]]
    found = {(int(row[s]), runs[w]) for s in starts if (w := numbers[s : s + n].tobytes()) in runs}
    return zip(*sorted(found)) if found else ((), ())


def _pass(given, id_type, n: int, size: int = 4 << 20, most: int = MOST_COUNTED):
    """Rows of documents (see `Asked.rows`), some megabytes of texts at a time, and between them rows of counts of the tokens' documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        forms, vocabularies, runs = given.value
        vocabularies = [pa.array(v, pa.string()) for v in vocabularies]
        run_tokens = sorted({t for r in runs for t in r.split(" ")})
        place = {t: i for i, t in enumerate(run_tokens)}
        runs, run_tokens = {np.array([place[t] for t in r.split(" ")], np.int32).tobytes(): i for i, r in enumerate(runs)}, pa.array(run_tokens, pa.string())
        words, held = plain.Words(plain.split_tokens), [[] for _ in forms]
        pair, count = pa.struct([("token", pa.int32()), ("tf", pa.int32())]), pa.struct([("token", pa.string()), ("df", pa.int64())])
        names = ["doc_id", *(f"{c}{i}" for i in range(len(forms)) for c in ("dl", "terms")), "runs", "form", "counts"]

        def lists(lengths, values):
            return pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, lengths)), pa.int32()), values)

        def numbered(tokens, vocabulary):
            return pc.index_in(tokens, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)

        def counts_of(i, most, size=20_000):
            """The counts held of a form, given up where they are more than `most` once they are added up."""
            if sum(map(len, held[i])) <= most:
                return
            summed = pa.concat_tables(held[i]).group_by("token").aggregate([("df", "sum")])
            held[i] = [summed.rename_columns({"df_sum": "df"})]
            if len(summed) > most // 2:
                held[i] = []
                for start in range(0, len(summed), size):
                    some = summed.slice(start, size).combine_chunks()
                    empty = [pa.nulls(1, t) for t in (id_type, *[pa.int32(), pa.list_(pair)] * len(forms), pa.list_(pa.int32()))]
                    told = pa.StructArray.from_arrays([some.column("token").chunk(0), some.column("df_sum").chunk(0)], fields=list(count))
                    yield pa.RecordBatch.from_arrays([*empty, pa.array([i], pa.int32()), lists([len(some)], told)], names)

        def documents(some):
            rows = some.num_rows
            tokens, code, row, cyrillic = _split(some.column(1).to_pylist(), words)
            columns = []
            for i, form in enumerate(forms):
                terms, at = _formed(tokens, code, cyrillic, form)
                key, tf = np.unique(row * len(terms) + at, return_counts=True)
                its, term = (key // len(terms), key % len(terms)) if len(terms) else (key, key)
                df = np.bincount(term, minlength=len(terms))
                held[i].append(pa.table({"token": terms, "df": pa.array(df, pa.int64())}).filter(pa.array(df > 0)))
                number = numbered(terms, vocabularies[i])[term]
                there = np.flatnonzero(number >= 0)
                there = there[np.lexsort((number[there], its[there]))]
                values = pa.StructArray.from_arrays([pa.array(number[there], pa.int32()), pa.array(tf[there], pa.int32())], fields=list(pair))
                columns += [pa.array(np.bincount(row, minlength=rows), pa.int32()), lists(np.bincount(its[there], minlength=rows), values)]
            its, found = _standing(numbered(tokens, run_tokens)[code], row, runs, n)
            hits = lists(np.bincount(np.array(its, np.int64), minlength=rows), pa.array(found, pa.int32()))
            return pa.RecordBatch.from_arrays([some.column(0), *columns, hits, pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(count))], names)

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
                yield documents(batch.slice(start, stop - start))
                start = stop
                for i in range(len(forms)):
                    yield from counts_of(i, most)
        for i in range(len(forms)):
            yield from counts_of(i, 0)

    return run


class Asked:
    """What queries (key, text) ask of docs (doc_id, text), in a folder that all machines see; written when it is first wanted, once.

    tokenizers: those of `plain.FORMS`. n: length of the runs of tokens that are looked up, all those of the queries. The folder
    belongs to these documents, queries and tokenizers.
    """

    def __init__(self, spark: SparkSession, folder: str, docs: DataFrame, queries: DataFrame, key: str, tokenizers: list[Callable], n: int = 8):
        self.spark, self.folder, self.docs, self.queries, self.key, self.tokenizers, self.n = spark, folder, docs, queries, key, tokenizers, n
        self._known: tuple | None = None

    @property
    def known(self) -> bool:
        """Whether the queries' tokens and runs are few enough to go to every task; others are searched over the whole index."""
        if self._known is None:
            asked, runs = [], []
            if dict(self.docs.dtypes)["doc_id"] in WHOLE:
                for t in self.tokenizers:
                    tokens = bm25.tokens_of(self.queries, self.key, tokenizer=t).groupBy(self.key, "token").agg(F.count("*").alias("qtf"))
                    asked.append(tokens.limit(bm25.MOST_TERMS + 1).collect())
                wanted = self.queries.select(F.explode(grams(split_tokens(F.col("text")), self.n)).alias("gram")).distinct()
                runs = sorted(r.gram for r in wanted.limit(MOST_RUNS + 1).collect())
            few = bool(asked) and all(len(a) <= bm25.MOST_TERMS for a in asked) and len(runs) <= MOST_RUNS
            self._known = (few, asked, [sorted({r.token for r in a}) for a in asked], runs)
        return self._known[0]

    def _part(self, name: str, made) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            made().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @property
    def rows(self) -> DataFrame:
        """doc_id, and for the tokenizer i: dl{i}, terms{i} (number of the query's token, tf); runs (numbers). Rows of counts have a form and no document: form, counts (token, df)."""
        if not self.known:
            raise ValueError("too many tokens are asked for, or doc_id isn't a whole number")

        def made():
            _, _, vocabularies, runs = self._known
            forms = [plain.FORMS[t] for t in self.tokenizers]
            given = self.spark.sparkContext.broadcast((forms, vocabularies, runs))
            kind = dict(self.docs.dtypes)["doc_id"]
            each = ", ".join(f"dl{i} int, terms{i} array<struct<token:int,tf:int>>" for i in range(len(forms)))
            work = _pass(given, to_arrow_type(self.docs.schema["doc_id"].dataType), self.n)
            texts = self.docs.select("doc_id", F.lower("text").alias("text"))
            return texts.mapInArrow(work, f"doc_id {kind}, {each}, runs array<int>, form int, counts array<struct<token:string,df:bigint>>")

        return self._part("rows", made)

    def index(self, tokenizer) -> bm25.Index:
        """An index whose rows hold the numbers of the queries' tokens alone; sizes and counts of documents are those of all tokens."""
        i = self.tokenizers.index(tokenizer)
        told = self.rows
        rows = told.where("form is null").select("doc_id", F.col(f"dl{i}").alias("dl"), F.col(f"terms{i}").alias("terms"))
        size = self._part(f"size{i}", lambda: rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))
        df = self._part(f"df{i}", lambda: told.where(F.col("form") == i).select(F.inline("counts")).groupBy("token").agg(F.sum("df").alias("df")))
        return bm25.Index(rows, size, counted=df)

    def best(self, tokenizer, k: int = 10) -> DataFrame:
        """`bm25.best` of all documents for the queries."""
        index = self.index(tokenizer)
        _, asked, vocabularies, _ = self._known
        i = self.tokenizers.index(tokenizer)
        kind = dict(self.queries.dtypes)[self.key]
        number = {t: j for j, t in enumerate(vocabularies[i])}
        told = self.spark.createDataFrame([(r[0], r.token, r.qtf, number[r.token]) for r in asked[i]], f"{self.key} {kind}, token string, qtf long, number int")
        wanted = index.terms.join(F.broadcast(told), "token").select(self.key, F.col("number").alias("token"), "qtf", "idf")
        return bm25.top(bm25.scanned(index, wanted, self.queries, self.key, k), self.key, k)

    @property
    def shared(self) -> DataFrame:
        """doc_id, gram of the queries' runs of n tokens that stand in a document, each once."""
        told = self.rows.where("form is null").select("doc_id", F.explode("runs").alias("number"))
        runs = self.spark.createDataFrame(list(enumerate(self._known[3])), "number int, gram string")
        return told.join(F.broadcast(runs), "number").select("doc_id", "gram")
