"""Queries of what writes: vector files, published versions, reports, discovered files, streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from gleaner.operators import dense
from gleaner.operators.judging import grade, parse_answer
from gleaner.operators.models import overlap_judge
from gleaner.plans.base import documents, query, questions, read, scratch, text_qrels, texts_of, vectors
from gleaner.plans.label_queries import POOL, pooled
from gleaner.sources import discovery, publish
from gleaner.sources.reports import Report
from gleaner.sources.vectors import VectorFiles, read_meta
from gleaner.streaming import judging


def written_vectors(spark, d, **options):
    """The folder of a vector file set of all embeddings."""
    spark.dataSource.register(VectorFiles)
    folder = scratch(spark, "vectors")
    rows = vectors(spark, d).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows.write.format("vectors").options(**options).mode("overwrite").save(folder)
    return folder


@query("a5_vector_files", "SELECT vec_id, embedding FROM embeddings")
def _(spark, d):
    """All embeddings through files of matrices and ids and back."""
    folder = written_vectors(spark, d, bytesPerFile=65_536)
    return spark.read.format("vectors").option("rowsPerPartition", 100).load(folder).select(F.col("id").cast("long").alias("vec_id"), "embedding")


@query("b5_embedding_meta", "SELECT count(*) AS rows, max(len(embedding)) AS dim, round(count(*) * max(len(embedding)) * 2 / 1048576, 3) AS size_mb, 'float16' AS dtype FROM embeddings")
def _(spark, d):
    """What the writer says of a set in half precision, beside the number of rows that are read back."""
    folder = written_vectors(spark, d, dtype="float16")
    meta = read_meta(folder)
    back = spark.read.format("vectors").load(folder).groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("rows"))
    return back.select("rows", "dim", F.lit(float(meta["size_mb"])).alias("size_mb"), F.lit(meta["dtype"]).alias("dtype"))


@query("g10_half_precision_top10", "SELECT query_id, doc_id, score, rank FROM run_full")
def _(spark, d):
    """The corpus read back from half-precision blocks for the first pass, its finalists scored in full: the same ten as by a full search."""
    v = vectors(spark, d)
    found = dense.top_k(v.where("vec_id % 50 = 0"), v, 11, half=True).where("query_id <> vec_id")
    from gleaner.operators import bm25

    return bm25.top(found.select("query_id", F.col("vec_id").alias("doc_id"), "score"), "query_id", 10).select("query_id", "doc_id", "score", "rank")


@query("b7_publish", """
WITH q AS (SELECT * FROM qrels WHERE grade > 0)
SELECT 'corpus' AS name, (SELECT count(*) FROM documents) AS rows, false AS refused UNION ALL SELECT 'qrels', (SELECT count(*) FROM q), false
UNION ALL SELECT 'queries', (SELECT count(*) FROM benchmark WHERE item_id IN (SELECT query_id FROM q)), false UNION ALL SELECT 'faulty', 1, true""")
def _(spark, d):
    """A benchmark of the tables is published; a second version with a label of an unknown document is refused and changes nothing."""
    path, labels = scratch(spark, "published"), text_qrels(spark, d).where("grade > 0")
    queries = questions(spark, d).join(labels, "query_id", "left_semi")
    tables = {"corpus": documents(spark, d).select("doc_id", "text"), "queries": queries, "qrels": labels}
    version = publish.publish(spark, tables, path, publish.benchmark_check)
    faulty = labels.union(labels.limit(1).select("query_id", F.lit(-1).cast("long"), "grade"))
    try:
        publish.publish(spark, {**tables, "qrels": faulty}, path, publish.benchmark_check)
        n = 0
    except publish.Refused as e:
        n = e.faults[0][1]
    whole = publish.current(spark, path) == version and not publish.broken(spark, path)
    told = [(name, t["rows"], not whole) for name, t in publish.manifest(spark, path)["tables"].items()]
    return spark.createDataFrame([*told, ("faulty", n, n > 0)], "name string, rows long, refused boolean")


@query("b8_report", """
SELECT 'corpus' AS section, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(max(length(text)) AS BIGINT) AS longest FROM documents
UNION ALL SELECT 'english', count(*), sum(length(text)), max(length(text)) FROM documents WHERE lang = 'en'""")
def _(spark, d):
    """Two exports with their numbers observed on the way, read back from the report."""
    report, folder = Report(), scratch(spark, "report")
    chars = F.length("text").cast("long")
    numbers = {"n": F.count("*"), "chars": F.sum(chars), "longest": F.max(chars)}
    corpus = report.watch("corpus", documents(spark, d).select("doc_id", "text", "lang"), **numbers)
    report.watch("english", corpus.where("lang = 'en'"), **numbers).write.parquet(f"{folder}/english")
    report.save(spark, f"{folder}/report.json")
    told = spark.read.text(f"{folder}/report.json", wholetext=True).select(F.from_json("value", "map<string, struct<n: bigint, chars: bigint, longest: bigint>>").alias("m"))
    return told.select(F.explode("m").alias("section", "x")).select("section", "x.*")


@query("a19_discovery", """
SELECT source || '.jsonl' AS name, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'none.jsonl', 0""")
def _(spark, d):
    """Each source's documents as gzipped JSON lines some folders down, a stale copy of one further down; names without .gz find the right files."""
    root = scratch(spark, "mount")
    docs = documents(spark, d).where("source is not null").select("source", "doc_id")
    docs.repartition("source").write.partitionBy("source").option("compression", "gzip").json(f"{root}/datasets/some/one")
    files = discovery.listing(spark, root, "*.json.gz")
    # a writer's part files are known by their folders; the listing is given their names
    named = files.select("path", F.concat(F.regexp_extract("path", "source=([^/]+)/", 1), F.lit(".jsonl.gz")).alias("file"), "modified", "length")
    stale = named.limit(1).select(F.concat(F.lit("far/away/from/"), "path").alias("path"), "file", "modified", F.lit(0).cast("long").alias("length"))
    names = docs.select(F.concat("source", F.lit(".jsonl")).alias("name")).distinct().union(spark.createDataFrame([("none.jsonl",)], "name string"))
    hits = discovery.found(named.union(stale), names)
    lines = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter="*.json.gz").select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    same = F.regexp_extract("path", "source=[^/]+/[^/]+$", 0)
    return hits.withColumn("key", same).join(lines.select(same.alias("key"), "n"), "key", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))



@query("f13_judging_loop", "WITH" + POOL + """,
s AS (SELECT r.query_id, r.doc_id, len(list_intersect(list_distinct(q.tokens), t.tokens)) / greatest(len(list_distinct(q.tokens)), 1) AS share FROM pool r JOIN questok q USING (query_id) JOIN doctok t USING (doc_id))
SELECT query_id, doc_id, CASE WHEN share >= 0.5 THEN 2 WHEN share >= 0.25 THEN 1 ELSE 0 END AS grade FROM s""")
def _(spark, d):
    """Events call for pairs of the pool, most of them several times and out of order; a second run takes up the stream when the later half has arrived."""
    folder = scratch(spark, "judging")
    pool = pooled(spark, d).select("query_id", "doc_id")
    texts = pool.join(questions(spark, d).withColumnRenamed("text", "question"), "query_id").join(texts_of(documents(spark, d).select("doc_id", "text"), pool), "doc_id")
    texts.write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    # which pair an event calls for, by numbers that follow the pairs' hashes
    from gleaner.operators.ids import numbered

    pairs = numbered(texts.select("query_id", "doc_id", F.md5(F.concat_ws("|", "query_id", "doc_id").cast("binary")).alias("h")), ["h"], "number")
    n = pairs.count()
    calls = read(spark, d, "events").select((F.col("event_id") % n + 1).alias("number"), "ts").join(pairs, "number").select("query_id", "doc_id", "ts")
    table, state, schema = f"{folder}/table", f"{folder}/state", "query_id long, doc_id long, ts timestamp"
    for half in (0, 1):
        calls.where(F.pmod(F.xxhash64("ts", "doc_id"), F.lit(2)) == half).repartition(3).write.mode("append").parquet(f"{folder}/pairs")
        arriving = judging.arriving(spark, f"{folder}/pairs", schema, files_a_batch=2, lateness="366 days")
        judging.run(judging.judged(arriving, texts, overlap_judge, lambda raw: grade(parse_answer(raw))), table, state)
    return spark.read.parquet(table).select("query_id", "doc_id", "grade")


@query("s2_stream_windows", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    """Events as a stream of files: counts and sums of six-hour windows kept as state, each batch's changes merged by key at the end."""
    folder = scratch(spark, "windows")
    events = read(spark, d, "events").select("event_type", "value", "ts")
    events.repartition(4).write.parquet(f"{folder}/in")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    sums = rows.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = sums.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

    def append(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(append).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select("start", "event_type", "x.n", "x.total")
