"""A corpus pipeline of five of the training-data operators.

Each stage takes what its predecessor kept. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import language, minhash, mixing, packing, queries, secrets
from gleaner.llm.common import checkpoint, marked, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REDACTED = "[REDACTED]"
#: Near duplicates are texts whose five-word shingles are as similar as this, in per cent.
SIMILAR = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter at all) go; the prediction replaces a missing label. Where nothing could be learned, every text with a letter stays as it is."""
    model = language.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    said = language.label(docs, model)
    kept = said.where(F.col("lang_pred") != language.UNKNOWN)
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, and of rows that repeat its id and text one. Rows without an id stay."""
    rows = minhash.near_duplicates(docs, percent=SIMILAR).where("doc_id is not null")
    per = rows.groupBy("doc_id", F.coalesce("text_hash", F.lit(0)).alias("hash")).agg(F.count("*").alias("n"), F.min("kept").alias("stays"))
    named = checkpoint(per.where("n > 1 or not stays").select("doc_id", "hash", "stays"))
    keyed = docs.select(*COLUMNS, F.coalesce(F.xxhash64("text"), F.lit(0)).alias("hash"))
    seen = marked(keyed, named, "maybe", "doc_id, hash")
    looked = seen.where("maybe").join(named, ["doc_id", "hash"], "left")
    once = looked.where("stays").dropDuplicates(["doc_id", "hash"])
    return seen.where("not maybe").select(*COLUMNS).union(looked.where("stays is null").select(*COLUMNS)).union(once.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    return secrets.redact(docs, REDACTED).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents are packed into."""
    return packing.pack(docs, *queries.vocabulary())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("source_mix", source_mix), ("packing", pack)]

# The stages train a model, estimate similarities and tokenise: SQL can't express them; tests/llm holds the rows against a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again; a stage's files go once the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
