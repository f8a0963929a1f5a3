"""The registered queries of the training-data operators, with production parameters, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import embedding, language, licenses, merkle, minhash, mixing, packing, pieces, quality, secrets, sharding, toxicity, variants
from gleaner.llm.common import learns, read

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def vocabulary() -> tuple[str, str]:
    """Paths of the rank file and of the JSON file of the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.link_embeddings(read(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"))
    live = F.expr("cast(size(filter(found, x -> x.verdict = 'live')) as long)")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", live.alias("n_live"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), *vocabulary())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    spans = F.expr("array_join(transform(spans, x -> concat(x.s, ':', x.e)), ',')")
    return scored.select("doc_id", "held_out", "score", "predicted", spans.alias("spans"))


def piece_model() -> str:
    """Path of the sentencepiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(read(spark, sf_dir, "documents"), piece_model())
    said = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "ids")
    decoded = pieces.decode(said, piece_model())
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the crc32 of the doc_id, the leaf that is folded is that of the row with one character more in n_chars."""
    tampered = F.when(learns(0, 7, True), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    start = merkle.leaf("doc_id", "source", "lang", tampered, "text")
    rows = merkle.manifest(read(spark, sf_dir, "documents"), carried={"start": start})
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.col("start"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import pipeline

    return pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_embedding_near_dedup, op2_quality_rules, op3_license_scans, op4_minhash_near_dedup, op5_language_id,
        op6_secret_scans, op7_source_mixing, op8_sharding, op9_packing, op10_toxicity, op11_sentencepiece, op12_merkle_manifest, op13_spelling_variants, pipeline,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    from gleaner.llm.oracles import ORACLES

    return dict(ORACLES)
