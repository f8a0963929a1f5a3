"""Publishing a set of tables: staged, checked, described by a manifest, and switched to in one step.

    path/versions/<version>/<table>/...    the files of each version
    path/versions/<version>/manifest.json  rows, schema, checksum of each table
    path/CURRENT                           the version that readers take

Rows are counted and summed up while they are written, so no table is read again for its manifest.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.curation import referential_faults
from gleaner.sources.durable import exists, move, read_text, remove, write_text


class Refused(ValueError):
    """A check found faults; `faults` has them as (check, n)."""

    def __init__(self, faults: list[tuple[str, int]]):
        self.faults = faults
        super().__init__("not published: " + ", ".join(f"{c}: {n}" for c, n in faults))


def checksum(df: DataFrame) -> tuple:
    """Aggregates that tell a table from another whatever the order of its rows: their number, and sum and xor of their hashes."""
    h = F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes))
    return F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")).cast("string"), F.lit("0")).alias("sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor")


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, check=None) -> str:
    """The new version's name. check: from the staged tables (name -> DataFrame) to rows of (check, n); any n above 0 is `Refused`.

    Whatever fails, the current version stays as it is, and what was staged is removed.
    """
    version = uuid.uuid4().hex
    stage = f"{path}/_staging-{version}"
    try:
        told = {}
        for name, df in tables.items():
            seen = Observation(name)
            df.observe(seen, *checksum(df)).write.parquet(f"{stage}/{name}")
            told[name] = {**seen.get, "schema": df.schema.simpleString()}
        if check is not None:
            staged = {name: spark.read.parquet(f"{stage}/{name}") for name in tables}
            if faults := [(r["check"], r["n"]) for r in check(staged).where("n > 0").collect()]:
                raise Refused(faults)
        write_text(spark, f"{stage}/manifest.json", json.dumps({"version": version, "tables": told}, indent=1, ensure_ascii=False))
        if not move(spark, stage, f"{path}/versions/{version}"):
            raise OSError(f"{stage} could not be moved")
    except BaseException:
        remove(spark, stage)
        raise
    write_text(spark, f"{path}/CURRENT", version)  # readers see the old name or the new one
    return version


def benchmark_check(staged: dict[str, DataFrame]) -> DataFrame:
    """The references between corpus (doc_id), queries (query_id) and qrels (query_id, doc_id, grade)."""
    return referential_faults(staged["queries"].select("query_id"), staged["corpus"].select("doc_id"), staged["qrels"])


def current(spark: SparkSession, path: str) -> str | None:
    return read_text(spark, f"{path}/CURRENT").strip() if exists(spark, f"{path}/CURRENT") else None


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, f"{path}/versions/{current(spark, path)}/manifest.json"))


def published(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{path}/versions/{current(spark, path)}/{table}")


def broken(spark: SparkSession, path: str) -> list[str]:
    """Tables of the current version whose rows aren't those of the manifest."""
    out = []
    for name, told in manifest(spark, path)["tables"].items():
        df = published(spark, path, name)
        row = df.agg(*checksum(df)).first()
        if (row.rows, row.sum, row.xor) != (told["rows"], told["sum"], told["xor"]):
            out.append(name)
    return out
