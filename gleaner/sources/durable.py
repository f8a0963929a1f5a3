"""Folders that the driver and all executors share, and lineage that is cut by files in them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes, in the shared one that spark.checkpoint.dir names; a local session without it gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gleaner-")
    return f"{named}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder: what several steps read is computed once and outlives executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> bool:
    fs, at = _place(spark, path)
    return fs.delete(at, True)


def move(spark: SparkSession, old: str, new: str) -> bool:
    """Rename; false where the new name is taken or the old one isn't there."""
    fs, at = _place(spark, old)
    there = spark._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(there.getParent())
    return not fs.exists(there) and fs.exists(at) and fs.rename(at, there)


def version(spark: SparkSession, path: str) -> str:
    """What changes when the files at a path do: their bytes, number and last change."""
    fs, at = _place(spark, path)
    summary = fs.getContentSummary(at)
    return f"{summary.getLength()}-{summary.getFileCount()}-{fs.getFileStatus(at).getModificationTime()}"


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _place(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file in one step: whoever reads it meanwhile gets the old text or the new one."""
    fs, fresh = _place(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(at), options)
