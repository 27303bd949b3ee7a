"""What the operators of this subpackage share: a folder that every executor reaches, bounded Arrow batches, sized broadcasts."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for sessions on one machine (tests, the bench) that name no spark.checkpoint.dir.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/oresieve"
#: Rows of a table that may be broadcast; a row of ours is under 100 bytes, so this is under 20 MB.
BROADCAST_ROWS = 200_000
#: The whitespace that separates words: space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Unset, a local one is set on one machine; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """Where all tables of this application are, so that clean() can remove them together."""
    return f"{shared_folder(spark)}/oresieve-{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> None:
    """Removes the tables of all operators of this application; their results must have been written or read before."""
    remove(spark, session_folder(spark))


class Scratch:
    """Tables written to the shared folder in the course of one operator: they cut lineage, and losing an executor loses nothing.

    A result is read from them when its action runs, so an operator drops only those that its result does not read; clean() drops the rest.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{session_folder(spark)}/{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch = path
        return kept

    def drop(self, df: DataFrame) -> None:
        """Removes a table that keep() wrote and that nothing reads any more."""
        path = getattr(df, "_scratch", None)
        if path:
            remove(self.spark, path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Holds Arrow batches to few rows, as one text may be very long: a Python worker then holds a bounded part of a partition.

    This setting of the session stays, as a result's batches are made when its action runs, after the operator has returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """The table marked for broadcast if it has few rows; else as it is, for a shuffled join that splits skewed keys."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read once on the driver; its few MB are broadcast, so executors need no copy of the file."""
    return Path(path).read_bytes()


def named(base: str, taken) -> str:
    """A column name that the input does not have, for helper columns."""
    taken = {c.lower() for c in taken}
    while base.lower() in taken:
        base += "_"
    return base


def slices(sizes, most: int):
    """Cuts rows 0..n into runs (start, end) whose sizes add up to at most `most`, or hold a single row."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
