"""Landed search snapshots as a stream: each run takes what is new, and the checkpoint is the resume state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas
from ..operators import search
from ..operators.state import State

CANDIDATES = "full_name string, first struct<run_id:string, term_seq:int, page:int, pos:int>, item " + schemas.HIT_ITEM + ", terms array<string>"


def landed(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """New JSON files of hits, a bounded number in a batch."""
    return spark.readStream.schema(schemas.SEARCH_HITS).option("maxFilesPerTrigger", files_at_once).json(path)


def merge(state: State, batch: DataFrame) -> DataFrame:
    """First-wins over runs: the earliest hit's item by (run, term, page, position), and all terms so far. Repeating a batch changes nothing."""
    order = F.struct("run_id", *search.ORDER)
    new = batch.select(F.col("item.full_name").alias("full_name"), order.alias("first"), "item", F.array("term").alias("terms"))
    old = state.load().join(new.select("full_name").distinct(), "full_name", "left_semi")
    both = old.unionByName(new).groupBy("full_name").agg(
        F.min("first").alias("first"),
        F.min_by("item", "first").alias("item"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"),
    )
    return state.save(both.select("full_name", "first", "item", "terms"))


def run(spark: SparkSession, source: str, state_path: str, checkpoint: str, files_at_once: int = 1000) -> State:
    """Takes all that has landed since the last run into the state, and ends. A run that broke off is taken up by the next.

    The state is written once for every files_at_once files, which is the cadence of its flushes.
    """
    state = State(spark, state_path, CANDIDATES)
    query = landed(spark, source, files_at_once).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: merge(state, batch))
    query.start().awaitTermination()
    return state


def first_seen(hits: DataFrame, delay: str = "1 day", time: str = "seen_at") -> DataFrame:
    """A stream of hits without repeated repositories, as far back as the watermark holds state."""
    return hits.withWatermark(time, delay).dropDuplicatesWithinWatermark(["full_name"])


def hourly(hits: DataFrame, delay: str = "1 hour", time: str = "seen_at") -> DataFrame:
    """Hits by term and hour of a stream; late ones count until the watermark has passed."""
    return hits.withWatermark(time, delay).groupBy(F.window(time, "1 hour"), "term").agg(F.count(F.lit(1)).alias("n"))
