"""The summary table and sorted exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def by_stars(rows: DataFrame, stars: str = "stars", *ties: str) -> DataFrame:
    """Most stars first, missing ones as 0; ties by the columns given, for sorts that must be stable."""
    return rows.orderBy(F.coalesce(F.col(stars).try_cast("bigint"), F.lit(0)).desc(), *ties)


def summary(candidates: DataFrame, seq: str | None = None) -> DataFrame:
    """Display columns of framework candidates as text tables have them, most stars first; unreadable stars are blank and sort as 0."""
    thousands = C.py_round(F.col("stars").try_cast("bigint") / 1000, 1)
    rows = candidates.select(
        F.col("full_name").alias("AI agent framework"),
        thousands.alias("# Stars (k)"),
        F.col("contributors_count").alias("# Contributors"),
        F.col("test_file_count").alias("# Test files"),
        F.col("test_function_count").alias("# Test functions"),
        *([F.col(seq).alias("seq")] if seq else []),
    )
    return rows.orderBy(F.coalesce("# Stars (k)", F.lit(0.0)).desc(), *(["seq"] if seq else ["AI agent framework"])).drop("seq")


def console(hits: DataFrame) -> DataFrame:
    """(full_name, line): what a run tells of its hits, by name."""
    return hits.select("full_name", F.concat("full_name", F.lit(": "), "frameworks").alias("line")).orderBy("full_name")


def progress(rows: DataFrame, *order: str) -> DataFrame:
    """Adds i and total, a row's number in the order and the number of rows. Rows are range-sorted; only counts of ranges meet on the driver."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).persist()
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    if not before:
        return ranged.withColumns({"i": F.lit(0).cast("long"), "total": F.lit(0).cast("long")}).drop("part", "nth")
    start = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    return ranged.withColumns({"i": start[F.col("part")] + F.col("nth") + 1, "total": F.lit(total).cast("long")}).drop("part", "nth")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows of different columns; missing cells are null, and new columns come last."""
    return old.unionByName(new, allowMissingColumns=True)
