"""The mining pipelines end to end, from snapshot tables to result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import analysis, dependencies, enrich, extraction, report, search
from ..operators.state import upserted
from ..sources import snapshots


def frameworks(hits: DataFrame, contributors: DataFrame, commits: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """Framework candidates: first-wins hits, enriched and filtered, most stars first, with the columns of the export."""
    found = search.candidates(search.first_wins(snapshots.capped(hits), " | ", "matched_query"), "matched_query").drop("latest_default_branch_commit_date")
    tests = analysis.extracted(analysis.test_files(files), [])
    functions = tests.where("parse_ok").groupBy("full_name").agg(F.count(F.lit(1)).alias("test_function_count"))
    counted = snapshots.contributor_counts(contributors).withColumnRenamed("contributors", "contributors_count")
    trees = enrich.tree_stats(entries).drop("dep_file_count")
    rows = enrich.with_counts(found, counted, trees, functions, snapshots.latest_commit_dates(commits)).fillna(0, ["test_file_count", "test_function_count"])
    return report.by_stars(enrich.frameworks_kept(rows), "stars", "seq").select(*K.FRAMEWORK_COLUMNS)


def applications_v1(hits: DataFrame, known: DataFrame, contributors: DataFrame, commits: DataFrame, entries: DataFrame) -> DataFrame:
    """Application candidates of the first version with their drop_reason. Forks go before deduplication, archived and disabled ones after."""
    found = search.first_wins(search.active(search.excluded(snapshots.capped(hits), known), ["fork"]))
    found = search.active(found, ["archived", "disabled"])
    counted = snapshots.contributor_counts(contributors, K.PAGE_ROWS).withColumnRenamed("contributors", "contributors_count")
    rows = enrich.with_counts(enrich.lifetime(search.candidates(found)), counted, commits, enrich.tree_stats(entries).drop("dep_file_count"))
    rows = rows.withColumn("test_function_count", F.lit(None).cast("int"))
    return enrich.reason_v1(rows).select(*K.APPLICATION_V1_COLUMNS, "drop_reason", "seq")


def applications_v2(hits: DataFrame, known: DataFrame, contributors: DataFrame, commits: DataFrame, entries: DataFrame) -> DataFrame:
    """Application candidates of the second version with their drop_reason. All flags are tested before deduplication."""
    found = search.first_wins(search.active(search.excluded(snapshots.capped(hits), known)))
    rows = enrich.with_counts(enrich.lifetime(search.candidates(found)), contributors, commits, enrich.tree_stats(entries).drop("dep_file_count"))
    rows = rows.withColumn("default_branch", C.or_default(F.col("default_branch"), "main", True))
    rows = enrich.reason_v2(rows).withColumn("commits_per_month", C.py_round(F.col("per_month"), 2))
    return rows.select(*K.APPLICATION_V2_COLUMNS, "drop_reason", "seq")


def analysed(repositories: DataFrame, files: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, tests, documents) of applications: each file is parsed once for all three if the caller keeps the tests."""
    mine = analysis.test_files(files)
    tests = analysis.classified(analysis.extracted(mine, partitions=partitions))
    counts = analysis.repository_counts(repositories, mine, tests)
    return report.by_stars(counts, "stars", "full_name"), analysis.llm_tests(tests).orderBy("repo", "file", "test_function"), extraction.application_documents(tests, counts)


def framework_tests(files: DataFrame, listed_order: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tests, documents) of frameworks: the tests found, framework first, then each with the first source of its name."""
    parsed = analysis.extracted(analysis.test_files(files), K.MODEL_MODULES, strict=True)
    found = analysis.classified(parsed, K.MODEL_MODULES).where("is_llm")
    order = Window.partitionBy("full_name").orderBy("path", "bfs_seq")
    listed = found.select("full_name", "path", "name", F.row_number().over(order).alias("seq"))
    table = listed.select(F.col("full_name").alias("framework"), F.col("path").alias("file"), F.col("name").alias("test_function"), "seq")
    return table.orderBy("framework", "seq").drop("seq"), extraction.framework_documents(extraction.first_sources(listed, parsed))


def evaluators(spark: SparkSession, applications: DataFrame, frameworks_: DataFrame, files: DataFrame, entries: DataFrame, state: DataFrame):
    """(hits, bare, state): repositories that declare evaluators, those without dependency files anywhere, and the new state.

    The root check of all candidates, then the deep check of those without root files, then both outputs from the state.
    """
    both = dependencies.categorised(Applications=applications, Frameworks=frameworks_)
    verdicts, fresh = dependencies.root_check(spark, both, files, state)
    state = upserted(state, fresh)
    deep = dependencies.deep_check(dependencies.without_files(verdicts).dropDuplicates(["full_name"]), state, snapshots.default_branches(both.withColumnRenamed("branch", "default_branch")), entries, files)
    state = upserted(state, deep)
    found, bare = dependencies.rebuilt(state)
    return found, bare, state
