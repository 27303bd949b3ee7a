"""Derived columns and staged filters, with the reason of the first that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Limits of the application searches.
LEAST_DAYS, LEAST_CONTRIBUTORS, LEAST_COMMITS = 30, 2, 2
DAYS_V1, DAYS_V2 = 30.44, 30.0


def lifetime(rows: DataFrame) -> DataFrame:
    """lifetime_days: whole days from creation to the last push; null if either date is missing or malformed."""
    return rows.withColumn("lifetime_days", C.whole_days(C.moment(F.col("created_at")), C.moment(F.col("pushed_at"))))


def commits_per_month_v1(total: Column, days: Column) -> Column:
    """Rounded to 2 places as Python does; null without days."""
    return C.py_round(total / (F.nullif(days, F.lit(0)) / F.lit(DAYS_V1)), 2)


def commits_per_month_v2(total: Column, days: Column) -> Column:
    """Not rounded; a month counts as one at least."""
    return total / F.greatest(F.coalesce(days, F.lit(0)) / F.lit(DAYS_V2), F.lit(1.0))


def tree_stats(entries: DataFrame) -> DataFrame:
    """Test files and dependency files of each repository that has entries."""
    blob = F.col("type") == "blob"
    return entries.groupBy("full_name").agg(
        F.count_if(blob & C.is_test_file(F.col("path"))).alias("test_file_count"),
        F.count_if(blob & C.is_dep_file(F.col("path"))).alias("dep_file_count"),
    )


def with_counts(rows: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left joins of per-repository tables on full_name, each deduplicated by construction."""
    for t in tables:
        rows = rows.join(t, "full_name", "left")
    return rows


def frameworks_kept(rows: DataFrame) -> DataFrame:
    """Not archived, not disabled, two contributors unless unknown, and a test file."""
    n = F.col("contributors_count")
    flags = F.coalesce("archived", F.lit(False)) | F.coalesce("disabled", F.lit(False))
    return rows.where(~flags & (n.isNull() | (n >= LEAST_CONTRIBUTORS)) & (F.coalesce("test_file_count", F.lit(0)) >= 1))


def reason_v1(rows: DataFrame) -> DataFrame:
    """drop_reason in the order lifetime, commits, contributors, tests (two files); null for rows that stay."""
    days = F.coalesce("lifetime_days", F.lit(0))
    rows = rows.withColumn("commits_per_month", commits_per_month_v1(F.col("total_commits"), F.col("lifetime_days")))
    reason = (
        F.when(days < LEAST_DAYS, "lifetime")
        .when(F.coalesce("commits_per_month", F.lit(0.0)) < LEAST_COMMITS, "commit_freq")
        .when(F.coalesce("contributors_count", F.lit(0)) < LEAST_CONTRIBUTORS, "contributors")
        .when(F.coalesce("test_file_count", F.lit(0)) < 2, "no_tests")
    )
    return rows.withColumn("drop_reason", reason)


def reason_v2(rows: DataFrame, least_days: float = LEAST_DAYS, least_contributors: int = LEAST_CONTRIBUTORS, commits_over: float = LEAST_COMMITS) -> DataFrame:
    """drop_reason in the order lifetime, contributors, commits (strictly more, unrounded), tests (one file); null for rows that stay."""
    per_month = commits_per_month_v2(F.coalesce("total_commits", F.lit(0)), F.col("lifetime_days"))
    reason = (
        F.when(F.coalesce("lifetime_days", F.lit(0)) < least_days, "lifetime")
        .when(F.coalesce("contributors", F.lit(0)) < least_contributors, "contributors")
        .when(~(per_month > commits_over), "commit_freq")
        .when(F.coalesce("test_file_count", F.lit(0)) < 1, "no_tests")
    )
    return rows.withColumns({"per_month": per_month, "drop_reason": reason})


def drop_counts(rows: DataFrame) -> DataFrame:
    """Rows by reason, `keep` for those that stay."""
    return rows.groupBy(F.coalesce("drop_reason", F.lit("keep")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))
