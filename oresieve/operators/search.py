"""From search hits to candidates: exclusion, first-wins deduplication with the terms that matched, and projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K

ORDER = ("term_seq", "page", "pos")


def framework_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(K.FRAMEWORK_QUERIES)), "term_seq int, term string")


def application_queries(spark: SparkSession, stars: int = K.LEAST_STARS, pushed: str = K.PUSHED_AFTER) -> DataFrame:
    """(term_seq, term, query): a query for each keyword, quoted, with its qualifiers."""
    terms = spark.createDataFrame(list(enumerate(K.APPLICATION_TERMS)), "term_seq int, term string")
    return terms.withColumn("query", C.search_query(F.col("term"), stars, pushed))


def qualified(hits: DataFrame, stars: int = K.LEAST_STARS, pushed: str = K.PUSHED_AFTER, language: str = K.LANGUAGE) -> DataFrame:
    """What a search engine's qualifiers keep, as predicates on snapshots; both bounds are exclusive."""
    i = "item."
    return hits.where((F.col(i + "stargazers_count") > stars) & (F.col(i + "language") == language) & (F.substring(i + "pushed_at", 1, 10) > pushed))


def excluded(hits: DataFrame, known: DataFrame, name: str = "full_name") -> DataFrame:
    """Hits whose repository is not in a list, in any case; null names stay. Spark broadcasts the list if it is small."""
    listed = known.select(F.lower(F.col(name)).alias("known")).distinct()
    return hits.join(listed, F.lower("item.full_name") == F.col("known"), "left_anti")


def active(hits: DataFrame, flags=("fork", "archived", "disabled")) -> DataFrame:
    """Hits without these flags; a missing flag is not set. Before deduplication another term's hit may still bring the repository in."""
    keep = F.lit(True)
    for flag in flags:
        keep = keep & ~F.coalesce(F.col(f"item.{flag}"), F.lit(False))
    return hits.where(keep)


def first_wins(hits: DataFrame, separator: str = ", ", matched: str = "matched_frameworks") -> DataFrame:
    """One row for each full_name: its first hit by term, page and position, and all its terms, sorted. One map-side combined aggregation."""
    grouped = hits.groupBy(F.col("item.full_name").alias("full_name")).agg(
        F.min_by("item", F.struct(*ORDER)).alias("item"),
        F.array_join(F.array_sort(F.collect_set("term")), separator).alias(matched),
        F.min(F.struct(*ORDER)).alias("seq"),
    )
    return grouped


def candidates(found: DataFrame, matched: str = "matched_frameworks") -> DataFrame:
    """Hits as flat rows under the names that exports have; `seq` keeps the order of arrival for stable sorts."""
    item = lambda name: F.col(f"item.{name}")
    return found.select(
        "full_name",
        item("html_url").alias("html_url"),
        item("clone_url").alias("clone_url"),
        item("description").alias("description"),
        matched,
        item("stargazers_count").alias("stars"),
        item("forks_count").alias("forks"),
        item("language").alias("language"),
        C.joined(item("topics")).alias("topics"),
        item("open_issues_count").alias("open_issues"),
        item("size").alias("size_kb"),
        item("default_branch").alias("default_branch"),
        item("created_at").alias("created_at"),
        item("updated_at").alias("updated_at"),
        item("pushed_at").alias("pushed_at"),
        item("pushed_at").alias("latest_default_branch_commit_date"),
        item("fork").alias("fork"),
        item("archived").alias("archived"),
        item("disabled").alias("disabled"),
        item("license.spdx_id").alias("license"),
        "seq",
    )
