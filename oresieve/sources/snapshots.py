"""Readers of landed snapshots: search hits, CSV tables, trees, files and state."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def or_empty(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    """read(path), or an empty table of the schema where the path is missing."""
    return read(path) if exists(spark, path) else spark.createDataFrame([], schema)


def search_hits(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of search results as JSON lines; fields that are missing are null."""
    return or_empty(spark, path, schemas.SEARCH_HITS, spark.read.schema(schemas.SEARCH_HITS).json)


def csv_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, all columns text, empty cells '' as they are; quoted line breaks, quotes and commas are kept."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    table = reader.option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return table.select(*(F.col(f"`{c}`") for c in columns)) if columns else table


def csv_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return or_empty(spark, path, schema, lambda p: csv_table(spark, p, columns))


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table of a known schema, or an empty one."""
    return or_empty(spark, path, schema, spark.read.schema(schema).parquet)


def dependency_state(spark: SparkSession, path: str) -> DataFrame:
    """The dependency checks' JSON state file, `processed` by full_name, as rows; missing flags are null, a missing file is an empty table."""
    kept = "processed map<string, struct<category:string, frameworks:string, dep_files:string, no_deps:boolean, deep_checked:boolean>>"
    state = or_empty(spark, path, kept, spark.read.schema(kept).option("multiLine", True).json)
    return state.select(F.explode("processed").alias("full_name", "row")).select("full_name", "row.*")


def search_state(spark: SparkSession, path: str) -> DataFrame:
    """The search's JSON state file as one row: terms done, repositories done, candidates (item, frameworks) by full_name, and drop counts.

    A missing file is a row of nothing done.
    """
    counts = "struct<kept:bigint, dropped_lifetime:bigint, dropped_contributors:bigint, dropped_commit_freq:bigint, dropped_no_tests:bigint>"
    kept = f"completed_search_terms array<string>, processed_repos array<string>, candidates map<string, struct<item:{schemas.HIT_ITEM}, frameworks:array<string>>>, stats {counts}"
    if exists(spark, path):
        return spark.read.schema(kept).option("multiLine", True).json(path)
    return spark.createDataFrame([([], [], {}, (0, 0, 0, 0, 0))], kept)


def tree_entries(responses: DataFrame) -> DataFrame:
    """Entries of tree listings (full_name, branch, tree array of type and path); a listing without a tree has none."""
    return responses.select("full_name", "branch", F.explode("tree").alias("e")).select("full_name", "branch", "e.type", "e.path")


def walk(spark: SparkSession, root: str, full_name: str) -> DataFrame:
    """The files of a checked-out repository, without vendored folders: (full_name, branch, path, status, content).

    Paths are relative to the root. Contents are decoded as UTF-8 with U+FFFD for bad bytes. Paths are listed without contents first, and
    only folders that are not vendored are read; the driver gets the names of these folders of one repository.
    """
    base = root.rstrip("/").removeprefix("file:")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    inside = F.regexp_replace("path", f"^(file:)?/*\\Q{base.lstrip('/')}\\E/", "")
    folders = listed.where(~C.is_vendored(inside)).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    names = sorted(r.folder for r in folders.collect())
    if not names:
        return spark.createDataFrame([], schemas.FILES)
    # a folder's name is no pattern
    found = spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", n) for n in names])
    path = F.regexp_replace("path", f"^(file:)?/*\\Q{base.lstrip('/')}\\E/", "")
    files = found.select(F.lit(full_name).alias("full_name"), F.lit(None).cast("string").alias("branch"), path.alias("path"), F.lit(200).alias("status"), "content")
    return files.where(~C.is_vendored(F.col("path"))).withColumn("content", C.valid_text(F.col("content")))


def capped(hits: DataFrame, pages: int = K.MOST_PAGES, page_rows: int = K.PAGE_ROWS) -> DataFrame:
    """The first pages of each term. Spark pushes the limit below the shuffle of the window."""
    order = Window.partitionBy("term").orderBy("page", "pos")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pages * page_rows).drop("rank")


def fetched(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Contents of wanted (full_name, branch, path); null where the file was not fetched with status 200."""
    ok = files.where("status = 200").select("full_name", "branch", "path", "content")
    return wanted.join(ok, ["full_name", "branch", "path"], "left")


def contributor_counts(contributors: DataFrame, cap: int | None = None) -> DataFrame:
    """Contributors of each repository; with a cap as of one page."""
    n = F.count(F.lit(1))
    return contributors.groupBy("full_name").agg((F.least(n, F.lit(cap)) if cap else n).alias("contributors"))


def link_counts(responses: DataFrame, name: str, page=C.last_page) -> DataFrame:
    """Counts read off a Link header with one row a page, else the rows of the answer; no data (404, 409, 451, 204) counts 0.

    page: how the number is read off the header, C.last_page or C.last_page_v1.
    """
    missing = F.coalesce(F.col("status"), F.lit(200)).isin(404, 409, 451, 204)
    count = F.when(missing, F.lit(0)).otherwise(F.coalesce(page(F.col("link_header")), F.col("body_len"), F.lit(0)))
    return responses.select("full_name", count.cast("long").alias(name))


def latest_commit_dates(commits: DataFrame) -> DataFrame:
    """The date of the first listed commit of each repository by `pos`, which need not be the latest; of listings without positions the latest.

    A first commit without a date gives null.
    """
    date = F.col("committer_date")
    first = F.min_by(F.struct(date), "pos")["committer_date"] if "pos" in commits.columns else F.max(date)
    return commits.groupBy("full_name").agg(first.alias("latest_default_branch_commit_date"))


def default_branches(listing: DataFrame) -> DataFrame:
    """One branch for each repository: of several rows the last by (category_seq, row_seq); null counts as main."""
    last = F.max_by(C.or_default(F.col("default_branch"), "main"), F.struct("category_seq", "row_seq", C.or_default(F.col("default_branch"), "main").alias("branch")))
    return listing.groupBy("full_name").agg(last.alias("branch"))
