"""Documents of extracted tests, a text for each repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def _body(order: str) -> Column:
    """The sources in order, each after a heading where the file changes."""
    rows = F.array_sort(F.collect_list(F.struct(order, "heading", "source")))
    return F.array_join(F.transform(rows, lambda r: F.concat(r["heading"], r["source"], F.lit("\n\n"))), "")


def headed(tests: DataFrame, repository: str, file: str, order: str) -> DataFrame:
    """Adds heading: a file's name where it differs from the row's before, else empty."""
    before = F.lag(file).over(Window.partitionBy(repository).orderBy(order))
    changed = ~before.eqNullSafe(F.col(file))
    return tests.withColumn("heading", F.when(changed, F.concat(F.lit("\n# --- "), F.col(file), F.lit(" ---\n\n"))).otherwise(""))


def first_sources(listed: DataFrame, tests: DataFrame) -> DataFrame:
    """Listed tests (full_name, path, name, seq) with the source of the file's first function of that name, in breadth-first order.

    A name that is listed twice gets the same source twice; one that the file lacks is left out.
    """
    first = tests.where("parse_ok").groupBy("full_name", "path", "name").agg(F.min_by("source", "bfs_seq").alias("source"))
    return listed.join(first, ["full_name", "path", "name"]).where(F.coalesce("source", F.lit("")) != "")


def framework_documents(listed: DataFrame) -> DataFrame:
    """(full_name, safe_name, content): the layout that tells how many tests a framework has, from rows (full_name, path, source, seq).

    Tests are grouped by file in the order in which files are first listed.
    """
    by_file = Window.partitionBy("full_name", "path")
    rows = listed.withColumn("order", F.struct(F.min("seq").over(by_file).alias("file_seq"), "path", "seq"))
    name = F.col("full_name")
    head = F.concat(F.lit("# "), name, F.lit("\n# "), F.col("n").cast("string"), F.lit(" test functions with real LLM calls\n# Source: https://github.com/"), name, F.lit("\n\n"))
    grouped = headed(rows, "full_name", "path", "order").groupBy("full_name").agg(F.count(F.lit(1)).alias("n"), _body("order").alias("body"))
    return grouped.select("full_name", C.safe_name(name).alias("safe_name"), F.concat(head, "body").alias("content"))


def application_documents(tests: DataFrame, counts: DataFrame) -> DataFrame:
    """(full_name, safe_name, content): the layout that tells tests and test files; only repositories with a test that calls models.

    counts: (full_name, html_url, test_file_count). Sources are as found, also where names repeat in a file.
    """
    rows = tests.where("is_llm").withColumn("order", F.struct("path", "bfs_seq"))
    grouped = headed(rows, "full_name", "path", "order").groupBy("full_name").agg(F.count(F.lit(1)).alias("n"), _body("order").alias("body"))
    grouped = grouped.join(counts.select("full_name", "html_url", "test_file_count"), "full_name")
    name = F.col("full_name")
    head = F.concat(
        F.lit("# "), name, F.lit("\n# "), F.col("n").cast("string"), F.lit(" LLM-backed test functions across "), F.col("test_file_count").cast("string"),
        F.lit(" test files\n# Source: "), F.coalesce("html_url", F.lit("None")), F.lit("\n"),
    )
    return grouped.select("full_name", C.safe_name(name).alias("safe_name"), F.concat(head, "body").alias("content"))
