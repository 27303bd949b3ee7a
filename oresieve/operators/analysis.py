"""Test functions of source files and which of them call real models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.source_code import APPLICATION_MODULES, ExtractTests

KEYS = ("full_name", "path")


def test_files(files: DataFrame) -> DataFrame:
    """Fetched test files outside vendored folders."""
    return files.where(C.is_test_file(F.col("path")) & ~C.is_vendored(F.col("path")) & (F.col("status") == 200))


def extracted(files: DataFrame, modules: list[str] | None = None, partitions: int | None = None, strict: bool = False) -> DataFrame:
    """A row for each test function of each file: one call of the table function a file, one tree for all that is asked of it.

    strict: a file with a call that can't be written as text has no tests. partitions deals files out by path, so that a repository with very many files is not one task's work.
    """
    modules = APPLICATION_MODULES if modules is None else modules
    rows = files.select(*KEYS, "content")
    if partitions:
        rows = rows.repartition(partitions, *KEYS)
    return rows.lateralJoin(ExtractTests(F.col("content").outer(), F.array(*map(F.lit, modules)), F.lit(strict))).drop("content")


def classified(tests: DataFrame, modules: list[str] | None = None) -> DataFrame:
    """Adds is_llm: the file imports a tracked module, the function's text names no stand-in, and some call or attribute names a model call."""
    modules = APPLICATION_MODULES if modules is None else modules
    gate = F.arrays_overlap("imports", F.array(*map(F.lit, modules)))
    is_llm = gate & ~C.names_mock(F.col("source")) & F.exists("call_segments", C.names_call)
    return tests.withColumn("is_llm", F.coalesce("parse_ok", F.lit(False)) & F.coalesce(is_llm, F.lit(False)))


def repository_counts(repositories: DataFrame, files: DataFrame, tests: DataFrame) -> DataFrame:
    """test_file_count, test_function_count and llm_test_count for every repository, 0 without files; clone_status is ok."""
    per_file = files.groupBy("full_name").agg(F.count_distinct("path").alias("test_file_count"))
    per_test = tests.where("parse_ok").groupBy("full_name").agg(F.count(F.lit(1)).alias("test_function_count"), F.count_if("is_llm").alias("llm_test_count"))
    joined = repositories.join(per_file, "full_name", "left").join(per_test, "full_name", "left")
    return joined.fillna(0, ["test_file_count", "test_function_count", "llm_test_count"]).withColumn("clone_status", F.lit("ok"))


def failed_clone(repositories: DataFrame, error: str | None = None) -> DataFrame:
    """Repositories whose files could not be had; with a column of error texts, the first 200 characters of each."""
    zero = {n: F.lit(0).cast("long") for n in ("test_file_count", "test_function_count", "llm_test_count")}
    rows = repositories.withColumn(error, C.short_error(F.col(error))) if error else repositories
    return rows.withColumns(zero | {"clone_status": F.lit("failed")})


def totals(listed: DataFrame, repository: str = "framework") -> DataFrame:
    """(tests, repositories): the tests found and in how many different repositories, as a run tells at its end."""
    return listed.agg(F.count(F.lit(1)).alias("tests"), F.count_distinct(repository).alias("repositories"))


def llm_tests(tests: DataFrame, repository: str = "repo") -> DataFrame:
    """(repo, file, test_function) of the tests that call models."""
    return tests.where("is_llm").select(F.col("full_name").alias(repository), F.col("path").alias("file"), F.col("name").alias("test_function"))


def tagged(tests: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds tags: the sorted names of the patterns that a test's source matches. An option of its own; no shipped result follows it."""
    found = F.array_compact(F.array(*(F.when(F.col("source").rlike(p), F.lit(n)) for n, p in patterns.items())))
    return tests.withColumn("tags", F.array_join(F.array_sort(found), ","))
