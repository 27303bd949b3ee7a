"""Which repositories declare evaluation packages in their dependency files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..sources import snapshots
from .state import upserted

OUTPUT = ("category", "full_name", "frameworks", "dep_files")


def categorised(order: str = "seq", **tables: DataFrame) -> DataFrame:
    """One table of candidates with their category, in the order given; category_seq and row_seq keep the order for last-wins lookups.

    row_seq is the column `order` of a table, a number that tells its rows' order of arrival; a table without it has rows of equal order,
    which are then told apart by branch, so that nothing depends on the partitioning.
    """
    out = None
    for seq, (category, table) in enumerate(tables.items()):
        row_seq = F.coalesce(F.col(order).cast("long") if order in table.columns else F.lit(None).cast("long"), F.lit(0).cast("long"))
        branch = C.or_default(F.col("default_branch"), "main")
        rows = table.select(F.lit(category).alias("category"), F.lit(seq).alias("category_seq"), row_seq.alias("row_seq"), "full_name", branch.alias("branch"))
        out = rows if out is None else out.unionByName(rows)
    return out


def root_files(spark: SparkSession, repositories: DataFrame, files: DataFrame) -> DataFrame:
    """The dependency files that repositories have at their root: fixed names times repositories, looked up in the files."""
    names = F.explode(F.array(*map(F.lit, K.ROOT_DEP_FILES))).alias("path")
    wanted = repositories.select("full_name", "branch", names)
    return snapshots.fetched(wanted, files).where(F.col("content").isNotNull())


def matches(files: DataFrame, packages: dict[str, str] = K.EVALUATOR_PACKAGES) -> DataFrame:
    """(full_name, path, framework) for each package that a file names. Patterns are literals of one projection, compiled once, not a join."""
    found = F.array_compact(F.array(*(F.when(C.depends_on(F.col("content"), p), F.lit(n)) for n, p in packages.items())))
    return files.select("full_name", "path", F.explode(found).alias("framework"))


def match_map(found: DataFrame) -> DataFrame:
    """(full_name, matches): a map from framework to its files."""
    by = found.groupBy("full_name", "framework").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return by.groupBy("full_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("framework", "paths")))).alias("matches"))


def summarised(found: DataFrame) -> DataFrame:
    """(full_name, frameworks, dep_files): sorted different names, joined by commas."""
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return found.groupBy("full_name").agg(text("framework").alias("frameworks"), text("path").alias("dep_files"))


def root_check(spark: SparkSession, candidates: DataFrame, files: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all, fresh): verdicts of all candidates, cached ones replayed with the category of the state, and the new state rows.

    A repository in two categories is checked in the first; its second row replays that verdict, so that it is there twice.
    """
    order = Window.partitionBy("full_name").orderBy("category_seq", "row_seq", "branch")
    todo = candidates.join(state.select("full_name"), "full_name", "left_anti").withColumn("rn", F.row_number().over(order)).where("rn = 1")
    have = root_files(spark, todo, files)
    some = have.groupBy("full_name").agg(F.count(F.lit(1)).alias("n_files"))
    fresh = todo.join(some, "full_name", "left").join(summarised(matches(have)), "full_name", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    no_deps = F.when(F.coalesce("n_files", F.lit(0)) == 0, True).alias("no_deps")
    fresh = fresh.select("full_name", "category", empty("frameworks"), empty("dep_files"), no_deps, F.lit(None).cast("boolean").alias("deep_checked"))
    known = upserted(state.select(*fresh.columns), fresh)
    verdict = F.when(F.coalesce("no_deps", F.lit(False)), "no_deps").when(F.coalesce("frameworks", F.lit("")) != "", "hit").otherwise("none")
    return candidates.select("full_name").join(known, "full_name").withColumn("verdict", verdict), fresh


def hits(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("verdict = 'hit'").select(*OUTPUT).orderBy("category", "full_name")


def without_files(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("verdict = 'no_deps'").select("category", "full_name").orderBy("category", "full_name")


def deep_check(listed: DataFrame, state: DataFrame, branches: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """New state rows of listed repositories (full_name, category) that were not deep-checked: dependency files at any depth.

    No tree or no such file: only deep_checked is set, no_deps stays. Files without a match: their paths in the tree's order are
    kept and no_deps is not, so that the repository is in neither output.
    """
    done = state.where(F.coalesce("deep_checked", F.lit(False))).select("full_name")
    todo = listed.select("full_name", "category").join(done, "full_name", "left_anti").join(branches, "full_name", "left")
    todo = todo.withColumn("branch", C.or_default(F.col("branch"), "main"))
    paths = entries.where((F.col("type") == "blob") & C.is_dep_file(F.col("path"))).select("full_name", "branch", "path", *([] if "seq" not in entries.columns else ["seq"]))
    wanted = todo.select("full_name", "branch").join(paths, ["full_name", "branch"])
    order = F.struct("seq", "path") if "seq" in paths.columns else F.struct("path")
    listed_paths = wanted.groupBy("full_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["path"]), ",").alias("all_paths"))
    found = summarised(matches(snapshots.fetched(wanted.select("full_name", "branch", "path"), files).where(F.col("content").isNotNull())))
    old = state.select("full_name", F.col("frameworks").alias("old_frameworks"), F.col("dep_files").alias("old_files"), F.col("no_deps").alias("old_no_deps"), F.col("category").alias("old_category"))
    rows = todo.join(listed_paths, "full_name", "left").join(found, "full_name", "left").join(old, "full_name", "left")
    none = F.col("all_paths").isNull()
    return rows.select(
        "full_name",
        F.when(none, F.coalesce("old_category", "category")).otherwise(F.col("category")).alias("category"),
        F.when(none, F.coalesce("old_frameworks", F.lit(""))).otherwise(F.coalesce("frameworks", F.lit(""))).alias("frameworks"),
        F.when(none, F.coalesce("old_files", F.lit(""))).otherwise(F.coalesce("dep_files", "all_paths")).alias("dep_files"),
        F.when(none, F.col("old_no_deps")).alias("no_deps"),
        F.lit(True).alias("deep_checked"),
    )


def rebuilt(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both outputs from the state alone, one row for each repository."""
    some = F.coalesce("frameworks", F.lit("")) != ""
    found = state.where(some).select(*OUTPUT).orderBy("category", "full_name")
    bare = F.coalesce("no_deps", F.lit(False)) & (F.coalesce("dep_files", F.lit("")) == "")
    return found, state.where(~some & bare).select("category", "full_name").orderBy("category", "full_name")
