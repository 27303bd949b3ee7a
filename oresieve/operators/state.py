"""Resumable state: keyed tables in which the last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import snapshots


def upserted(old: DataFrame, new: DataFrame, key: str = "full_name") -> DataFrame:
    """Old rows without those that new ones replace, and the new ones; keys are unique in each. Columns that one side lacks are null there.

    One full outer join, which shuffles both by key once.
    """
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    kinds = {f.name: f.dataType for f in [*new.schema.fields, *old.schema.fields]}

    def whole(table: DataFrame, name: str) -> DataFrame:
        cells = (F.col(c) if c in table.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns)
        return table.select(F.col(key).alias(f"{name}_key"), F.struct(*cells).alias(name))

    both = whole(old, "old").join(whole(new, "new"), F.col("old_key").eqNullSafe(F.col("new_key")), "full_outer")
    row = F.when(F.col("new").isNotNull(), F.col("new")).otherwise(F.col("old"))
    return both.select(row.alias("row")).select(*(F.col(f"row.{c}") for c in columns))


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last by order."""
    latest = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("rn", F.row_number().over(latest)).where("rn = 1").drop("rn")


def remaining(rows: DataFrame, *done: DataFrame, key: str = "full_name") -> DataFrame:
    """Rows whose key none of the tables has; keys match by case."""
    for d in done:
        rows = rows.join(d.select(key).distinct(), key, "left_anti")
    return rows


class State:
    """A state table of versions in a folder: each save writes the next version whole, and the last finished one is read.

    A version without its success mark is left over from a run that broke off and is never read. The driver keeps no rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "full_name"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _folder(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _version(self) -> int:
        fs, at = self._folder()
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n[1:]) for n in names if n[:1] == "v" and snapshots.exists(self.spark, f"{self.path}/{n}/_SUCCESS")), default=0)

    def load(self) -> DataFrame:
        return snapshots.table(self.spark, f"{self.path}/v{self._version()}", self.schema)

    def save(self, new: DataFrame) -> DataFrame:
        """Upserts rows and returns the new state."""
        target = f"{self.path}/v{self._version() + 1}"
        upserted(self.load(), new, self.key).write.mode("overwrite").parquet(target)
        return self.load()

    def reset(self) -> None:
        """A fresh start: all versions go."""
        fs, at = self._folder()
        fs.delete(at, True)
