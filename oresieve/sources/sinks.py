"""Writers: CSV exports, appended tables, text documents and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C


def export_text(table: DataFrame) -> DataFrame:
    """All columns as the text that exports have: True and False, numbers as Python writes them, null as ''."""

    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = C.flag_text(c)
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = C.number_text(c.cast("string") if isinstance(f.dataType, T.FloatType) else c)  # 32 bits: 0.1, not 0.10000000149011612
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return table.select(*map(cell, table.schema.fields))


def export_csv(table: DataFrame, path: str, columns: list[str] | None = None, order: list | None = None) -> None:
    """One CSV file with a header and all cells quoted, replacing what was there; an empty table gives a header only.

    An export is a report for people: the rows are sorted and written by one task.
    """
    rows = table.orderBy(*order) if order else table
    rows = export_text(rows.select(*(f"`{c}`" for c in columns)) if columns else rows)
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append(table: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table; the header question of appended CSV files does not arise."""
    table.write.mode("append").parquet(path)


def write_json_state(state: DataFrame, path: str) -> None:
    """Rows keyed by full_name as one JSON file, `processed` by full_name, as dependency_state() reads it; null flags are left out."""
    rest = F.struct(*(c for c in state.columns if c != "full_name"))
    entries = F.array_sort(F.collect_list(F.struct("full_name", rest.alias("row"))))
    text = F.to_json(F.struct(F.map_from_entries(entries).alias("processed")), {"ignoreNullFields": "true", "pretty": "true"})
    state.agg(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def folder_names(documents: DataFrame) -> DataFrame:
    """Adds folder: the safe name, with a hash of the full name where several names share it (a/b_c and a_b/c)."""
    names = documents.select("full_name", "safe_name").distinct().groupBy("safe_name").agg(F.count(F.lit(1)).alias("names"))
    mark = F.concat(F.col("safe_name"), F.lit("-"), F.lower(F.hex(F.xxhash64("full_name"))))
    return documents.join(names, "safe_name").withColumn("folder", F.when(F.col("names") > 1, mark).otherwise(F.col("safe_name"))).drop("names")


def write_documents(documents: DataFrame, path: str) -> None:
    """(full_name, safe_name, content): a folder for each document with its text; no document passes through the driver. The writer adds the last newline."""
    if "full_name" in documents.columns:
        documents = folder_names(documents).withColumn("safe_name", F.col("folder"))
    text = F.regexp_replace("content", "\\n\\z", "").alias("value")
    documents.select("safe_name", text).write.mode("overwrite").partitionBy("safe_name").text(path)


def metrics(**counts: DataFrame) -> DataFrame:
    """(metric, value): row counts of several tables, as a table."""
    out = None
    for name, table in counts.items():
        row = table.agg(F.lit(name).alias("metric"), F.count(F.lit(1)).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out
