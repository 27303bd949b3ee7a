"""The corpus pipeline: toxic and bad documents go, near-duplicates are reduced to one, sources are mixed, and texts are encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oresieve.llm import bpe, mix, quality, simhash, toxicity
from oresieve.llm.shared import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: keeps documents that score under its threshold; the classifier learns from labels of documents of this input.

    Null and empty texts score 0 and stay; repeated rows share their fate; an empty table gives an empty one.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: keeps documents that pass the base rules and the suffix arrays' verdict.

    Null and empty texts have no words and go; repeated rows share their fate; an empty table gives an empty one.
    """
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: keeps the document with the smallest id of each group, one row of it if the id is repeated.

    Rows without an id all stay; texts without words are one group; an empty table gives an empty one.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document as often as the mix takes it.

    A null source is a source; texts without words are taken as often as their source's whole epochs; an empty table gives an empty one.
    """
    return mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the ids of each row's text (unsigned 32-bit, little-endian), checked to decode to it.

    A null text has no ids; repeated rows stay; an empty table gives an empty one.
    """
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    exact = (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact")
    return out.select("doc_id", "source", n, "ids", F.sha2("ids", 256).alias("ids_sha256"), exact)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("simhash", drop_near_duplicates),
    ("mix", mix_sources),
    ("bpe", encode),
]
#: No SQL has the classifier, XXH64 fingerprints or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read by the next, then removed."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
