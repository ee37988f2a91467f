"""A training corpus from the documents table: quality, near duplicates, benchmark passages, then the mix.

Each stage is (name, function of spark, docs and the folder of the tables); its result is written as Parquet and
read again as the next stage's docs. Columns beyond those of documents go through all stages but the last.

Null texts count as empty. Every row is a document, also where rows share a doc_id or have none: the second stage keeps
one row of each group of near copies (smallest doc_id, null last), whatever its id. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, mixing, neardup, quality
from ledgerlens.llm.common import materialize


def _unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column begins with it."""
    while any(c.lower().startswith(name) for c in columns):
        name = f"_{name}"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _unused("quality_score", docs.columns)
    return quality.score(docs, model, keep=docs.columns, name=name).where(F.col(name) >= 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, Jaccard of 0.8 or more): the one with the smallest id."""
    return neardup.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    prefix = _unused("scan_", docs.columns)
    found = decontamination.scan(docs, benchmark, keep=docs.columns, prefix=prefix)
    return found.where(F.size(f"{prefix}hit_words") == 0).select(*[found[f"`{c}`"] for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, by DataFrame operations only; documents weigh by the mix's own default."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "epochs", "taken")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources to target weights", mix_sources),
]

#: Boosted trees and XXH64 fingerprints are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
