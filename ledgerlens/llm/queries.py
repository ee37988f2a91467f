"""Queries and SQL of the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, extraction, hmm, licenses, mixing, quality, simhash, syncmers, urlfilter, warc
from .common import materialize


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _bucket(of: str, n: int) -> Column:
    return F.crc32(F.col(of).cast("string").cast("binary")) % n


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.pages_through_archives(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality.train(docs, labels, training=_bucket("doc_id", 3) != 1)
    scored = quality.score(docs, model)
    held = F.coalesce(_bucket("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(simhash.fingerprints(_read(spark, sf_dir, "documents")), "fingerprints")
    joined = simhash.near_duplicates(prints)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    return urlfilter.judge(_read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("licenses", ",").alias("licenses"),
        F.size("matches").cast("long").alias("n_windows"),
    )


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm.score(_read(spark, sf_dir, "documents"), training=_bucket("doc_id", 5) != 1)
    held = F.coalesce(_bucket("doc_id", 5) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_urlfilter": op7_urlfilter,
    "op8_licenses": op8_licenses,
    "op9_hmm": op9_hmm,
    "op10_extraction": op10_extraction,
}
