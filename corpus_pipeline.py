"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, packing, simhash, suffix
from plumbline.runtime import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share this part of their shingles of five words, or more.
SHINGLE, SIMILARITY = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; where lang is NULL it is filled in."""
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.predict(docs.select(*COLUMNS), model, keep_text=True)
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= langid.least_score(docs.where(langid.held_out()), model)))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the one with the smallest doc_id."""
    docs = docs.select(*COLUMNS)
    return simhash.keep_one(docs, simhash.similar_groups(docs, SHINGLE, SIMILARITY)).select(*COLUMNS)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes and more that start in two places of the corpus."""
    marked = docs.select(*COLUMNS, F.col("text").isNull().alias("_no_text"))
    cut = suffix.remove_repeats(marked, whole_characters=True)
    text = F.when(~F.col("_no_text"), F.col("kept").cast("string"))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(F.size("removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens."""
    return packing.pack(packing.pieces(docs)).drop("_th")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal), ("source_mix", source_mix), ("best_fit_packing", packed)]

#: Kernel scores, XXH64 majorities and byte-pair merges have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
