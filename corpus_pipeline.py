"""Preparation of a training corpus in five stages, each over all that the one before kept.

Defined results: rows without text or without a letter go with the first stage; rows that share an id and differ in text
are documents of their own; rows without an id stay (near duplicates among them too, as they can't be told apart);
repeated rows are one document; a document whose source is null is of a source of its own; empty tables give an empty
result; extra columns, whatever their names, are kept, but that the last stage's size, text_crc32, shard and slot take the
place of columns of these names; texts of any length are worked on whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontaminate, language, mixing, near_text, sharding
from tidewater.storage import stash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; the model learns from the training rows of docs."""
    return language.known_language(docs, language.fit(language.training_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash with ball hashing over five-word shingles."""
    return near_text.one_of_each(docs)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out of the texts; documents that are mostly benchmark go."""
    return decontaminate.spans_removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return sharding.placed_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_texts),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Fingerprints, fitted models and pseudorandom permutations are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
