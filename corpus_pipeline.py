"""The corpus pipeline: five stages over ``documents``, each by one operator.

Every stage but the last returns the columns of ``documents``; each works on all
that the one before has kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, hostrules, mixing, neardup, tokenout, widedup
from plumbline.llm.runtime import scratch, written

#: The tokens that sources are weighed by are those that are written.
TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a base rule or their host's verdict rejects go."""
    return hostrules.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return neardup.first_of_each(docs, prints_of=widedup.fingerprints, groups_of=widedup.groups)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such go."""
    clean = decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are taken up to 1.25 times; no document is left out."""
    return mixing.mix(docs, mixing.token_rows(docs, public_tokenizers.path(TOKENIZER)), max_repetition=1.25)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids go into ORC files; the rows tell where each document is in them."""
    path = scratch(spark, "token-ids")
    tokenout.write_ids(docs, path, public_tokenizers.path(TOKENIZER))
    return tokenout.digest(tokenout.read_ids(spark, path))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicate removal", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("temperature mixing", temperature_mixing),
    ("token output", token_output),
]

#: SimHash groups and tokenisation have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
