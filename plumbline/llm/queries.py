"""The operators over the tables, with production parameters, as the queries op1 to op13."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontam, hostrules, htmltext, langid, merkle, mixing, neardup, oracles, pii, secrets, tokencount, tokenout, vectors, warc
from plumbline.llm.runtime import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    model = langid.train(docs.where(~held_out & F.col("lang").isNotNull()))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokencount.over_limit(counts, 2048)


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.digest(spark, path)


def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_digest(decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    tokenout.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenout.digest(tokenout.read_ids(spark, path))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = mixing.token_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return mixing.mix(counts, max_repetition=1.25).select("doc_id", "source", "copy", "block", "n_tokens")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    seven = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tamper={"n_chars": F.when(seven, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_simhash_neardup, op3_token_counts, op4_warc_archive, op5_host_quality, op6_decontamination, op7_token_output, op8_temperature_mixing, op9_main_text, op10_personal_data, op11_vector_codes, op12_merkle_manifest, op13_secrets)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_archive": oracles.OP4, "op5_host_quality": oracles.OP5, "op6_decontamination": oracles.OP6, "op12_merkle_manifest": oracles.OP12}
