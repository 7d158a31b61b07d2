"""Empty tables and benchmarks, nulls, repeats and clashing names at the operators' tables."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F

from plumbline.llm import decontam, pii, tokencount, tokenout, warc

NONE = hashlib.sha256(b"").hexdigest()


def test_personal_data_of_tables(spark):
    text = "mail a@b.co"
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, r.n_email, r.spans) for r in pii.find_personal_data(docs).collect()), key=str)
    assert got == [(1, 1, "email:5:11"), (1, 1, "email:5:11"), (2, 0, ""), (None, 0, "")]
    assert {r.base_sha256 for r in pii.find_personal_data(docs.where("text is null or text = ''")).collect()} == {NONE}
    assert pii.find_personal_data(docs.where("false")).count() == 0


def test_account_numbers_and_addresses(spark):
    found = pii.find("see https://a.b/c?d=1, IBAN: GB82 WEST 1234 5698 7654 32; account no: 12345678 and password is secret")
    assert [k for _, _, k in found] == ["url", "iban", "account"]
    assert pii.find("IBAN GB83 WEST 1234 5698 7654 32") == [] and pii.find("token of 123456") == []


def test_archive_of_empty_and_of_hot_payloads(spark, tmp_path):
    hot = "<p>" + "y" * 3000
    rows = [(i, "u", hot if i % 3 else f"{i} " * 600, "mine") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha256 string")
    warc.write_archive(pages.repartition(7), str(tmp_path / "w"))
    got = warc.digest(spark, str(tmp_path / "w"))
    kinds = {(r.record_type, r.refers_to): r.n for r in got.groupBy("record_type", "refers_to").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("response", None): 101, ("revisit", 299): 199}
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 101
    assert {bytes(r.payload) for r in warc.read_archive(spark, str(tmp_path / "w")).where("page_id = 1").collect()} == {hot.encode()}
    warc.write_archive(pages.where("false"), str(tmp_path / "e"))
    assert warc.digest(spark, str(tmp_path / "e")).count() == 0


def test_damaged_payloads_are_told(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), str(tmp_path / "w"))
    stored = spark.read.parquet(str(tmp_path / "w/payloads")).collect()
    spark.createDataFrame([(stored[0].sha256, b"other")], "sha256 string, payload binary").write.parquet(str(tmp_path / "d/payloads"))
    spark.read.parquet(str(tmp_path / "w/records")).write.parquet(str(tmp_path / "d/records"))
    assert warc.digest(spark, str(tmp_path / "d")).first().payload_bytes is None
    assert not warc.read_archive(spark, str(tmp_path / "d")).first().verified


def test_leaks_without_documents_or_items(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (None, None, "x")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([("1", "a b"), (None, "b c"), ("", "q"), ("2", None)], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.leak_digest(decontam.find_leaks(docs, bench)).collect()}
    assert got == {1: (3, 3, 2, True), None: (0, 0, 0, False)}
    none = decontam.leak_digest(decontam.find_leaks(docs, bench.where("false")))
    assert {(r.n_hit, r.items_sha256) for r in none.collect()} == {(0, NONE)}
    assert decontam.find_leaks(docs.where("false"), bench).count() == 0


def test_counts_and_lookups(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(5000)], "doc_id long, text string")
    assert tokencount.count_tokens(docs.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    tokenout.write_ids(docs, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    found = tokenout.lookup(spark, str(tmp_path / "t"), [77, 4999])
    assert sorted(r.doc_id for r in found.collect()) == [77, 4999]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan
