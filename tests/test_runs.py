"""Sources, manifests, lineage and reports."""

import hashlib
import json
from datetime import datetime

import pytest

from plumbline.operators import judges
from plumbline.sources import jsonl, runs
from plumbline.sources.lines import malformed, numbered_records


def test_strict_records(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    (tmp_path / "r.jsonl").write_text('{"k": "a", "schema_version": "v1"}\n\n{"k": "b", "schema_version": "v1"\n{"k": "c", "schema_version": "v1"}\n')
    schema = "k string, schema_version string"
    assert [(r.line, r.text) for r in malformed(spark, path, schema).collect()] == [(3, '{"k": "b", "schema_version": "v1"')]
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        jsonl.read(spark, path, schema).collect()
    for name, lines, error in (("none", "\n", "no records"), ("twice", '{"k": "a"}\n{"k": "a"}\n', "duplicate_key"), ("bare", '{"k": ""}\n', "no_key")):
        (tmp_path / name).write_text(lines)
        with pytest.raises(ValueError, match=error):
            jsonl.read_checked(spark, str(tmp_path / name), schema, "k")
    (tmp_path / "good").write_text('{"k": "a", "schema_version": "v1"}\n{"k": "b", "schema_version": "v2"}\n')
    assert jsonl.read_checked(spark, str(tmp_path / "good"), schema, "k").count() == 2
    with pytest.raises(ValueError, match="schema_version: b"):
        jsonl.read_checked(spark, str(tmp_path / "good"), schema, "k", "v1")
    numbered = numbered_records(spark, str(tmp_path / "good"), schema)
    assert [r.k for r in jsonl.prefix(numbered, "ordinal", 1).collect()] == ["a"]


def test_manifests_and_states(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    manifest = {"status": "prepared", "pairs": 3, "note": "é"}
    runs.write_manifest(spark, path, manifest)
    assert runs.read_manifest(spark, path) == manifest
    with pytest.raises(FileExistsError):
        runs.write_manifest(spark, path, manifest)
    assert runs.advance(runs.advance(manifest, "predicted"), "evaluated")["status"] == "evaluated"
    with pytest.raises(ValueError, match="cannot become"):
        runs.advance(manifest, "evaluated")
    runs.refuse_collision(["/a/b"], ["/a/c"])
    for out in ("/a/c", "/a/c/d", "file:/a/"):
        with pytest.raises(ValueError, match="collides"):
            runs.refuse_collision([out], ["/a/c"])
    assert runs.run_id("nli", datetime(2026, 1, 2, 3, 4, 5)).startswith("nli-20260102T030405Z-")


def test_protocol_lineage_and_preflight():
    runs.check_protocol({"a": 1, "b": 2}, {"a": 1})
    with pytest.raises(ValueError, match="settings differ"):
        runs.check_protocol({"a": 1}, {"a": 1, "b": 2})
    with pytest.raises(ValueError, match="x"):
        runs.check_lineage({"x": "1"}, {"x": "2"})
    reference = {"status": "complete", "arguments": {"length": 2048}, "inputs": {"t": "h", "u": "i"}, "model_fingerprint": "f"}
    runs.preflight(reference, {"length": 2048}, {"t": "h"}, "f")
    for change in ({"status": "failed"}, {"model_fingerprint": "g"}, {"inputs": {"t": "j"}}, {"arguments": {}}):
        with pytest.raises(ValueError):
            runs.preflight(reference | change, {"length": 2048}, {"t": "h"}, "f")


def test_hashes_of_files_and_models(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"a\r\nb\rc\n\xff")
    assert runs.file_hash(spark, str(tmp_path / "f.txt")) == hashlib.sha256(b"a\r\nb\rc\n\xff").hexdigest()
    assert runs.file_hash(spark, str(tmp_path / "f.txt"), any_line_ends=True) == hashlib.sha256(b"a\nb\nc\n\xff").hexdigest()
    model = tmp_path / "model"
    model.mkdir()
    (model / "config.json").write_text("{}")
    with pytest.raises(ValueError, match="weights"):
        runs.model_fingerprint(spark, str(model))
    (model / "w.safetensors").write_bytes(b"1")
    first = runs.model_fingerprint(spark, str(model))
    (model / "README.md").write_text("x")
    (model / "SHA256SUMS.txt").write_text("x")
    assert runs.model_fingerprint(spark, str(model)) == first and first.startswith("local-sha256:")
    (model / "w.safetensors").write_bytes(b"2")
    assert runs.model_fingerprint(spark, str(model)) != first


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("é", 0.123456), ("b", None)], "name string, value double")
    jsonl.write_csv_report(rows, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfname,value\n")
    assert runs.report_text(rows, ["name"]) == "b: -\né: 0.1235\n"
    summary = judges.run_summary(spark.createDataFrame([(1, "supported", True, 0.5)], "pair_id int, label string, review_flag boolean, score double"))
    manifest = runs.run_manifest(summary, "r", "nli", {"input": "h"}, threshold=0.5)
    assert manifest["label_counts"] == {"supported": 1} and manifest["pairs"] == 1 and json.loads(json.dumps(manifest)) == manifest


def test_suites_tell_how_far_they_came(spark, tmp_path):
    assert runs.write_suite(spark, str(tmp_path / "ok"), {"one": lambda: None})["status"] == "complete"
    with pytest.raises(ZeroDivisionError):
        runs.write_suite(spark, str(tmp_path / "bad"), {"one": lambda: None, "two": lambda: 1 / 0, "three": lambda: None})
    assert runs.read_manifest(spark, str(tmp_path / "bad")) == {"status": "failed", "steps": {"one": "complete", "two": "failed"}}
