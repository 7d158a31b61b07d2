"""Audit drafts, decisions, and the sets made of them."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit, checks
from plumbline.sources import runs

PAIR = "pair_id int, qid string, source_id string, claim string, claim_start int, claim_end int, gold_label string"


def pairs_of(spark):
    claims = ["(Passage", "Let me know", "It rains", "Follow these steps now", "Wet streets", "2)", "The end"]
    return spark.createDataFrame([(i, "q", "s", c, 0, len(c), ("supported", "conflict", "unsupported")[i % 3]) for i, c in enumerate(claims)], PAIR)


def test_draft_and_decisions(spark):
    pairs = pairs_of(spark)
    nonclaims = pairs.where("pair_id in (0, 1, 3, 5)").select("pair_id")
    reviewed = spark.createDataFrame([(2, "needs_context", "needs_adjudication", "review_and_split"), (6, "eligible", "conflict", "relabel")], "pair_id int, eligibility string, audited string, decision string")
    absent = spark.createDataFrame([(4, "not in any passage")], "pair_id int, note string")
    assert audit.draft_violations(pairs, nonclaims, reviewed, absent).count() == 0
    drafted = audit.draft(pairs, nonclaims, reviewed, absent)
    got = {r.pair_id: r for r in drafted.collect()}
    assert [got[i].reason for i in (0, 1, 3, 5)] == ["citation_marker", "conversation", "heading", "citation_marker"]
    assert (got[4].audited, got[4].decision, got[4].reason) == ("unsupported", "relabel", "not in any passage") and got[6].decision == "relabel"
    told = {r.pair_id: r.action for r in audit.draft_decisions(drafted, pairs.where("pair_id = 4"), pairs.where("pair_id in (4, 6)")).collect()}
    assert told == {0: "exclude_nonclaim", 1: "exclude_nonclaim", 2: "exclude_unresolved", 3: "exclude_nonclaim", 4: "exclude_source_relative", 5: "exclude_nonclaim", 6: "exclude_context_fragment"}
    wrong = audit.draft_violations(pairs, nonclaims, reviewed, spark.createDataFrame([(6, "x"), (99, "y")], "pair_id int, note string"))
    assert {(r.rule, r.key) for r in wrong.collect()} == {("two_decisions", "6"), ("unknown_pair", "99")}


def decisions_of(pairs):
    action = F.when(F.col("pair_id") % 2 == 0, "include").otherwise("exclude_nonclaim")
    return audit.decision_record(pairs, action, F.lit("conflict"), F.lit("seen"), F.array().cast("array<string>"), "by hand")


def test_sets_are_checked_written_and_signed(spark, tmp_path):
    pairs, path = pairs_of(spark), str(tmp_path / "set")
    decisions = decisions_of(pairs)
    manifest = audit.write_set(spark, pairs, decisions, path, "v1")
    assert manifest["counts"] == {"label.conflict": 4, "excluded.exclude_nonclaim": 3} and manifest == runs.read_manifest(spark, f"{path}/manifest")
    kept = spark.read.parquet(f"{path}/pairs").collect()
    assert {r.gold_label for r in kept} == {"conflict"} and kept[0].gold_projection_version == "v1_provisional"
    with pytest.raises(FileExistsError):
        audit.write_set(spark, pairs, decisions, path, "v1")
    with pytest.raises(ValueError, match="no_signature"):
        audit.finalized(spark, path, str(tmp_path / "final"), decisions)
    signed = decisions.withColumns({"signed": F.lit(True), "signed_by": F.lit("A. Reader"), "signed_at": F.lit("2026-02-03")})
    assert audit.finalized(spark, path, str(tmp_path / "final"), signed)["status"] == "signed_final"
    with pytest.raises(ValueError, match="no pair"):
        audit.write_set(spark, pairs, decisions.withColumn("action", F.lit("exclude_x")), str(tmp_path / "none"), "v1")


def test_sets_that_share_rows(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "n")], "pair_id int, action string, note string")
    b = spark.createDataFrame([(1, "x", None), (2, "z", None), (3, "q", None)], "pair_id int, action string, note string")
    assert {(r.rule, r.key) for r in audit.overlap_violations(a, b, "pair_id", ["action", "note"]).collect()} == {("differs_action", "2"), ("differs_note", "2")}
    assert [r.key for r in audit.leakage(a, b.where("pair_id <> 2"), "pair_id").collect()] == ["1"]
    with pytest.raises(ValueError, match="in_both"):
        checks.enforce(audit.leakage(a, b, "pair_id"))
    kind = "qid int, gold_spans array<struct<label_type:string>>"
    rows = spark.createDataFrame([(1, [("Subtle Conflict",)]), (2, [("Evident Baseless Info",)]), (3, [])], kind)
    assert [r.qid for r in audit.challenge(rows).collect()] == [1]


def test_counts_of_sets(spark):
    rows = spark.createDataFrame([("test",), ("test",), ("challenge",), (None,)], "part string")
    expected = spark.createDataFrame([("test", 2), ("challenge", 3), ("dev", 1), ("none", 0)], "part string, n int")
    told = lambda a, b: {(r.rule, r.key) for r in audit.count_violations(a, "part", b).collect()}
    assert told(rows, expected) == {("count", "challenge: 1 of 3"), ("count", "dev: 0 of 1"), ("count", "null: 1 of 0")}
    assert told(rows.where("part = 'test'"), expected.where("part in ('test', 'none')")) == set()
    with pytest.raises(ValueError):
        checks.enforce(audit.count_violations(rows, "part", expected))
