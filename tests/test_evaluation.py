"""Reports, judges' results and what must hold between them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluation, judges
from plumbline.plans import catalog

ROWS = [("supported", "supported", False, []), ("supported", "case_review", True, ["r", "r"]), ("conflict", "unsupported", False, []), ("unsupported", "unsupported", True, ["r", "s"]), ("unsupported", "supported", False, None)]


def judged(spark):
    return spark.createDataFrame([("m", i, *r) for i, r in enumerate(ROWS)], "method string, pair_id int, gold string, pred string, review_flag boolean, review_reasons array<string>")


def test_pair_report(spark):
    got = {(r.part, r.name): r.value for r in evaluation.pair_report(judged(spark), ["method"]).collect()}
    assert got["full_set", "all.accuracy"] == 0.4 and got["decided_only", "all.accuracy"] == 0.5 and got["unflagged_only", "all.rows"] == 3
    assert got["full_set", "supported.recall"] == 0.5 and got["full_set", "supported.fn"] == 1 and got["full_set", "conflict.precision_low"] is None
    assert got["full_set", "all.macro_f1"] == pytest.approx((2 / 4 + 0 + 2 / 4) / 3) and got["full_set", "all.abstained"] == 1
    assert (got["binary", "tp"], got["binary", "fp"], got["binary", "fn"], got["binary", "tn"]) == (2, 0, 1, 1)
    assert got["binary", "conflict_to_unsupported_rate"] == 1.0 and got["binary", "abstentions_negative_gold"] == 1
    assert got["coverage", "decision_coverage"] == 0.8 and got["coverage", "review_rate"] == 0.4
    assert got["review_reason", "r"] == 2 and got["review_reason", "s"] == 1 and got["pred_label", "case_review"] == 1


def test_subsets_without_rows_are_absent(spark):
    only = judged(spark).where("pred = 'case_review'")
    assert {r.part for r in evaluation.pair_report(only, ["method"]).collect()} >= {"full_set", "coverage"} and evaluation.subsets(only).where("subset = 'decided_only'").count() == 0


def test_result_violations(spark):
    inputs = spark.createDataFrame([(1, "q", "d", "supported"), (2, "q", "d", "conflict")], "pair_id int, qid string, document string, gold_label string")
    results = spark.createDataFrame([(1, "q", "other", "supported", "case_review", False, "r1"), (1, "q", "d", "supported", "conflict", True, ""), (3, "q", "d", "odd", "supported", None, "r1")], "pair_id int, qid string, document string, gold_label string, pred string, review_flag boolean, run_id string")
    got = {(r.rule, r.key) for r in evaluation.result_violations(results, inputs, "pred", "fused").collect()}
    assert got == {("duplicate_key", "1"), ("only_left", "3"), ("only_right", "2"), ("differs_document", "1"), ("gold", "3"), ("review_flag", "3"), ("review_without_flag", "1"), ("not_single", "run_id")}


def test_comparisons_need_both_sides(spark):
    rows = [("a", 1, "conflict", "supported"), ("b", 1, "conflict", "conflict"), ("a", 2, "conflict", "supported"), ("a", 3, "supported", "conflict"), ("b", 3, "conflict", "conflict"), ("a", 4, "supported", "supported"), ("b", 4, "supported", "conflict"), ("a", 5, "supported", "conflict"), ("b", 5, "supported", "unsupported")]
    verdicts = spark.createDataFrame(rows, "variant string, pair_id int, gold string, pred string")
    got = {r.pair_id: r.change for r in evaluation.comparisons(verdicts, [("a", "b")]).collect()}
    assert got == {1: "fixed", 2: "not_paired", 3: "not_paired", 4: "regressed", 5: "changed_but_still_wrong"}
    moved = evaluation.comparisons(verdicts, [("a", "b")]).withColumn("order_changed", F.col("pair_id") == 9)
    assert evaluation.flip_report(moved, ["from_variant"]).first().flip_rate_changed_order is None


def test_frozen_violations(spark):
    frozen = spark.createDataFrame([(1, "s", "c"), (2, "s", "c"), (3, "s", "c")], "pair_id int, source_id string, claim string")
    pairs = spark.createDataFrame([(1, "s", "c", ["x"]), (2, "s", "changed", ["x"]), (3, "s", "c", [])], "pair_id int, source_id string, claim string, document_ids array<string>")
    choices = spark.createDataFrame([(1, ["x"], 1, 512, False), (2, ["x"], 2, 10, False), (3, [], 0, 513, False)], "pair_id int, selected_ids array<string>, selected_count int, input_tokens int, was_truncated boolean")
    got = {(r.rule, r.key) for r in evaluation.frozen_violations(pairs, frozen, choices).collect()}
    assert got == {("differs_claim", "2"), ("selected_count", "2"), ("selected_ids", "3"), ("budget", "3")}


def test_medians_buckets_and_lengths(spark):
    rows = spark.createDataFrame([("a", n, "x", "x" if n < 600 else "y") for n in (5, 1, 9, 700)] + [("b", 3000, "x", "y")], "g string, n int, gold string, pred string")
    assert {tuple(r) for r in evaluation.upper_median(rows, "n", ["g"]).collect()} == {("a", 1, 9, 700), ("b", 3000, 3000, 3000)}
    assert {r.bucket: (r.rows, r.errors) for r in evaluation.length_buckets(rows, "n").collect()} == {"all": (5, 2), "le512": (3, 0), "gt512": (2, 2), "gt2048": (1, 1)}
    bad = spark.createDataFrame([(1, 2049), (2, 0), (3, None), (4, 2048)], "pair_id int, n int")
    assert {r.pair_id for r in bad.where(evaluation.length_rules("n")["length"]).collect()} == {1, 2, 3}


def test_best_evidence_and_chunk(spark):
    rows = [(1, 1, 0.6, 0.1, 0.3), (1, 2, 0.6, 0.7, 0.2), (2, 1, 0.4, 0.3, 0.3), (2, 2, 0.1, 0.1, 0.8), (3, 1, 0.55, 0.5, 0.0), (4, None, None, None, None), (5, 1, 0.5, 0.5, 0.0)]
    got = {r.k: (r.label, r.pos, r.entailment, r.contradiction, r.neutral) for r in judges.best_evidence(spark.createDataFrame(rows, "k int, pos int, entailment double, contradiction double, neutral double"), ["k"]).collect()}
    assert got == {1: ("conflict", 2, 0.6, 0.7, 0.3), 2: ("unsupported", 2, 0.4, 0.3, 0.8), 3: ("supported", 1, 0.55, 0.5, 0.0), 4: ("unsupported", None, None, None, None), 5: ("supported", 1, 0.5, 0.5, 0.0)}
    chunks = [(1, 0, 0.2), (1, 1, 0.9), (1, 2, 0.9), (2, 0, 0.49999949), (2, 1, 0.1)]
    told = {r.k: (r.label, r.prediction, r.support_probability, r.selected_chunk, r.chunk_probabilities) for r in judges.best_chunk(spark.createDataFrame(chunks, "k int, chunk_no int, probability double"), ["k"]).collect()}
    assert told == {1: ("supported", 1, 0.9, 2, [0.2, 0.9, 0.9]), 2: ("unsupported", 0, 0.499999, 1, [0.499999, 0.1])}


def test_merged_verdicts(spark):
    kind = "pair_id int, {} string, review_flag boolean, data_review_flag boolean, model_review_flag boolean, review_reasons array<string>"
    a = spark.createDataFrame([(1, "supported", True, True, False, ["long", "low_a"]), (2, "supported", False, None, False, None), (3, "unsupported", None, None, None, [])], kind.format("label"))
    b = spark.createDataFrame([(1, "entailment", False, False, False, ["low_b", "long"]), (2, "neutral", False, False, False, []), (3, "neutral", False, False, False, [])], kind.format("top"))
    got = {r.pair_id: r for r in judges.merged(a, b).collect()}
    assert (got[1].final_label, got[1].review_reasons, got[1].review_reason, got[1].review_flag, got[1].model_review_flag) == ("supported", ["long", "low_a", "low_b"], "long", True, False)
    assert (got[2].final_label, got[2].review_reasons, got[2].review_reason, got[2].review_flag, got[2].model_review_flag) == ("case_review", ["model_disagreement"], "model_disagreement", True, True)
    assert (got[3].final_label, got[3].review_reason, got[3].review_flag) == ("unsupported", None, False)


def test_review_refresh_and_its_errors(spark):
    rows = spark.createDataFrame([(1, 0.69, True, ["a", "a"]), (2, 0.7, None, None)], "k int, c double, data_review_flag boolean, data_review_reasons array<string>")
    got = {r.k: (r.model_review_flag, r.review_flag, r.review_reasons) for r in judges.reviewed(rows, F.col("c"), "nli").collect()}
    assert got == {1: (True, True, ["a", "low_nli_confidence"]), 2: (False, False, [])}
    for wrong in (1.2, float("nan"), None):
        with pytest.raises(Exception, match="confidence"):
            judges.reviewed(rows, F.lit(wrong).cast("double"), "nli").collect()


def test_responses_take_the_rules_where_they_abstain(spark):
    claims = spark.createDataFrame([(1, 1, "Cannot answer that", 0, 18), (1, 2, "It is red", 20, 29), (1, 3, "It is big", 30, 39)], "qid int, claim_no int, claim string, claim_start int, claim_end int")
    said = spark.createDataFrame([(1, 1, "conflict"), (1, 2, "conflict")], "qid int, claim_no int, label string")
    rules = spark.createDataFrame([(1, n, "supported") for n in (1, 2, 3)], "qid int, claim_no int, label string")
    gold = spark.createDataFrame([(1, [(20, 25)], None)], "qid int, gold_spans array<struct<start:int,end:int>>, gold_hallucinated boolean")
    row = judges.response_results(judges.judged_responses(claims, said, rules), gold).first()
    assert row.pred_labels == ["supported", "conflict", "supported"] and [tuple(s) for s in row.predicted_spans] == [(20, 29, "conflict")]
    assert (row.faithfulness, row.hallucination_rate, row.gold_hallucinated, row.response_correct, row.span_precision, row.span_recall) == (0.6667, 0.3333, True, True, 0.5556, 1.0)


def test_batches_and_summary(spark):
    got = judges.numbered_batches(spark.range(0, 1000, 7), "id", 50).orderBy("id").collect()
    assert [r.batch_id for r in got] == [f"b{i // 50 + 1:05d}" for i in range(143)] and {r.batch_size for r in got} == {50, 43}
    with pytest.raises(ValueError, match="batch"):
        judges.numbered_batches(spark.range(3), "id", 0)
    rows = spark.createDataFrame([(1, "supported", True, 0.25), (2, "supported", False, 0.5)], "pair_id int, label string, review_flag boolean, score double")
    row = judges.run_summary(rows).first()
    assert (row.pairs, row.unique_pairs, row.review_pairs, row.score_min, [tuple(x) for x in row.label_counts]) == (2, 2, 1, 0.25, [("supported", 2)])


def test_labels_and_numbers():
    assert judges.label_places({0: "Neutral", 1: "ENTAILMENT", 2: "contradiction"})["entailment"] == 1
    with pytest.raises(ValueError, match="neutral"):
        judges.label_places({0: "entailment", 1: "contradiction"})
    assert judges.flat_numbers([[1, (2.5,)], 3]) == [1.0, 2.5, 3.0] and judges.flat_numbers(4) == [4.0]


def test_batches_of_six_digits_are_as_in_sql(spark, tmp_path):
    duckdb.sql(f"copy (select i o_orderkey from range(6400130) t(i)) to '{tmp_path}/orders.parquet'")
    duckdb.sql(f"create or replace view orders as select * from '{tmp_path}/orders.parquet'")
    got = catalog.queries()["judge_batches"](spark, str(tmp_path)).where("k >= 6399900").orderBy("k")
    assert [tuple(r) for r in got.collect()] == duckdb.sql(f"select * from ({catalog.oracle_sql()['judge_batches']}) where k >= 6399900 order by k").fetchall()
    whole = judges.numbered_batches(spark.range(6400130), "id", 64).where("id >= 6400000").select("batch_id").distinct().collect()
    assert {r.batch_id for r in whole} == {"b100001", "b100002", "b100003"}
