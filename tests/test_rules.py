"""Rules of results and spans, rebuilt tables, outside scores, and the small functions that no query reads."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import sentences
from plumbline.operators import checks, evaluation, experiments, generation, pairs

RESULT = "id int, entailment double, contradiction double, neutral double, top_label string, top_score double, score double, document string, document_len int, claim string, claim_len int, review_flag boolean, pred_label string, gold_label string, latency_ms double, prediction int"
GOOD = (0.7, 0.2, 0.1, "entailment", 0.7, 0.7, "doc", 3, "c", 1, False, "supported", "supported", 1.0, 1)


def broken(spark, rules, *rows):
    return {(r.rule, r.key) for r in checks.violations(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RESULT), "id", rules).collect()}


def test_rules_of_results(spark):
    change = lambda **kw: tuple(kw.get(n, v) for n, v in zip([c.split()[0] for c in RESULT.split(", ")][1:], GOOD))
    rows = [GOOD, change(top_label="neutral"), change(entailment=1.2), change(top_score=0.6), change(score=-0.1), change(document_len=4), change(claim_len=None), change(review_flag=None), change(neutral=float("nan"))]
    got = broken(spark, checks.score_rules(), *rows)
    assert {("top_label", "1"), ("probability", "2"), ("top_score", "3"), ("score", "4"), ("document_len", "5"), ("claim_len", "6"), ("review_flag", "7"), ("probability", "8")} <= got
    assert not any(k == "0" for _, k in got) and {r for r, k in got if k in "1345"} == {"top_label", "top_score", "score", "document_len"}
    tie = change(entailment=0.4, contradiction=0.4, neutral=0.2, top_score=0.4)
    assert not broken(spark, checks.score_rules(), tie) and broken(spark, checks.score_rules(), change(entailment=0.4, contradiction=0.4, neutral=0.2, top_score=0.4, top_label="contradiction")) == {("top_label", "0")}
    assert broken(spark, checks.result_rules(), GOOD, change(pred_label="odd"), change(gold_label=None), change(neutral=0.2), change(latency_ms=-1.0)) == {("label", "1"), ("gold", "2"), ("probability_sum", "3"), ("latency", "4")}
    assert broken(spark, checks.binary_rules(), GOOD, change(prediction=0), change(pred_label="conflict", prediction=0)) == {("prediction", "1"), ("label", "2")}


def test_rules_of_spans(spark):
    rows = [(1, "abcdef", [(0, 3, "abc")]), (2, "abcdef", [(0, 3, "abx")]), (3, "abcdef", [(-1, 3, None)]), (4, "abcdef", [(2, 2, None)]), (5, "abcdef", [(4, 9, None)]), (6, "abcdef", [])]
    df = spark.createDataFrame(rows, "id int, answer string, gold_spans array<struct<start:int,end:int,text:string>>")
    assert {(r.rule, r.key) for r in checks.violations(df, "id", checks.span_rules()).collect()} == {("span_text", "2"), ("span_bounds", "3"), ("span_bounds", "4"), ("span_end", "5")}


def test_single_values(spark):
    df = spark.createDataFrame([("a", "x", None), ("a", "y", None), ("a", "x", "z")], "one string, two string, some string")
    assert {r.key for r in evaluation.single_values(df, ["one", "two", "some"]).collect()} == {"two", "some"}


def test_sentences_of_texts(spark):
    df = spark.createDataFrame([(" Ja. Nein!好。gut\n\nEnde ",), ("",), (" \n ",)], "t string")
    assert [r[0] for r in df.select(sentences(F.col("t"))).collect()] == [["Ja.", "Nein!好。", "gut", "Ende"], [""], [""]]


def test_rebuilt_experiments(spark):
    df = spark.createDataFrame([(i, "v", [i]) for i in range(50)], "qid int, variant string, chosen array<int>")
    experiments.check_rebuilt(df, df.repartition(3), ["qid", "variant"], ["chosen"])
    other = df.where("qid <> 3").withColumn("chosen", F.when(F.col("qid") == 7, F.array(F.lit(0))).otherwise(F.col("chosen")))
    with pytest.raises(ValueError, match="3/v missing; 7/v changed"):
        experiments.check_rebuilt(df, other, ["qid", "variant"], ["chosen"])


def test_outside_scores(spark):
    chunks = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b")], "conv string, pos int, chunk_id string")
    asked = spark.createDataFrame([(1, "g"), (2, "g")], "qid int, conv string")
    score = lambda *rows: experiments.pool_scores(spark.createDataFrame(list(rows), "qid int, chunk_id string, score double"), chunks, "conv", asked)
    whole = [(1, "a", 0.5), (1, "b", 0.25), (2, "a", 0.0), (2, "b", -1.0)]
    assert sorted(map(tuple, score(*whole).collect())) == [(1, 1, 0.5), (1, 2, 0.25), (2, 1, 0.0), (2, 2, -1.0)]
    for rows, error in ((whole[1:], "not_scored: 1/a"), ([*whole, (1, "c", 0.1)], "not_in_pool: 1/c"), ([*whole, whole[0]], "scored_twice: 1/a"), ([*whole[:3], (2, "b", float("nan"))], "no_number: 2/b")):
        with pytest.raises(ValueError, match=error):
            score(*rows)


def test_answers_of_samples(spark):
    samples = spark.createDataFrame([(1, "old town", "said"), (2, "old town", None), (3, "nothing shared", None), (4, None, None), (5, "old town", None)], "qid int, query string, answer string")
    contexts = spark.createDataFrame([(q, p, f"d{p}", t) for q in (1, 2, 3, 4) for p, t in ((1, "A harbour."), (2, "The town is old. It lies low."), (3, "An old map"))], "qid int, pos int, id string, text string")
    got = {r.qid: (r.mode, r.answer, [c.id for c in r.evidence]) for r in generation.answered(samples, contexts, "none").collect()}
    assert got == {1: ("verification", "said", ["d1", "d2", "d3"]), 2: ("generation", "The town is old。", ["d2", "d3"]), 3: ("generation", "none", ["d1"]), 4: ("generation", "none", ["d1"]), 5: ("generation", "none", [])}
    assert generation.answered(samples.where("false"), contexts, "none").count() == 0


def test_recall_of_evidence(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "b"]), (["a"], []), ([], ["a"]), (["a"], None)], "got array<string>, gold array<string>")
    assert [r[0] for r in df.select(generation.evidence_recall(F.col("got"), F.col("gold"))).collect()] == [0.5, None, 0.0, None]
    assert pairs.POLICY
