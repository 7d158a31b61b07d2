"""From raw records to pairs, and what pairs must be."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, pairs
from plumbline.operators.chunks import sentence_spans

SPAN = f"array<{pairs.SPAN}>"
RESPONSE = f"qid string, answer string, contexts array<struct<id:string,text:string>>, gold_spans {SPAN}, query string, generator_model string"
ANSWER = "Oslo is old. It lies by a fjord! Many ships call there."


def responses(spark, *spans, qid="7", contexts=((None, " On Oslo. "), ("b", "On ships."))):
    return spark.createDataFrame([(qid, ANSWER, list(contexts), [(a, b, ANSWER[a:b], kind) for a, b, kind in spans], "what of it", "m")], RESPONSE)


def test_pairs_of_a_response(spark):
    rows = pairs.response_pairs(responses(spark, (20, 40, "Evident Conflict"), (29, 32, "Subtle Baseless Info"))).orderBy("claim_start").collect()
    assert [r.pair_id for r in rows] == ["7_c01", "7_c02", "7_c03"] and [r.claim for r in rows] == ["Oslo is old", "It lies by a fjord", "Many ships call there"]
    assert [r.gold_label for r in rows] == ["supported", "conflict", "conflict"]
    assert rows[1].document == "[Evidence passage_1]\nOn Oslo.\n\n[Evidence b]\nOn ships." and rows[1].document_ids == ["passage_1", "b"]
    assert rows[1].gold_label_raw == ["Evident Conflict", "Subtle Baseless Info"] and rows[1].gold_overlap_char_count == 11
    assert rows[1].review_reasons == ["subtle_gold_span", "mixed_gold_types", "multiple_gold_spans", "low_claim_overlap", "boundary_only_overlap"]
    assert rows[2].review_reasons == ["span_split_across_claims"] and rows[0].review_reasons == [] and not rows[0].review_flag
    assert rows[1].gold_claim_coverage_ratio == round(11 / 18, 6) and len(rows[0]) == 33
    assert rows[2].schema_version == pairs.PAIR_SCHEMA and rows[2].source_id is None


def test_a_hundred_statements_and_unknown_types(spark):
    many = spark.createDataFrame([("1", "a. " * 120, [("x", "t")], None, "q", "m")], RESPONSE)
    assert {r.pair_id for r in pairs.response_pairs(many).collect()} == {f"1_c{i:02d}" for i in range(1, 121)}
    with pytest.raises(Exception, match="unknown span type"):
        pairs.response_pairs(responses(spark, (0, 5, "Typo"))).select("gold_label").collect()


def test_rules_of_responses_and_pairs(spark):
    bad = spark.createDataFrame([(" ", "x", [("a", "t")], None, None, None), ("2", None, [], None, None, None), ("3", "x", [("a", " ")], None, None, None), ("4", "x", [("a", "t")], None, None, None)], RESPONSE)
    got = {(r.rule, r.key) for r in checks.violations(bad, "qid", pairs.response_rules()).collect()}
    assert got == {("qid", " "), ("answer", "2"), ("contexts", "2"), ("context_text", "3")}
    rows = spark.createDataFrame([("p", "q", "c", "d", "t", "supported"), ("r", "q", "c", None, " ", "odd")], "pair_id string, qid string, claim_id string, document string, claim string, gold_label string")
    assert {(r.rule, r.key) for r in checks.violations(rows, "pair_id", pairs.pair_rules()).collect()} == {("blank_document", "r"), ("blank_claim", "r"), ("gold_label", "r")}


def test_a_document_gives_its_passages_back(spark):
    texts = [("a", "one\n\ntwo"), ("b c", "[Evidence of\nsorts]"), ("d", "")]
    document, _ = pairs.document_of(F.col("c"))
    df = spark.createDataFrame([(texts,), ([("x", "y")],)], "c array<struct<id:string,text:string>>")
    got = df.select(pairs.document_passages(document)).collect()
    assert [[tuple(p) for p in r[0]] for r in got] == [texts, [("x", "y")]]
    assert spark.range(1).select(pairs.document_passages(F.lit("plain"))).first()[0] is None


SOURCES = "source_id int, task_type string, source string, prompt string, source_info struct<question:string,passages:string,text:string>, line int"
RAW = f"id string, source_id int, model string, temperature double, split string, quality string, response string, labels {SPAN}"


def test_preparation(spark):
    sources = spark.createDataFrame([(1, "QA", "old", "p", ("q0", "x", None), 1), (1, "QA", "new", "p", ("q1", "passage 1: uno\nPassage 2:\n due\n\npassage 3:", None), 9), (2, "Summary", "s", "sum up", (None, None, "all of it"), 2)], SOURCES)
    span = [(0, 1, "a", "Evident Conflict")]
    raw = spark.createDataFrame([("a", 1, "m", 0.1, "train", "good", "r", span), ("b", 2, "m", 0.1, "test", "good", "r", []), ("c", 1, "m", 0.1, "test", "bad", "r", []), ("d", 3, "m", 0.1, "test", "good", "r", [])], RAW)
    ids = lambda **kw: {r.id for r in pairs.filtered_responses(raw, sources, order="line", **kw).collect()}
    assert ids() == {"a"} and ids(task_type="all") == {"a", "b"} and ids(task_type="all", quality="all") == {"a", "b", "c"}
    assert ids(task_type="all", split="test") == {"b"} and ids(task_type="all", require_spans=True) == {"a"} and ids(task_type="all", response_id="b") == {"b"}
    got = {r.qid: r for r in pairs.converted(pairs.filtered_responses(raw, sources, task_type="all", order="line")).collect()}
    assert (got["a"]["query"], got["a"].source, [tuple(c) for c in got["a"].contexts], got["a"].gold_hallucinated) == ("q1", "new", [("passage_1", "uno"), ("passage_2", "due")], True)
    assert (got["b"]["query"], [tuple(c) for c in got["b"].contexts], got["b"].gold_hallucinated) == ("sum up", [("source_context", "all of it")], False)
    assert [r.id for r in pairs.first_rows(raw, "id", 2).collect()] == ["a", "b"]


def test_span_scores(spark):
    kind = "k int, predicted_spans array<struct<start:int,end:int>>, gold_spans array<struct<start:int,end:int>>"
    rows = spark.createDataFrame([(1, [(0, 10), (5, 20)], [(10, 30)]), (2, [], None), (3, [(0, 4)], []), (4, None, [(1, 2)])], kind)
    got = {r.k: tuple(r)[1:] for r in pairs.span_scores(rows, "k").collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}


def test_sentences_keep_their_places():
    text = " Ja.  Nein! \n\n 好。 Ende"
    assert [text[a:b] for a, b in sentence_spans(text)] == ["Ja.", "Nein!", "好。", "Ende"]


def test_long_answers_with_many_statements(spark):
    text = "It is so, as we said. " * 11_000
    rows = [(str(i), text, [("a", "t " * 50_000)], [(0, 5, "It is", "Evident Conflict")], "q", "m") for i in range(10)]
    found = pairs.response_pairs(spark.createDataFrame(rows, RESPONSE).coalesce(1)).select("qid", "claim_start", "gold_label", "claim_token_count")
    told = found.groupBy("qid").agg(F.count("*").alias("n"), F.max("claim_start").alias("last"), F.count_if(F.col("gold_label") == "conflict").alias("bad"), F.min("claim_token_count").alias("t")).collect()
    assert {tuple(r)[1:] for r in told} == {(11_000, 22 * 10_999, 1, 6)} and len(told) == 10
    generate = found._jdf.queryExecution().optimizedPlan().toString()
    assert "document#" not in generate.split("Generate inline")[0]


def test_a_document_is_walked_by_its_ids(spark):
    texts = [("a", "one\n\n[Evidence x]\ntwo"), ("b c", "[Evidence of]\nsorts"), ("d", "")]
    document, ids = pairs.document_of(F.col("c"))
    df = spark.createDataFrame([(texts,), ([("x", "y")],), ([(None, "y"), ("", " z ")],)], "c array<struct<id:string,text:string>>")
    rows = df.select(document.alias("d"), ids.alias("i"))
    got = [r[0] for r in rows.select(pairs.passages_of(F.col("d"), F.col("i"))).collect()]
    assert [[tuple(p) for p in g] for g in got] == [texts, [("x", "y")], [("passage_1", "y"), ("passage_2", "z")]]
    wrong = rows.select(pairs.passages_of(F.col("d"), F.reverse("i"))).collect()
    assert [r[0] is None for r in wrong] == [True, False, True]
    assert spark.range(1).select(pairs.passages_of(F.lit("plain"), F.array(F.lit("a")))).first()[0] is None
