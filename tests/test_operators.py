import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import audit, checks, metrics, ranking, spans, verdicts
from plumbline.operators.chunks import SENTENCE_END, chunks, count_tokens, requirement_summary, retained
from plumbline.operators.claims import split_claims
from plumbline.operators.judges import scored_pairs
from plumbline.sources import jsonl
from plumbline.streaming.verdicts import judge_pairs


def claims_of(spark, *texts, **kw):
    rows = split_claims(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", **kw).orderBy("k", "claim_no").collect()
    for r in rows:
        assert texts[r.k][r.claim_start : r.claim_end] == r.claim
    return [[r for r in rows if r.k == i] for i in range(len(texts))]


SPLITS = {
    "  Rain fell all night! Was it cold?? 风很大；路也滑。 ": ["Rain fell all night", "Was it cold", "风很大", "路也滑"],
    "Bring these:\n1. rope\n 2) a lamp\n- bread\n• water.": ["Bring these:", "rope", "a lamp", "bread", "water"],
    "The hike is 12.5 km long. Tickets: $3.20.": ["The hike is 12.5 km long", "Tickets: $3.20"],
    "Ask Mrs. Lund at the U.N. desk, e.g. on Monday. She knows.": ["Ask Mrs. Lund at the U.N. desk, e.g. on Monday", "She knows"],
    "Wait... what? v1.2 is out": ["Wait", "what", "v1.2 is out"],
    "one\r\n\r\ntwo": ["one", "two"],
    "": [],
    " . ! ": [],
}


def test_claims(spark):
    got = claims_of(spark, *SPLITS)
    assert [[r.claim for r in x] for x in got] == list(SPLITS.values())
    assert [r.features for r in got[1]] == [[], ["numbered_list_item"], ["numbered_list_item"], ["bullet_list_item"], ["bullet_list_item"]]
    assert [[r.claim_no for r in x] for x in got] == [list(range(1, len(v) + 1)) for v in SPLITS.values()]
    long = claims_of(spark, "the quick fox ran over hills while a slow bear slept near trees", long_tokens=9, compound_tokens=11)[0]
    assert long[0].review_reasons == ["long_claim", "possible_compound_claim"]
    assert split_claims(spark.createDataFrame([(1, None)], "k int, t string"), "k", "t").count() == 0


def test_projection(spark):
    claims = spark.createDataFrame([(1, 1, 100, 140), (2, 1, 0, 100), (3, 1, 5, 45), (4, 1, 7, 9)], "q int, claim_no int, claim_start int, claim_end int")
    marks = [(1, 90, 180, "Subtle Baseless Info"), (2, 97, 100, "Evident Conflict"), (3, 5, 40, "Evident Conflict"), (3, 20, 45, "Subtle Baseless Info"), (4, 9, 12, "Evident Conflict")]
    kind = "q int, span_start int, span_end int, label_type string"
    rows = {r.q: r for r in spans.projected(claims, spans.overlaps(claims, spark.createDataFrame(marks, kind), "q"), ["q", "claim_no"]).collect()}
    assert (rows[1].gold_label, rows[1].review_reasons) == ("unsupported", ["subtle_gold_span", "span_split_across_claims"])
    assert (rows[2].gold_label, rows[2].review_reasons) == ("conflict", ["low_claim_overlap", "boundary_only_overlap"])
    assert (rows[3].gold_label, rows[3].review_reasons) == ("conflict", ["subtle_gold_span", "mixed_gold_types", "multiple_gold_spans"])
    assert (rows[4].gold_label, rows[4].n_spans) == ("supported", 0)
    for wrong in ("Odd", None):
        with pytest.raises(Exception, match="unknown span type"):
            spans.projected(claims, spans.overlaps(claims, spark.createDataFrame([(1, 90, 180, wrong)], kind), "q"), ["q", "claim_no"]).collect()


def test_metrics(spark):
    rows = [("supported", "supported")] * 3 + [("supported", "case_review"), ("conflict", "conflict"), ("conflict", "unsupported"), ("unsupported", "conflict")]
    cells = metrics.confusion(spark.createDataFrame(rows, "gold string, pred string"))
    by = {r.label: r for r in metrics.per_class(cells).collect()}
    assert (by["supported"].recall, by["supported"].precision, by["conflict"].f1, by["unsupported"].f1) == (0.75, 1.0, 0.5, 0.0)
    assert metrics.overall(cells).first().accuracy == 4 / 7
    assert metrics.wilson_value(0, 0) is None
    low, high = metrics.wilson_value(8, 10)
    assert low == pytest.approx(0.4901625) and high == pytest.approx(0.9433178)
    assert spark.range(1).select(*metrics.wilson(F.lit(8), F.lit(10))).first() == (pytest.approx(low), pytest.approx(high))
    assert spark.range(1).select(*metrics.wilson(F.lit(0), F.lit(0))).first() == (None, None)
    with pytest.raises(Exception, match="unknown label"):
        metrics.confusion(spark.createDataFrame([("supported", "maybe")], "gold string, pred string")).collect()


def test_fusion_and_review(spark):
    combos = [(a, b) for a in ("supported", "unsupported") for b in ("entailment", "contradiction", "neutral")]
    label, rule = verdicts.fused(F.col("a"), F.col("b"))
    got = [tuple(r) for r in spark.createDataFrame(combos, "a string, b string").select(label, rule).collect()]
    agreeing = {0: ("supported", "both_support"), 4: ("conflict", "unsupported_plus_contradiction"), 5: ("unsupported", "both_non_support_neutral")}
    assert got == [agreeing.get(i, ("case_review", "model_disagreement")) for i in range(6)]
    low, reasons = verdicts.review(F.array(F.lit("y"), F.lit("y")), F.col("c"), "nli", 0.6)
    assert [tuple(r) for r in spark.createDataFrame([(0.5999,), (0.6,)], "c double").select(low, reasons).collect()] == [(True, ["y", "low_nli_confidence"]), (False, ["y"])]
    assert [r[0] for r in spark.createDataFrame([("supported",), ("unsupported",)], "s string").select(verdicts.support_confidence(F.col("s"), F.lit(0.25))).collect()] == [0.25, 0.75]


def test_ranking(spark):
    scored = ranking.ranked(spark.createDataFrame([("q", i, s) for i, s in enumerate((0.5, 2.5, 0.5, 9.0, 1.0))], "qid string, pos int, score double"))
    assert [r.pos for r in scored.orderBy("rank").collect()] == [3, 1, 4, 0, 2]
    assert [r.pos for r in ranking.top_k(scored).where("k = 3").orderBy("source_order").collect()] == [1, 3, 4]
    kept = ranking.evidence_filter(scored, F.when(F.col("pos") == 2, 1).otherwise(0), 5)
    assert [r.pos for r in kept.orderBy("kept_rank").collect()] == [3, 2]
    sample = ranking.exact_sample(spark.range(100), "id", 7, 3)
    assert sorted(sample.collect()) == sorted(ranking.exact_sample(spark.range(100).repartition(5), "id", 7, 3).collect())


def test_extractive_answers(spark):
    asked = spark.createDataFrame([(1, "how deep is the lake"), (2, "who built it"), (3, "any boats")], "qid int, query string")
    said = [(1, 1, 1, "The town is old"), (1, 1, 2, "The lake is deep"), (1, 2, 1, "A deep lake"), (2, 1, 1, "Nothing here"), (2, 1, 2, "船很多。")]
    got = ranking.extractive_answers(asked, spark.createDataFrame(said, "qid int, kept_rank int, claim_no int, claim string"), "cannot say")
    assert {r.qid: (r.score, r.answer) for r in got.collect()} == {1: (2, "The lake is deep。"), 2: (0, "cannot say"), 3: (0, "cannot say")}


def naive_chunks(text, limit):
    """The rules of chunks by trying every place."""
    units = []
    for part in re.split(f"({SENTENCE_END.pattern})", text):
        if not part.strip():
            continue
        at = text.index(part.strip(), units[-1][1] if units else 0)
        end = at + len(part.strip())
        while at < end:
            fits = [e for e in range(at + 1, end + 1) if count_tokens(text[at:e]) <= limit]
            stop = max((e for e in fits if e == end or text[e - 1].isspace() and not text[e].isspace()), default=max(fits, default=at + 1))
            units.append((at, stop))
            at = stop
    out, i = [], 0
    while i < len(units):
        j = i + 1
        while j < len(units) and count_tokens(text[units[i][0] : units[j][1]]) <= limit:
            j += 1
        out.append((units[i][0], units[j - 1][1], count_tokens(text[units[i][0] : units[j - 1][1]])))
        i = j if j == len(units) or j == i + 1 else j - 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["go", "lighthouse", "fog-horn", "sea.", "calm!", "浪。", " ", "  ", "\n", "...", "q" * 40, "!?" * 6]), max_size=40).map(" ".join), st.integers(8, 14))
def test_chunks_by_brute_force(text, limit):
    assert chunks(text, limit) == naive_chunks(text, limit)


def test_chunks_of_long_texts_and_words():
    found = chunks("ein " * 50_000 + "x" * 5_000 + "-" * 400, 128)
    assert all(n <= 128 for _, _, n in found) and found[0][:2] == (0, 504)
    with pytest.raises(ValueError, match="room"):
        chunks("a", 7)


def test_retention(spark):
    marks = spark.createDataFrame([("gap", "r", 10, 16, "to  be"), ("word", "r", 10, 16, "to, be"), ("none", "r", 0, 2, "hi")], "case string, req string, start int, end int, text string")
    picked = spark.createDataFrame([(c, "r", a, b) for c in ("gap", "word") for a, b in ((14, 30), (0, 12))], "case string, req string, start int, end int")
    rows = retained(marks, picked, ["case", "req"])
    assert {r.case: r.retained for r in rows.collect()} == {"gap": True, "word": False, "none": False}
    told = requirement_summary(rows, "case", "req").first()
    assert (told.units_met, told.units, told.complete_rate) == (1, 3, 1 / 3)


def test_audit_and_checks(spark):
    claims = ["Based on the provided passages the tower leans", "The given passage says so", "Sure, I can help you with that.", "These tools:", "They rust", "1)"]
    action, flags = audit.proposal(F.col("c"), F.array(F.lit("z")))
    got = spark.createDataFrame([(c,) for c in claims], "c string").select(action, flags).collect()
    assert [r[0] for r in got] == ["include", "exclude_source_relative", "exclude_nonclaim", "exclude_nonclaim", "include", "exclude_nonclaim"]
    assert got[4][1] == ["possible_missing_referent", "z"]
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="duplicate_key"):
        checks.enforce(checks.duplicates(df, "k"))
    assert checks.content_hash(df, "k") == checks.content_hash(df.repartition(3), "k")


def test_jsonl(spark, tmp_path):
    rows = [{"qid": "1", "response": "x", "context": ["a ", "b"]}, {"qid": "2", "answer": "y", "response": "z", "contexts": [{"id": "p", "text": "c"}]}]
    (tmp_path / "r.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    got = jsonl.read_responses(spark, str(tmp_path / "r.jsonl")).orderBy("qid").collect()
    assert [(c.id, c.text) for c in got[0].contexts] == [("passage_1", "a"), ("passage_2", "b")] and not got[0].alias_conflict
    assert got[1].alias_conflict and got[1].contexts[0].id == "p"


def test_model_surface_and_stream(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "the bridge is shut", "bridge"), (2, "a red door", "window")], "k int, document string, claim string")
    scored = scored_pairs(pairs, "k", "document", "claim", lambda: lambda p, h: [(float(y in x),) for x, y in zip(p, h)], ("support",))
    assert {r.k: r.support for r in scored.collect()} == {1: 1.0, 2: 0.0}
    pairs.write.parquet(str(tmp_path / "in"))
    stream = judge_pairs(spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: r.label for r in spark.table("judged").collect()} == {1: "supported", 2: "unsupported"}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 10)), min_size=1, max_size=8))
def test_union_counts_characters(spark, marks):
    df = spark.createDataFrame([(1, a, a + n) for a, n in marks], "k int, span_start int, span_end int")
    assert spans.covered_chars(spans.union_pieces(df, "k"), "k").first().chars == len({c for a, n in marks for c in range(a, a + n)})


def test_leads_and_ends_of_statements(spark):
    texts = ["　 1. Ja !? ", "- x", "12) y。。\n\n• z;", "٣. w", "3.", "*", "   ", "", "a  . ;", "\x85- b !"]
    got = [(r.k, r.claim, r.claim_start, r.features) for r in split_claims(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").orderBy("k", "claim_no").collect()]
    assert all(texts[k][at : at + len(claim)] == claim for k, claim, at, _ in got)
    assert [(k, c, f) for k, c, _, f in got] == [
        (0, "1", []), (0, "Ja", []), (1, "x", ["bullet_list_item"]), (2, "y", ["numbered_list_item"]), (2, "z", ["bullet_list_item"]),
        (3, "٣", []), (3, "w", []), (4, "3", []), (5, "*", []), (8, "a", []), (9, "b", ["bullet_list_item"]),
    ]
