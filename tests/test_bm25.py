"""BM25 against its formula, and what it shuffles."""

import math
from collections import Counter

import pytest

from plumbline.functions.text import words
from plumbline.operators import ranking
from plumbline.plans import answers

SF = "/root/testdata/sf0.001"
PASSAGES = [("a", 1, "red red fox"), ("a", 2, "blue fox and hound"), ("a", 3, None), ("a", 4, ""), ("b", 1, "fox"), (None, 1, "fox"), ("c", 1, "nothing shared")]
QUERIES = [("q1", "a", "red Fox fox"), ("q2", "a", None), ("q3", "b", "fox red"), ("q4", "c", "fox"), ("q5", "none", "fox"), ("q6", None, "fox")]


def brute(distinct):
    out = {}
    for qid, g, query in QUERIES:
        pool = {p: (t or "").split() for h, p, t in PASSAGES if g is not None and h == g}
        mean = max(sum(map(len, pool.values())) / len(pool), 1.0) if pool else 1.0
        asked = Counter((query or "").lower().split())
        for p, said in pool.items():
            shared = [x for x in asked if x in said]
            df = {x: sum(x in t for t in pool.values()) for x in shared}
            score = sum((1 if distinct else asked[x]) * math.log(1 + (len(pool) - df[x] + 0.5) / (df[x] + 0.5)) * said.count(x) * 2.0 / (said.count(x) + 1.2 * (0.25 + 0.75 * len(said) / mean)) for x in shared)
            out[qid, p] = (round(score, 6), len(shared))
    return out


@pytest.mark.parametrize("distinct", [True, False])
def test_scores_equal_the_formula(spark, distinct):
    q, p = spark.createDataFrame(QUERIES, "qid string, g string, query string"), spark.createDataFrame(PASSAGES, "g string, pos int, text string")
    got = ranking.bm25(q, p, words, group="g", numerator=2.0, k1=1.2, distinct_terms=distinct, digits=6).collect()
    assert {(r.qid, r.pos): (round(r.score, 6), r.overlap) for r in got} == brute(distinct) and len(got) == len(brute(distinct))


def test_a_group_of_its_own(spark):
    """Each query has its own passages: the group is the query."""
    q, p = spark.createDataFrame(QUERIES, "g string, qid string, query string").drop("g"), spark.createDataFrame(PASSAGES, "qid string, pos int, text string")
    got = ranking.bm25(q.where("qid = 'b'"), p, words, group="qid", numerator=2.0, k1=1.2, distinct_terms=True, digits=6).collect()
    assert [(r.qid, r.pos, r.overlap) for r in got] == [("b", 1, 1)]


def test_nothing_is_dealt_by_term(spark):
    """Terms of a text are far more bytes than the text: they are not shuffled."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = answers.selection(spark, SF, answers.contexts)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and not any("term#" in line for line in dealt), dealt
        assert sum("hashpartitioning(conv_id#" in line and "Reused" not in line for line in dealt) <= 3, dealt  # texts, turns and how many conversations there are
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
